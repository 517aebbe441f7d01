"""Ordered operators: first wins, islands of spans, prefix sums, ordered assembly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgrid.operators.rounds import stored


def first_wins(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in this order, which must be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def numbered(rows: DataFrame, order: list[str], keep: list[str] | None = None) -> DataFrame:
    """The rows, or these columns of them, with their place, from 0, in this order over all of them; rows that tie have any of their places.

    Rows are dealt by ranges of the order; what a window would do in one task, each
    partition does for itself, and only the partitions' sizes are added up. Rows are
    stored, compressed, with their places in their partition.
    """
    keep = rows.columns if keep is None else keep
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    own = stored(dealt.select(*keep, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = own.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_past", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("_part", "_past")
    return own.join(sizes, "_part").select(*keep, (F.col("_past") + F.col("_at")).alias("place"))


def merge_spans(spans: DataFrame, key: str, start: str = "start_line", end: str = "end_line", context: int = 0) -> DataFrame:
    """Overlapping or adjacent closed spans of each key become one."""
    own = spans.select(key, F.greatest(F.col(start) - context, F.lit(1)).alias("_s"), (F.col(end) + context).alias("_e"))
    by = Window.partitionBy(key).orderBy("_s", "_e")
    past = by.rowsBetween(Window.unboundedPreceding, -1)
    marked = own.withColumn("_new", F.when(F.col("_s") > F.coalesce(F.max("_e").over(past) + 1, F.lit(-1)), 1).otherwise(0))
    island = marked.withColumn("_island", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(key, "_island").agg(F.min("_s").alias("start_line"), F.max("_e").alias("end_line")).drop("_island")


def lines(files: DataFrame, key: str = "path", text: str = "source") -> DataFrame:
    """line_no, line, start_byte and end_byte (with its line break, half open) of each line, numbered where the text is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                value = batch.column(1)[i].as_py()
                if value is None:
                    continue
                own = pa.array(value.split("\n"), pa.string())
                size = pc.binary_length(own).to_numpy().astype(np.int64) + 1
                end = np.cumsum(size)
                name = batch.column(0).take(pa.array(np.full(len(own), i)))
                whole = pa.RecordBatch.from_arrays([name, pa.array(np.arange(1, len(own) + 1)), own, pa.array(end - size), pa.array(end)], names=[key, "line_no", "line", "start_byte", "end_byte"])
                for at in range(0, len(own), 20_000):
                    yield whole.slice(at, 20_000)

    return files.select(key, text).mapInArrow(run, T.StructType([files.schema[key], *T.StructType.fromDDL("line_no long, line string, start_byte long, end_byte long")]))


def chunks(numbered: DataFrame, size: int, key: str = "path") -> DataFrame:
    """Runs of size lines: chunk, start_line, end_line, start_byte, end_byte and text."""
    at = numbered.withColumn("chunk", F.expr(f"(line_no - 1) div {size}"))
    return at.groupBy(key, "chunk").agg(
        F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), F.min("start_byte").alias("start_byte"), F.max("end_byte").alias("end_byte"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"),
    )


def assembled(pieces: DataFrame, key: str, order: str, text: str, between: str = "\n") -> DataFrame:
    """Texts of each key joined in order, and the digest of the whole."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), between)
    return pieces.groupBy(key).agg(whole.alias("whole")).withColumn("sha256", F.sha2("whole", 256))


def contiguous(pieces: DataFrame, key: str, start: str = "start_byte", end: str = "end_byte") -> DataFrame:
    """Whether the half-open ranges of each key follow one another from 0."""
    by = Window.partitionBy(key).orderBy(start)
    ok = F.col(start) == F.coalesce(F.lag(end).over(by), F.lit(0))
    return pieces.withColumn("_ok", ok).groupBy(key).agg(F.bool_and("_ok").alias("contiguous"), F.max(end).alias("length"), F.count("*").alias("pieces"))


def holes(whole: DataFrame, taken: DataFrame, key: str) -> DataFrame:
    """What half-open ranges of a key leave of its range [0, length)."""
    by = Window.partitionBy(key).orderBy("start_byte", "end_byte").rowsBetween(Window.unboundedPreceding, -1)
    ends = whole.select(key, F.col("length").alias("start_byte"), F.col("length").alias("end_byte"))
    rows = taken.select(key, "start_byte", "end_byte").unionByName(ends)
    gap = rows.withColumn("_from", F.coalesce(F.max("end_byte").over(by), F.lit(0)))
    return gap.filter("start_byte > _from").select(key, F.col("_from").cast("long").alias("start_byte"), F.col("start_byte").alias("end_byte"))


def points_within(points: DataFrame, ranges: DataFrame, key: str, point: str, start: str, end: str, width: int) -> DataFrame:
    """Each point with each half-open range that holds it.

    An interval join as an equi-join: a range has a row in each bin of `width` that
    it meets, a point in its own, so no key meets all ranges of a large file.
    """
    binned = ranges.withColumn("_bin", F.explode(F.expr(f"sequence({start} div {width}, greatest({start}, {end} - 1) div {width})")))
    return points.withColumn("_bin", F.expr(f"{point} div {width}")).join(binned, [key, "_bin"]).filter(f"{point} >= {start} and {point} < {end}").drop("_bin")


def owner_of_points(points: DataFrame, ranges: DataFrame, key: str = "path", width: int = 4096) -> DataFrame:
    """The first range by ordinal that holds each point (key, point); ranges: key, range_id, start_byte, end_byte, ordinal."""
    met = points_within(points, ranges, key, "point", "start_byte", "end_byte", width)
    return met.groupBy(*points.columns).agg(F.min_by("range_id", "ordinal").alias("owner"))


def runs(rows: DataFrame, key: str, order: list, value: Column) -> DataFrame:
    """Lengths of runs of equal values: key, value, length and the run's number."""
    by = Window.partitionBy(key).orderBy(*order)
    own = rows.withColumn("value", value)
    own = own.withColumn("_new", F.when(F.lag("value").over(by).eqNullSafe(F.col("value")), 0).otherwise(1))
    own = own.withColumn("run", F.sum("_new").over(by))
    return own.groupBy(key, "run", "value").agg(F.count("*").alias("length"))


def budget_prefix(rows: DataFrame, key: str, order: list, cost: str, budget: int) -> DataFrame:
    """The longest prefix of each key whose costs stay within the budget."""
    by = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("spent", F.sum(cost).over(by)).filter(F.col("spent") <= budget)


def budget_chunks(rows: DataFrame, key: str, order: str, cost: str, budget: int, most: int) -> DataFrame:
    """Greedy chunks in order: a new one where the next row would pass the budget or the member count.

    A fold over each key's ordered costs; the chunk numbers come out in order.
    """
    own = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(cost).cast("long").alias("c")))).alias("_rows"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("n"), F.lit(0).alias("chunk"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        full = (s["n"] > 0) & ((s["used"] + x["c"] > budget) | (s["n"] >= most))
        chunk = F.when(full, s["chunk"] + 1).otherwise(s["chunk"])
        return F.struct(F.when(full, x["c"]).otherwise(s["used"] + x["c"]).alias("used"), F.when(full, 1).otherwise(s["n"] + 1).alias("n"), chunk.alias("chunk"), F.concat(s["out"], F.array(chunk)).alias("out"))

    own = own.withColumn("_out", F.aggregate("_rows", start, step)["out"])
    return own.select(key, F.explode(F.arrays_zip("_rows", "_out")).alias("x")).select(key, F.col("x._rows.o").alias(order), F.col("x._rows.c").alias(cost), F.col("x._out").alias("chunk"))
