"""Ordered scans over groups of any size, and cutting lineage.

A window function puts a group into one task. Here rows are dealt by ranges of
(group, order), so that a large group covers many partitions; each partition
computes its own running values, and the few rows per partition and group that
carry them over are joined back.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Files a core of a table that cuts lineage.
FILES = 4
#: Bytes of an Arrow batch; a row of more goes alone.
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of our own if all is on one machine, else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            return found.get()
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="loomgrid-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(at)
    return at


def small_batches(df: DataFrame) -> DataFrame:
    """The same rows; the session sends Arrow batches of BATCH_BYTES from now on, unless it sets a bound of its own.

    Its default is 64 MB, which the JVM and the Python worker of each task hold more than once.
    """
    conf = df.sparkSession.conf
    if BATCH_SETTING not in conf.getAll:
        conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read back from a table in the folder all executors share; it goes when the driver ends.

    At most FILES files a core are written: tasks that end in a table take several
    partitions, one after another, rather than write a file for each.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark).rstrip('/')}/loomgrid-{uuid.uuid4().hex}"
    df.coalesce(FILES * spark.sparkContext.defaultParallelism).write.option("compression", "zstd").parquet(at)
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(at)


def parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, group: str, order: Sequence[str], sums: Sequence[str] = ()) -> DataFrame:
    """Adds to each row what precedes it in its group in this order.

    group: a string column without nulls. sums: long columns without nulls.
    Adds rank (rows before it), group_rows, and before_X and all_X for each X of
    sums. Rows that tie in group and order keep an arbitrary but fixed order.
    """
    # the partition of the deal, whichever task it is worked out in
    dealt = df.repartitionByRange(parts(df), *[group, *order]).sortWithinPartitions(group, *order).withColumn("_part", F.spark_partition_id().cast("long"))
    fields = [*dealt.schema.fields, T.StructField("rank", T.LongType(), False), *(T.StructField(f"before_{c}", T.LongType(), False) for c in sums)]

    def scan(batches):
        last = None
        carry = dict.fromkeys(["rank", *sums], 0)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            names = batch.column(batch.schema.get_field_index(group)).dictionary_encode()
            code = names.indices.to_numpy(zero_copy_only=False)
            new = np.ones(n, bool)
            new[1:] = code[1:] != code[:-1]
            words = names.dictionary
            new[0] = words[int(code[0])].as_py() != last
            start = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            out = []
            for c in ["rank", *sums]:
                value = np.ones(n, np.int64) if c == "rank" else batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
                total = np.concatenate([[0], np.cumsum(value)])
                before = total[:-1] - np.where(start >= 0, total[np.maximum(start, 0)], 0) + np.where(start < 0, carry[c], 0)
                carry[c] = int(before[-1] + value[-1])
                out.append(pa.array(before, pa.int64()))
            last = words[int(code[-1])].as_py()
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=[f.name for f in fields])

    local = cut(dealt.mapInArrow(scan, T.StructType(fields)))
    ends = local.groupBy("_part", group).agg(F.count("*").alias("_n_rank"), *(F.sum(c).alias(f"_n_{c}") for c in sums))
    mine = Window.partitionBy(group)
    past = mine.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    plus = [x for c in ["rank", *sums] for x in (F.coalesce(F.sum(f"_n_{c}").over(past), F.lit(0)).alias(f"_past_{c}"), F.sum(f"_n_{c}").over(mine).alias(f"_all_{c}"))]
    ends = ends.select(F.col("_part"), F.col(group), *plus)
    joined = local.join(ends, ["_part", group])
    return joined.select(
        *(F.col(c) for c in df.columns), (F.col("rank") + F.col("_past_rank")).alias("rank"), F.col("_all_rank").alias("group_rows"),
        *(x for c in sums for x in ((F.col(f"before_{c}") + F.col(f"_past_{c}")).alias(f"before_{c}"), F.col(f"_all_{c}").alias(f"all_{c}"))),
    )


def quantiles(rows: DataFrame, group: str, value: str, places: Callable[[str, int], list[float]]) -> dict[str, list[float]]:
    """The values at these places, from 0, of the sorted values of each group, exactly; between two values, in proportion.

    places: of a group and its number of rows, few. group: a string column without
    nulls; value: doubles without nulls. Equal values are counted before they are dealt.
    """
    counted = rows.groupBy(group, value).agg(F.count("*").alias("_n"))
    held = cut(ranked(counted, group, [value], ["_n"]).select(group, value, F.col("before__n").alias("_from"), (F.col("before__n") + F.col("_n")).alias("_to"), F.col("all__n").alias("_all")))
    asked = {r[group]: places(r[group], r["_all"]) for r in held.groupBy(group).agg(F.max("_all").alias("_all")).collect()}
    want = sorted({(g, int(x)) for g, at in asked.items() for p in at for x in (np.floor(p), np.ceil(p))})
    if not want:
        return {}
    spots = rows.sparkSession.createDataFrame(want, T.StructType([rows.schema[group], T.StructField("_place", T.LongType())]))
    met = held.join(F.broadcast(spots), group).filter("_place >= _from and _place < _to")
    found = {(r[group], r["_place"]): r[value] for r in met.select(group, "_place", value).collect()}
    between = lambda g, p: (a := found[g, int(np.floor(p))]) + (found[g, int(np.ceil(p))] - a) * (p - np.floor(p))
    return {g: [float(between(g, p)) for p in at] for g, at in asked.items()}
