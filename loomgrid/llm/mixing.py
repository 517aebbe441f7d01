"""Mixing sources to target weights by a low-discrepancy schedule.

A mix is a sequence of slots of equally many words. Slot i takes the i-th van der
Corput point; the source in whose part of the cumulative weights the point falls
gets the slot. Because the points are a bit reversal, the rank of a slot among
those of its source has a closed form, so slots need no window. Each source's
documents, in a seeded shuffle, form one long stream of words, which is repeated
as often as the target asks; the source's k-th slot takes the k-th block of it,
and the last block is cut so that the source takes its target and no more.

Targets: sources by code point, null last, weigh 3, 1, 2, repeating, and share
150 % of all words; a target stops at twice its source's words, the excess being
shared again by weight.

Defined results: a null or empty text has size 0, gives no words and has no slot;
a source without words has target 0. Very long texts cover many slots. Repeated
rows are separate rows. An empty table gives no rows. Extra columns of any name
are ignored by take() and kept by mixed().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgrid.llm.ordered import cut, parts, ranked, small_batches
from loomgrid.llm.sharding import seeded, source_key
from loomgrid.llm.words import Words, slices

WEIGHTS, SHARE, MOST, SEED = (3, 1, 2), 1.5, 2, "mix-1"
#: Words of a slot, and bits of the points.
BLOCK, BITS = 1024, 40


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """_source, source_size and target. One row a source: its windows run over sources, not over documents."""
    one = Window.partitionBy(F.lit(0))
    by = sizes.groupBy("_source").agg(F.sum("size").alias("source_size"))
    by = by.withColumn("_n", F.row_number().over(one.orderBy("_source")) - 1)
    by = by.withColumn("_w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("_n") % len(weights) + 1).cast("int")))
    by = by.withColumn("_most", most * F.col("source_size").cast("double")).withColumn("_all", share * F.sum("source_size").over(one).cast("double"))
    up = one.orderBy(F.col("_most") / F.col("_w"), "_source")
    before, after = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
    by = by.withColumn("_level", (F.col("_all") - F.coalesce(F.sum("_most").over(before), F.lit(0.0))) / F.sum("_w").over(after))
    # the sources that stop at their most are the first in this order; the level of the others is that at the first of them
    by = by.withColumn("_open", F.min(F.when(F.col("_level") * F.col("_w") < F.col("_most"), F.struct(F.col("_most") / F.col("_w"), F.col("_source"), F.col("_level").alias("level")))).over(one)["level"])
    return by.select("_source", "_n", "source_size", F.least(F.col("_most"), F.coalesce(F.col("_open") * F.col("_w"), F.col("_most"))).alias("target"))


def counted(i: np.ndarray, x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """How many of the first i van der Corput points, times 2**bits, lie below x."""
    total, high = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    for b in range(bits - 1, -1, -1):
        on = (i >> b) & 1 == 1
        total += np.where(on, np.clip(-((high - x) >> (bits - b)), 0, 1 << b), 0)
        high += np.where(on, np.int64(1) << (bits - 1 - b), 0)
    return total


def reversed_bits(i: np.ndarray, bits: int = BITS) -> np.ndarray:
    out = np.zeros(len(i), np.int64)
    for b in range(bits):
        out |= ((i >> b) & 1) << (bits - 1 - b)
    return out


def schedule(plan: DataFrame, block: int = BLOCK) -> DataFrame:
    """slot, _source, rank and words of each slot that takes words; plan: from targets(), cut."""
    spark, top = plan.sparkSession, 1 << BITS
    one = Window.partitionBy(F.lit(0)).orderBy("_n")
    own = plan.withColumn("_words", F.floor("target").cast("long")).filter("_words > 0")
    own = own.withColumn("_total", F.sum("_words").over(Window.partitionBy(F.lit(0))))
    own = own.withColumn("_hi", F.round(F.sum("_words").over(one) / F.col("_total") * F.lit(float(top))).cast("long"))
    own = own.withColumn("_lo", F.coalesce(F.lag("_hi").over(one), F.lit(0))).withColumn("_need", F.expr(f"(_words + {block - 1}) div {block}"))

    def enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lo, hi, need = (b.column(c).to_numpy() for c in ("_lo", "_hi", "_need"))
            low, high = np.zeros(len(lo), np.int64), np.full(len(lo), top - 1)
            for _ in range(BITS):
                mid = (low + high) // 2
                done = counted(mid, hi) - counted(mid, lo) >= need
                low, high = np.where(done, low, mid + 1), np.where(done, mid, high)
            yield pa.RecordBatch.from_arrays([pa.array(high)], names=["slots"])

    own = cut(own.select("_source", "_words", "_lo", "_hi"))
    n = own.withColumn("_need", F.expr(f"(_words + {block - 1}) div {block}")).select("_lo", "_hi", "_need").mapInArrow(enough, "slots long").agg(F.max("slots")).first()[0] or 0
    # a slot finds its source through a grid of cells: a source has a row in each cell that its part of the weights meets
    cells, width = 1 << 12, top >> 12
    grid = own.withColumn("_cell", F.explode(F.expr(f"sequence(_lo div {width}, greatest(_lo, _hi - 1) div {width})")))

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.column("id").to_numpy()
            x = reversed_bits(i)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(x), pa.array(x // width)], names=["slot", "_x", "_cell"])

    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i, lo, hi = (b.column(c).to_numpy() for c in ("slot", "_lo", "_hi"))
            rank = counted(i, hi) - counted(i, lo)
            yield pa.RecordBatch.from_arrays([b.column("slot"), b.column("_source"), pa.array(rank), b.column("_words")], names=["slot", "_source", "rank", "_words"])

    met = spark.range(n).mapInArrow(points, "slot long, _x long, _cell long").join(grid, "_cell").filter("_x >= _lo and _x < _hi")
    out = met.select("slot", "_lo", "_hi", "_source", "_words").mapInArrow(ranks, "slot long, _source string, rank long, _words long")
    assert cells * width == top
    return out.select("slot", "_source", "rank", F.least(F.lit(block), F.col("_words") - F.col("rank") * block).alias("words")).filter("words > 0")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, _source, size and _text, a hash of the text, of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            w = Words(b.column("text"), hashes=False)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_source"), pa.array(w.count.astype(np.int64)), b.column("_text")], names=["doc_id", "_source", "size", "_text"])

    rows = small_batches(docs).select("doc_id", source_key().alias("_source"), "text", F.xxhash64("text").alias("_text"))
    return rows.mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("_source", T.StringType()), T.StructField("size", T.LongType()), T.StructField("_text", T.LongType())]))


def pieces(docs: DataFrame, seed: str = SEED, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The ranked documents with targets, and slot, _source, rank, doc_id, row, epoch, from_word, to_word of what each slot takes of them.

    row: the document's place in its source's shuffle; epoch: how often the source's
    stream was taken before; words are counted in the document from 0.
    """
    # one digest a document, so that the shuffled order depends on no partitioning
    rows = ranked(sized(docs).withColumn("_key", seeded(seed, "doc_id")), "_source", ["_key", "doc_id", "_text"], ["size"])
    rows = cut(rows.select("doc_id", "_source", "size", "_text", F.col("rank").alias("row"), F.col("before_size").alias("_at")))
    plan = cut(targets(rows))
    slots = schedule(plan, block)
    epochs = rows.filter("size > 0").join(plan.select("_source", "source_size", F.floor("target").cast("long").alias("_words")), "_source")
    epochs = epochs.withColumn("_epoch", F.explode(F.expr("sequence(0L, greatest(_words - 1, 0L) div source_size)"))).withColumn("_from", F.expr("_epoch * source_size + _at"))
    met = epochs.withColumn("rank", F.explode(F.expr(f"sequence(_from div {block}, (_from + size - 1) div {block})"))).join(slots, ["_source", "rank"])
    lo = F.greatest(F.col("rank") * block - F.col("_from"), F.lit(0))
    hi = F.least(F.col("rank") * block + F.col("words") - F.col("_from"), F.col("size"))
    taken = met.select("slot", "_source", "rank", "doc_id", "row", F.col("_epoch").alias("epoch"), lo.alias("from_word"), hi.alias("to_word")).filter("from_word < to_word")
    return rows.join(plan.select("_source", "source_size", "target"), "_source"), taken


def take(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_slot and last_slot of each row: what the slots of the schedule take of it, and the first and last that do."""
    rows, got = pieces(docs, seed)
    got = got.groupBy("_source", "row").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"))
    found = rows.join(got, ["_source", "row"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
    return found.select("doc_id", "size", "source_size", "target", "taken", "first_slot", "last_slot")


def recoded(rows: DataFrame, name: str, pack: bool) -> DataFrame:
    """The rows with this text column packed, each text by itself after its length, or unpacked again."""

    def code(value: pa.Scalar) -> bytes | None:
        raw, zstd = value.as_buffer(), pa.Codec("zstd")
        if raw is None:
            return None
        if pack:
            return raw.size.to_bytes(8, "little") + zstd.compress(raw, asbytes=True)
        size = int.from_bytes(raw.slice(0, 8).to_pybytes(), "little")
        return zstd.decompress(raw.slice(8), size, asbytes=True) if size else b""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, name):
            i = b.schema.get_field_index(name)
            out = pa.array(map(code, b.column(i)), pa.binary())
            yield b.set_column(i, name, out if pack else out.view(pa.string()))

    kind = T.BinaryType() if pack else T.StringType()
    return rows.mapInArrow(run, T.StructType([T.StructField(f.name, kind if f.name == name else f.dataType, True) for f in rows.schema]))


def mixed(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The rows of the mix with all their columns, in the order of the schedule: each document as often as its words are taken, to the nearest whole time.

    A copy stands at the slot that takes its first word, so that sources interleave
    by weight and the copies of a document lie a whole stream apart. Rows that agree
    in doc_id, source and text take their average. A document without words is not
    in the mix.
    """
    rows, got = pieces(docs, seed)
    own = ["_source", "_text", "doc_id"]
    starts = got.groupBy("_source", "row").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"), *(F.min(F.when(F.col("epoch") == e, F.col("slot"))).alias(f"_slot{e}") for e in range(MOST)))
    times = rows.filter("size > 0").join(starts, ["_source", "row"], "left").groupBy(*own).agg(F.round(F.sum("taken") / F.sum("size")).cast("int").alias("_times"), *(F.min(f"_slot{e}").alias(f"_slot{e}") for e in range(MOST)))
    times = times.filter("_times > 0").select(F.col("_source"), F.col("_text"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.slice(F.array(*(f"_slot{e}" for e in range(MOST))), F.lit(1), F.col("_times")).alias("_slots"))
    # texts are packed before they are moved: once to meet their slots, once, repeated, into order
    own = [F.col(f"`{c.replace('`', '``')}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)]
    name = f"_c{[c.lower() for c in docs.columns].index('text')}"
    texts = docs.select(*own, source_key().alias("_source"), F.xxhash64("text").alias("_text"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"))
    copies = recoded(texts, name, True).join(times, ["_source", "_text", "_id"]).withColumn("_slot", F.explode("_slots"))
    ordered = copies.repartitionByRange(parts(copies), "_slot", "_id", "_text").sortWithinPartitions("_slot", "_id", "_text")
    return recoded(ordered.select(*(f"_c{i}" for i in range(len(own)))), name, False).toDF(*docs.columns)
