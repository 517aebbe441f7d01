"""Sharding by proportional stratified interleaving.

Rows of each source are ranked in a seeded shuffle; a row's fractional rank is the
share of its source's rows before it. Sorting all rows by fractional rank deals
every source evenly over the order, so equal cuts of it all hold the corpus'
mixture. The law is `rows`: counts of shards differ by at most one.

Equal texts are one unit: of whichever source, they are ranked together with the
rows of the first of their sources, have the fractional rank of their middle, and
stand together in the order. So of all groups of equal texts only those over which
a cut falls, one a cut at most, are in more than one shard.

Defined results: a null text has size 1 and the checksum of no bytes, and is equal
to an empty one; a null source is a source of its own, after all others. Repeated
rows are separate rows of one group. Very long texts count as one row. An empty
table gives no rows. Extra columns of any name are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.ordered import cut, ranked

SHARDS, SEED = 8, "shard-1"
#: Rows of one text that are joined under one key.
SPLIT = 4096


def seeded(seed: str, *cols: str):
    """60 bits of a digest of the seed and these columns; the same in any SQL engine with md5."""
    text = F.concat_ws("|", F.lit(seed), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def source_key():
    """Sources by code point, null last, as a column without nulls."""
    return F.coalesce(F.concat(F.lit("0"), F.col("source")), F.lit("1"))


def assign(docs: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard and slot of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", source_key().alias("_source"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"),
        seeded(seed, "text").alias("_text"), seeded(seed, "doc_id").alias("_row"),
    )
    rows = cut(rows)
    groups = rows.groupBy("_text").agg(F.min("_source").alias("_home"), F.count("*").alias("_n"))
    within = ranked(groups, "_home", ["_text"], ["_n"])
    dealt = within.select("_text", "_home", "_n", ((2 * F.col("before__n") + F.col("_n")) / (2 * F.col("all__n"))).alias("_share"), F.lit("all").alias("_all"))
    placed = ranked(dealt, "_all", ["_share", "_home", "_text"], ["_n"]).select("_text", F.col("before__n").alias("_at"), F.col("all__n").alias("_total"), F.explode(F.expr(f"sequence(0L, (_n - 1) div {SPLIT})")).alias("_piece"))
    # a row's place in its group; pieces of a group meet copies of its one row
    own = ranked(rows.withColumn("_name", F.col("_text").cast("string")), "_name", ["_row", "doc_id"]).withColumn("_piece", F.expr(f"rank div {SPLIT}"))
    out = own.join(placed, ["_text", "_piece"]).withColumn("_p", F.col("_at") + F.col("rank"))
    shard, first = F.expr(f"_p * {shards} div _total"), F.expr(f"(shard * _total + {shards - 1}) div {shards}")
    return out.withColumn("shard", shard.cast("int")).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("_p") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
