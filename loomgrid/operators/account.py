"""Ledgers, usage, cost and statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.operators.rounds import cut, stored
from loomgrid.operators.sequence import numbered

#: The most different values that a bootstrap sends to all tasks (16 MB).
MAX_VALUES = 1_000_000


def max_then_sum(messages: DataFrame, id: str, by: str, fields: list[str]) -> DataFrame:
    """Counters that repeat while a message streams: the highest of each message, then their sums."""
    top = messages.groupBy(by, id).agg(*(F.max(f).alias(f) for f in fields))
    return top.groupBy(by).agg(*(F.sum(f).alias(f) for f in fields), F.count("*").alias("messages"))


def sum_if_complete(value: Column) -> Column:
    """A sum that one unknown makes unknown; nothing sums to 0."""
    return F.when(F.count("*") == 0, F.lit(0.0)).when(F.count(value) == F.count("*"), F.sum(value))


def prices_by_prefix(models: DataFrame, prices: DataFrame) -> DataFrame:
    """The first price row whose name is the model's, or a prefix of it up to a dash; prices: name, price, ordinal.

    A model's prefixes at dashes are exploded, so that the join is on equal names.
    """
    steps = F.split("model", "-")
    tried = models.withColumn("name", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "-"))))
    met = tried.join(prices, "name").groupBy("model").agg(F.min_by(F.struct("name", "price"), "ordinal").alias("p"))
    return models.join(met, "model", "left").select("model", F.col("p.name").alias("priced_as"), F.col("p.price").alias("price"))


def size_stats(rows: DataFrame, value: str, part: Column) -> DataFrame:
    """Count, mean (1 place), median and maximum of each part and of all."""
    marked = rows.select(part.alias("part"), value)
    stats = (F.count("*").alias("n"), F.round(F.avg(value), 1).alias("mean"), F.median(value).alias("median"), F.max(value).alias("most"))
    return marked.groupBy("part").agg(*stats).unionByName(marked.agg(*stats).withColumn("part", F.lit("all")))


def kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two 0/1 judgements."""
    n, x, y = F.count("*"), F.avg(a), F.avg(b)
    both = F.avg(F.when(F.col(a) == F.col(b), 1.0).otherwise(0.0))
    by_chance = x * y + (1 - x) * (1 - y)
    return rows.agg(n.alias("n"), F.round(both, 6).alias("agreement"), F.round(F.try_divide(both - by_chance, 1 - by_chance), 6).alias("kappa"))


def majority(votes: DataFrame, item: str, vote: str, least: int = 2) -> DataFrame:
    return votes.groupBy(item).agg(F.count_if(F.col(vote) == 1).alias("yes"), F.count("*").alias("votes")).withColumn("majority", F.col("yes") >= least)


def cochange(changes: DataFrame, least: int = 2, most: int = 15) -> DataFrame:
    """a < b and weight: for each commit of least to most files, 1 / (files - 1) for each pair; changes: commit_id, file."""
    files = changes.select("commit_id", "file").distinct()
    sizes = files.groupBy("commit_id").agg(F.count("*").alias("n")).filter(F.col("n").between(least, most))
    own = files.join(sizes, "commit_id")
    b = own.select("commit_id", F.col("file").alias("b"))
    return own.withColumnRenamed("file", "a").join(b, "commit_id").filter("a < b").groupBy("a", "b").agg(F.round(F.sum(1 / (F.col("n") - 1)), 6).alias("weight"))


def soft_modularity(weights: DataFrame, shares: DataFrame) -> DataFrame:
    """Q of soft groups: the sum of w * <m_a, m_b> / m less that of (K_g / 2m)^2; NaN without weight. weights: a, b, weight; shares: item, group, share."""
    total = weights.agg(F.sum("weight").alias("m"))
    a, b = shares.select(F.col("item").alias("a"), "group", F.col("share").alias("sa")), shares.select(F.col("item").alias("b"), "group", F.col("share").alias("sb"))
    inside = weights.join(a, "a").join(b, ["b", "group"]).agg(F.sum(F.col("weight") * F.col("sa") * F.col("sb")).alias("inside"))
    ends = weights.select(F.col("a").alias("item"), "weight").unionByName(weights.select(F.col("b").alias("item"), "weight"))
    k = ends.join(shares, "item").groupBy("group").agg(F.sum(F.col("weight") * F.col("share")).alias("k")).agg(F.sum(F.col("k") * F.col("k")).alias("kk"))
    one = total.join(inside, F.lit(True), "left").join(k, F.lit(True), "left")
    m = F.col("m")
    return one.select(F.when(m > 0, F.round(F.coalesce("inside", F.lit(0.0)) / m - F.coalesce("kk", F.lit(0.0)) / (4 * m * m), 6)).otherwise(F.lit(float("nan"))).alias("q"))


def drawn_number(*parts: Column) -> Column:
    """60 bits of a digest of these parts; the same in any SQL engine with md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts))), 1, 15), 16, 10).cast("long")


def bootstrap(rows: DataFrame, value: str, draws: int = 1000, seed: int = 7) -> DataFrame:
    """n, the mean and its 95 % interval over resamples of n rows, drawn with replacement.

    Each draw of each resample picks a row by its place among all values, so equal
    rows are drawn independently and a row can be drawn any number of times. Up to
    MAX_VALUES different values, with the places where each begins, are sent to all
    tasks, so that picks are added up where they are drawn; of more values, counts of
    places are shuffled to the values. A null value is no row.
    """
    given = rows.select(F.col(value).cast("double").alias("v")).filter("v is not null")
    different = stored(given.groupBy("v").agg(F.count("*").alias("k")))
    n = different.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]
    picks = rows.sparkSession.range(n * draws).select(F.expr(f"id div {max(n, 1)}").alias("draw"), F.pmod(drawn_number(F.lit(seed), F.col("id")), F.lit(max(n, 1))).alias("place"))
    if different.count() <= MAX_VALUES:
        table = different.orderBy("v").toArrow()
        sent = rows.sparkSession.sparkContext.broadcast((table.column("v").to_numpy(), np.cumsum(table.column("k").to_numpy())))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            values, ends = sent.value
            for b in batches:
                if b.num_rows:
                    draw, picked = b.column(0).to_numpy(), values[np.searchsorted(ends, b.column(1).to_numpy(), side="right")]
                    own, at = np.unique(draw, return_inverse=True)
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.bincount(at, picked)), pa.array(np.bincount(at))], names=["draw", "s", "k"])

        means = picks.mapInArrow(run, "draw long, s double, k long").groupBy("draw").agg((F.sum("s") / F.sum("k")).alias("mean"))
    else:
        times = picks.groupBy("draw", "place").agg(F.count("*").alias("k"))
        means = times.join(numbered(given, ["v"]), "place").groupBy("draw").agg((F.sum(F.col("v") * F.col("k")) / F.sum("k")).alias("mean"))
    ends = means.agg(F.percentile("mean", F.lit(0.025)).alias("low"), F.percentile("mean", F.lit(0.975)).alias("high"))
    own = different.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"), (F.sum(F.col("v") * F.col("k")) / F.sum("k")).alias("mean"))
    return own.join(ends, F.lit(True), "left").select("n", F.round("mean", 4).alias("mean"), F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


def permuted(labels: DataFrame, item: str, replicates: int = 30, seed: int = 1) -> DataFrame:
    """replicate, item and the label columns of another item: in each replicate a seeded permutation of all labels.

    Items are numbered once in their order, and once a replicate in a random one; each
    takes the labels of the item that has its number there. Items are unique.
    """
    own = cut(numbered(labels, [item]))
    n = own.count()
    # an item's place stands for the item, whose order it has
    each = own.withColumnRenamed("place", "_own").withColumn("replicate", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(replicates - 1).cast("long")))).withColumn("_key", drawn_number(F.lit(seed), F.col("replicate"), F.col(item))).drop(item)
    dealt = numbered(each, ["replicate", "_key", "_own"], [c for c in each.columns if c not in ("_key", "_own")]).withColumn("place", F.col("place") - F.col("replicate") * n)
    return dealt.join(own.select(item, "place"), "place").drop("place")


def modularity_of_replicates(weights: DataFrame, shares: DataFrame) -> DataFrame:
    """replicate and q of the soft groups of each replicate. weights: a, b, weight, the same for all; shares: replicate, item, group, share."""
    total = weights.agg(F.sum("weight").alias("m"))
    a = shares.select("replicate", F.col("item").alias("a"), "group", F.col("share").alias("sa"))
    b = shares.select("replicate", F.col("item").alias("b"), "group", F.col("share").alias("sb"))
    inside = weights.join(a, "a").join(b, ["replicate", "b", "group"]).groupBy("replicate").agg(F.sum(F.col("weight") * F.col("sa") * F.col("sb")).alias("inside"))
    ends = weights.select(F.col("a").alias("item"), "weight").unionByName(weights.select(F.col("b").alias("item"), "weight")).groupBy("item").agg(F.sum("weight").alias("k"))
    k = ends.join(shares, "item").groupBy("replicate", "group").agg(F.sum(F.col("k") * F.col("share")).alias("k")).groupBy("replicate").agg(F.sum(F.col("k") * F.col("k")).alias("kk"))
    met = shares.select("replicate").distinct().join(inside, "replicate", "left").join(k, "replicate", "left").join(total, F.lit(True))
    m = F.col("m")
    return met.select("replicate", F.when(m > 0, F.coalesce("inside", F.lit(0.0)) / m - F.coalesce("kk", F.lit(0.0)) / (4 * m * m)).otherwise(F.lit(float("nan"))).alias("q"))


def modularity_of_labels(weights: DataFrame, labels: DataFrame) -> DataFrame:
    """replicate and q of groups without shares. weights: a, b, weight; labels: replicate, item, group, once an item and replicate.

    An item's groups in all replicates are one array of their numbers, in the fewest bytes
    that hold these, so a weight meets its two ends once and carries one short array.
    """
    total = weights.agg(F.sum("weight").alias("m"))
    replicates = [r[0] for r in labels.select("replicate").distinct().orderBy("replicate").collect()]
    groups = cut(numbered(labels.select("group").filter("`group` is not null").distinct(), ["group"]))
    n = groups.count()
    kind = "tinyint" if n <= 127 else "smallint" if n <= 32_767 else "int"
    coded = labels.join(groups if kind == "int" else F.broadcast(groups), "group", "left").select("item", "replicate", F.coalesce("place", F.lit(-1)).cast(kind).alias("_number"))
    # one number a replicate; -1 is a null group, null is none
    own = stored(coded.groupBy("item").agg(*(F.max(F.when(F.col("replicate") == r, F.col("_number"))).alias(f"_{i}") for i, r in enumerate(replicates))).select("item", F.array(*(f"_{i}" for i in range(len(replicates)))).cast(f"array<{kind}>").alias("_in")))
    a, b = own.select(F.col("item").alias("a"), F.col("_in").alias("_a")), own.select(F.col("item").alias("b"), F.col("_in").alias("_b"))
    same = lambda i: (F.col("_a")[i] == F.col("_b")[i]) & (F.col("_a")[i] >= 0)
    sums = weights.join(a, "a").join(b, "b").agg(*(F.sum(F.when(same(i), F.col("weight"))).alias(f"_{i}") for i in range(len(replicates))))
    told = F.array(*(F.struct(F.lit(r).alias("replicate"), F.col(f"_{i}").alias("inside")) for i, r in enumerate(replicates)))
    inside = sums.select(F.explode(told).alias("t")).select("t.*") if replicates else labels.select("replicate", F.lit(0.0).alias("inside"))
    ends = weights.select(F.col("a").alias("item"), "weight").unionByName(weights.select(F.col("b").alias("item"), "weight")).groupBy("item").agg(F.sum("weight").alias("k"))
    k = ends.join(own, "item").select("k", F.posexplode("_in").alias("_at", "_number")).filter("_number is not null").groupBy("_at", "_number").agg(F.sum("k").alias("k"))
    k = k.groupBy("_at").agg(F.sum(F.col("k") * F.col("k")).alias("kk"))
    k = k.select(F.element_at(F.array(*map(F.lit, replicates)), F.col("_at") + 1).alias("replicate"), "kk") if replicates else labels.select("replicate", F.lit(0.0).alias("kk"))
    found = labels.select("replicate").distinct().join(inside, "replicate", "left").join(k, "replicate", "left").join(total, F.lit(True))
    m = F.col("m")
    return found.select("replicate", F.when(m > 0, F.coalesce("inside", F.lit(0.0)) / m - F.coalesce("kk", F.lit(0.0)) / (4 * m * m)).otherwise(F.lit(float("nan"))).alias("q"))


def hard(labels: DataFrame) -> DataFrame:
    """Labels (item, group) as shares of 1."""
    return labels.withColumn("share", F.lit(1.0))


def file_shares(labels: DataFrame, keys: list[str]) -> DataFrame:
    """Shares of each file's lines by group; labels: keys, file, group, lines."""
    lines = labels.groupBy(*keys, "file", "group").agg(F.sum("lines").alias("lines"))
    whole = lines.groupBy(*keys, "file").agg(F.sum("lines").alias("_all"))
    return lines.join(whole, [*keys, "file"]).select(*keys, F.col("file").alias("item"), "group", (F.col("lines") / F.col("_all")).alias("share"))
