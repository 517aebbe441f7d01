"""TF-IDF neighbours, near duplicates and grounding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tfidf_neighbours(words: DataFrame, k: int = 5, floor: float = 0.25, common: float = 0.5, small: int = 20) -> DataFrame:
    """a, b and cosine of each document's k nearest; words: doc, word, n.

    Words in more than this share of the documents are left out where there are
    more than small documents; what remains bounds each posting list to that share.
    """
    n = words.agg(F.count_distinct("doc").alias("docs"))
    df = words.groupBy("word").agg(F.count("*").alias("df"))
    kept = df.join(n, F.lit(True)).filter((F.col("docs") <= small) | (F.col("df") <= common * F.col("docs"))).withColumn("idf", F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1)
    weighted = words.join(kept.select("word", "idf"), "word").withColumn("w", F.col("n") * F.col("idf"))
    norm = weighted.groupBy("doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    unit = weighted.join(norm, "doc").select("doc", "word", (F.col("w") / F.col("norm")).alias("w"))
    a, b = unit.select(F.col("doc").alias("a"), "word", F.col("w").alias("wa")), unit.select(F.col("doc").alias("b"), "word", F.col("w").alias("wb"))
    scores = a.join(b, "word").filter("a <> b").groupBy("a", "b").agg(F.round(F.sum(F.col("wa") * F.col("wb")), 6).alias("cosine")).filter(F.col("cosine") >= floor)
    top = scores.withColumn("_n", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "b"))).filter(F.col("_n") <= k)
    return top.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cosine").groupBy("a", "b").agg(F.max("cosine").alias("cosine"))


def jaccard_pairs(sets: DataFrame, least: float = 0.7) -> DataFrame:
    """a < b of a Jaccard similarity of least or more; sets: id, item, distinct.

    Items are ordered by the number of sets that hold them. Of two sets so similar, each
    shares one of its first n - ceil(least * n) + 1 items with the other's, so pairs meet
    on these alone, once, and only where their sizes are near; a pair that meets compares
    its whole sets, two arrays. Similarities are rounded to six places, so the bound is lower by half of one.
    """
    bound = least - 5e-7
    often = sets.groupBy("item").agg(F.count("*").alias("_often"))
    ranked = sets.join(often, "item").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("_often", "item"))).alias("_items"))
    own = ranked.select("id", F.size("_items").alias("n"), F.transform("_items", lambda x: x["item"]).alias("items"))
    heads = own.select("id", "n", F.explode(F.slice("items", F.lit(1), (F.col("n") - F.ceil(bound * F.col("n")) + 1).cast("int"))).alias("item"))
    a, b = heads.select(F.col("id").alias("a"), "item", F.col("n").alias("na")), heads.select(F.col("id").alias("b"), "item", F.col("n").alias("nb"))
    met = a.join(b, "item").filter((F.col("a") < F.col("b")) & (F.least("na", "nb") >= bound * F.greatest("na", "nb"))).select("a", "b").distinct()
    whole = met.join(own.select(F.col("id").alias("a"), F.col("items").alias("_a")), "a").join(own.select(F.col("id").alias("b"), F.col("items").alias("_b")), "b")
    both = F.size(F.array_intersect("_a", "_b"))
    return whole.withColumn("jaccard", F.round(both / (F.size("_a") + F.size("_b") - both), 6)).filter(F.col("jaccard") >= least).select("a", "b", "jaccard")
