"""Clustering, packing and repair: what has no window or join form runs per group in Python."""

from __future__ import annotations

import math
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.operators.rounds import cut


def weighted_graph(links: DataFrame, callers: DataFrame, text: DataFrame) -> DataFrame:
    """a < b and weight: (1 + ln count) / ln(e + callers of the target) for links, half the cosine for text, summed.

    links: from, to, count; callers: to, callers; text: a, b, cosine.
    """
    w = (1 + F.log(F.greatest("count", F.lit(1)).cast("double"))) / F.log(F.lit(math.e) + F.col("callers"))
    own = links.join(callers, "to").select(F.least("from", "to").alias("a"), F.greatest("from", "to").alias("b"), w.alias("w")).filter("a <> b")
    return own.unionByName(text.select("a", "b", (F.col("cosine") / 2).alias("w"))).groupBy("a", "b").agg(F.round(F.sum("w"), 6).alias("weight"))


def contracted(weights: DataFrame, groups: DataFrame) -> DataFrame:
    """Weights between groups, and inside them where a = b; groups: item, group."""
    a, b = groups.select(F.col("item").alias("a"), F.col("group").alias("ga")), groups.select(F.col("item").alias("b"), F.col("group").alias("gb"))
    return weights.join(a, "a").join(b, "b").groupBy(F.least("ga", "gb").alias("a"), F.greatest("ga", "gb").alias("b")).agg(F.round(F.sum("weight"), 6).alias("weight"))


def louvain(edges: list[tuple], resolution: float = 1.0, rounds: int = 20) -> dict:
    """Communities by local moving and contraction; nodes in sorted order, so that reruns agree."""
    graph: dict = defaultdict(dict)
    for a, b, w in edges:
        graph[a][b] = graph[a].get(b, 0.0) + w
        graph[b][a] = graph[b].get(a, 0.0) + w
    label = {n: n for n in graph}
    level = {n: dict(x) for n, x in graph.items()}
    while True:
        degree = {n: sum(x.values()) + x.get(n, 0.0) for n, x in level.items()}
        m2 = sum(degree.values())
        if m2 <= 0:
            break
        home, total, moved_any = {n: n for n in level}, dict(degree), False
        for _ in range(rounds):
            moved = False
            for n in sorted(level):
                near: dict = defaultdict(float)
                for x, w in level[n].items():
                    if x != n:
                        near[home[x]] += w
                own = home[n]
                total[own] -= degree[n]
                gain = lambda c: near.get(c, 0.0) - resolution * total[c] * degree[n] / m2
                best = max([own, *sorted(near)], key=lambda c: (round(gain(c), 12), c == own))
                total[best] += degree[n]
                if best != own:
                    home[n], moved, moved_any = best, True, True
            if not moved:
                break
        if not moved_any:
            break
        label = {n: home[c] for n, c in label.items()}
        merged: dict = defaultdict(dict)
        for n, x in level.items():
            for y, w in x.items():
                a, b = home[n], home[y]
                merged[a][b] = merged[a].get(b, 0.0) + (w / 2 if a == b and n != y else w)
        level = merged
    names = {}
    for n, c in sorted(label.items()):
        names.setdefault(c, n)
    return {n: names[c] for n, c in label.items()}


def louvain_by_component(weights: DataFrame, components: DataFrame, resolution: float = 1.0) -> DataFrame:
    """item and group; each connected component on its own. weights: a, b, weight; components: item, component."""

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        found = louvain(sorted(rows[["a", "b", "weight"]].itertuples(index=False, name=None)), resolution)
        return pd.DataFrame(sorted(found.items()), columns=["item", "group"])

    joined = weights.join(components.select(F.col("item").alias("a"), "component"), "a")
    return joined.groupBy("component").applyInPandas(run, "item string, group string")


def best_fit(items: list[tuple[str, int]], most: int) -> dict[str, int]:
    """Bins of at most most: larger items first, each to the fullest bin with room; a larger item is a bin of its own."""
    bins, place = [], {}
    for name, size in sorted(items, key=lambda x: (-x[1], x[0])):
        fit = [i for i, used in enumerate(bins) if used + size <= most]
        i = max(fit, key=lambda i: (bins[i], -i)) if fit else len(bins)
        if i == len(bins):
            bins.append(0)
        bins[i] += size
        place[name] = i
    return place


def batches(files: DataFrame, most: int) -> DataFrame:
    """area, path, tokens and batch: each area's files packed; files: area, path, tokens."""

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        place = best_fit(list(zip(rows["path"], rows["tokens"].astype(int), strict=True)), most)
        return rows.assign(batch=rows["path"].map(place).astype("int64"))[["area", "path", "tokens", "batch"]]

    return files.groupBy("area").applyInPandas(run, "area string, path string, tokens long, batch long")


def merged_small(sizes: DataFrame, ties: DataFrame, least: int, most: int) -> DataFrame:
    """group and merged: groups below `least` join the group they are most tied to that has room for both in `most`.

    sizes: group, n; ties: a, b, weight. In rounds: every small group asks its best tie,
    of equal ones the smaller, then the lesser name; a group takes those most tied to it,
    while it has room, unless it goes itself; of two that ask each other the lesser stays.
    """
    into, now = sizes.select("group", F.col("group").alias("merged")), cut(sizes.select("group", "n"))
    tied = ties.filter("a <> b").select(F.col("a").alias("g"), F.col("b").alias("h"), "weight").unionByName(ties.filter("a <> b").select(F.col("b").alias("g"), F.col("a").alias("h"), "weight"))
    tied = cut(tied.groupBy("g", "h").agg(F.sum("weight").alias("weight")).filter("weight > 0"))
    while True:
        g, h = now.select(F.col("group").alias("g"), F.col("n").alias("gn")), now.select(F.col("group").alias("h"), F.col("n").alias("hn"))
        room = tied.join(g.filter(F.col("gn") < least), "g").join(h, "h").filter(F.col("gn") + F.col("hn") <= most)
        best = Window.partitionBy("g").orderBy(F.desc("weight"), "hn", "h")
        asks = cut(room.withColumn("_r", F.row_number().over(best)).filter("_r = 1").select("g", "h", "weight", "gn", "hn"))
        if asks.isEmpty():
            return into
        # who stays: of a pair that ask each other the lesser, and everybody that asks nobody
        mutual = asks.select(F.col("h").alias("g"), F.col("g").alias("h"), F.lit(True).alias("_mutual"))
        leaving = asks.join(mutual, ["g", "h"], "left").filter("_mutual is null or g > h")
        free = leaving.join(leaving.select(F.col("g").alias("h"), F.lit(True).alias("_goes")), "h", "left").filter("_goes is null").drop("_goes")
        # where all that are asked go themselves, as in a ring, the least of them stays
        free = free if not free.isEmpty() else leaving.join(leaving.agg(F.min("h").alias("h")), "h")
        first = Window.partitionBy("h").orderBy(F.desc("weight"), "gn", "g").rowsBetween(Window.unboundedPreceding, 0)
        moves = cut(free.withColumn("_full", F.col("hn") + F.sum("gn").over(first)).filter(F.col("_full") <= most).select("g", "h"))
        into = cut(into.join(moves.select(F.col("g").alias("merged"), F.col("h").alias("_h")), "merged", "left").select("group", F.coalesce("_h", "merged").alias("merged")))
        moved = now.join(moves.select(F.col("g").alias("group"), F.col("h").alias("_h")), "group", "left").select(F.coalesce("_h", "group").alias("group"), "n")
        now = cut(moved.groupBy("group").agg(F.sum("n").alias("n")))
        a, b = moves.select("g", F.col("h").alias("_g")), moves.select(F.col("g").alias("h"), F.col("h").alias("_h"))
        tied = cut(tied.join(a, "g", "left").join(b, "h", "left").select(F.coalesce("_g", "g").alias("g"), F.coalesce("_h", "h").alias("h"), "weight").filter("g <> h").groupBy("g", "h").agg(F.sum("weight").alias("weight")))


def partition_check(answers: DataFrame, members: DataFrame) -> DataFrame:
    """key, missing, repeated and unknown of each answer that should split its members; answers, members: key, member."""
    given = answers.groupBy("key", "member").agg(F.count("*").alias("n"))
    both = members.select("key", "member", F.lit(True).alias("_known")).join(given, ["key", "member"], "full_outer")
    return both.groupBy("key").agg(F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("_known").isNull()).alias("unknown"))


def placed_by_overlap(left: DataFrame, groups: DataFrame) -> DataFrame:
    """Each left-out member goes to the group that holds most of its candidate; left: member, candidate; groups: group, member, candidate."""
    # a candidate's members are counted by group before they meet: a row a group, not a row a member
    own, held = left.groupBy("candidate", "member").agg(F.count("*").alias("_l")), groups.groupBy("candidate", "group").agg(F.count("*").alias("_g"))
    counts = own.join(held, "candidate").groupBy("member", "group").agg(F.sum(F.col("_l") * F.col("_g")).alias("n"))
    return counts.groupBy("member").agg(F.max_by("group", F.struct("n", F.expr("-group"))).alias("group"))
