"""Connected components of a graph given by its links, by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.ordered import cut

#: Links that a task joins at once.
HELD = 200_000


def _contracted(links: DataFrame) -> DataFrame:
    """a and b, the least node that links of the same part of a task connect it to."""

    def forest(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        for a, b in pairs:
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
        found = [(x, root(x)) for x in list(up)]
        a, b = zip(*(x for x in found if x[0] != x[1]), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int]] = []
        for batch in batches:
            held += zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)
            if len(held) >= HELD:
                yield forest(held)
                held = []
        if held:
            yield forest(held)

    return links.filter("a <> b").select("a", "b").mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """node and root, the least node it is connected to, for each node of the links (a, b), two long columns.

    Each task first joins its own links. Then large stars link every higher neighbour
    of a node to its least neighbour, small stars every lower one, until only links
    to roots are left. Nothing is gathered: the driver sees whether a round was the last.
    """
    edges = cut(_contracted(links))
    while True:
        # a star forest: each node has one link, and no root has any
        ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("top")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("top")))
        if ends.groupBy("node").agg(F.sum("up").alias("n"), F.max("top").alias("top")).filter("n > 1 or n = 1 and top = 1").isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        met = large.join(low, "a")
        small = met.select("a", F.col("m").alias("b")).unionByName(met.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        edges = cut(small.distinct())
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
