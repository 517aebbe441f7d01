"""Merging small groups in rounds, against the same rules in plain Python."""

import random
from collections import defaultdict

from loomgrid.operators import cluster


def merged(sizes, ties, least, most):
    """Rounds of asking: each small group its best tie with room; who is asked by several takes the most tied while it has room."""
    size, into, tie = dict(sizes), {g: g for g, _ in sizes}, defaultdict(float)
    for a, b, w in ties:
        if a != b:
            tie[a, b] += w
            tie[b, a] += w
    while True:
        asks = {}
        for g, n in size.items():
            room = [(-w, size[h], h) for (x, h), w in tie.items() if x == g and h in size and w > 0 and n + size[h] <= most]
            if n < least and room:
                asks[g] = min(room)
        if not asks:
            return into
        leaving = {g: a for g, a in asks.items() if not (asks.get(a[2], (0, 0, None))[2] == g and g < a[2])}
        free = {g: a for g, a in leaving.items() if a[2] not in leaving} or {g: a for g, a in leaving.items() if a[2] == min(x[2] for x in leaving.values())}
        for h in {a[2] for a in free.values()}:
            room = most - size[h]
            for _, n, g in sorted((a[0], size[g], g) for g, a in free.items() if a[2] == h):
                room -= n
                if room < 0:
                    break
                into = {k: h if v == g else v for k, v in into.items()}
                size[h] += size.pop(g)
                for (x, y), w in list(tie.items()):
                    if x == g:
                        del tie[x, y], tie[y, x]
                        if y != h:
                            tie[h, y] += w
                            tie[y, h] += w


def test_small_groups_join_their_best_tie(spark):
    sizes = spark.createDataFrame([("a", 1), ("b", 1), ("c", 9), ("d", 2), ("e", 2), ("f", 20), ("g", 1), ("h", 2)], "group string, n long")
    ties = spark.createDataFrame([("a", "b", 5.0), ("b", "c", 2.0), ("d", "c", 3.0), ("e", "c", 2.0), ("g", "f", 9.0), ("g", "c", 1.0)], "a string, b string, weight double")
    got = {r.group: r.merged for r in cluster.merged_small(sizes, ties, 4, 15).collect()}
    # a and b ask each other, f has no room for g, d, e and g fill c, h is tied to none
    assert got == {"a": "a", "b": "a", "c": "c", "d": "c", "e": "c", "f": "f", "g": "c", "h": "h"}
    total = defaultdict(int)
    for r in sizes.collect():
        total[got[r.group]] += r.n
    assert max(v for k, v in total.items() if k != "f") <= 15
    ring = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0), ("c", "a", 3.0)], "a string, b string, weight double")
    three = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "group string, n long")
    assert len({r.merged for r in cluster.merged_small(three, ring, 3, 9).collect()}) == 1


def test_merges_of_random_groups(spark):
    rng = random.Random(6)
    sizes = [(f"g{i:02}", rng.randint(1, 9)) for i in range(30)]
    ties = [(f"g{rng.randrange(30):02}", f"g{rng.randrange(30):02}", float(rng.randint(1, 4))) for _ in range(60)]
    got = cluster.merged_small(spark.createDataFrame(sizes, "group string, n long"), spark.createDataFrame(ties, "a string, b string, weight double"), 6, 20)
    assert {r.group: r.merged for r in got.collect()} == merged(sizes, ties, 6, 20)


def test_a_tail_into_a_ring_ends(spark):
    """All that are asked go themselves, and the least group is asked by none."""
    sizes = [("a", 1), ("b", 1), ("c", 1), ("d", 1)]
    ties = [("a", "b", 1.0), ("b", "c", 2.0), ("c", "d", 3.0), ("d", "b", 2.5)]
    got = cluster.merged_small(spark.createDataFrame(sizes, "group string, n long"), spark.createDataFrame(ties, "a string, b string, weight double"), 9, 9)
    assert {r.group: r.merged for r in got.collect()} == merged(sizes, ties, 9, 9)
