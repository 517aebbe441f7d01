"""Pointer jumping on large and broken trees, and coordinates of texts beyond ASCII."""

import random

from pyspark.sql import functions as F

from loomgrid.operators import coordinates, sequence, tree


def walked(parent):
    """state, root, depth and cycle of every node, by walking up from each."""
    out = {}
    for n in parent:
        seen, x = [], n
        while x is not None and x in parent and x not in seen:
            seen.append(x)
            x = parent[x]
        if x is None:
            out[n] = ("reached", seen[-1], len(seen) - 1, None)
        elif x not in parent:
            out[n] = ("lost", None, None, None)
        else:
            ring = seen[seen.index(x) :]
            out[n] = ("cycle" if n in ring else "below", None, None, min(ring))
    return out


def test_reach_of_random_forests(spark):
    rng = random.Random(3)
    parent = {}
    for block in range(12):
        base, size = block * 1000, rng.choice([1, 2, 7, 40, 120])
        for i in range(size):
            kind = rng.random()
            parent[base + i] = None if i == 0 and block % 3 else -1 - base - i if kind < 0.02 else base + (i - 1 if block % 4 == 0 and i else rng.randrange(size) if kind < 0.1 or i == 0 else rng.randrange(i))
    df = spark.createDataFrame(list(parent.items()), "id long, parent long")
    want = walked(parent)
    assert len({w[0] for w in want.values()}) == 4
    assert {r.id: (r.state, r.root, r.depth, r.cycle) for r in tree.reach(df).collect()} == want
    paths = {r.id: (r.path, r.depth) for r in tree.paths(df).collect()}
    assert paths.keys() == {n for n, w in want.items() if w[0] == "reached"}
    assert all(p[0] == want[n][1] and p[-1] == n and d == want[n][2] and all(parent[b] == a for a, b in zip(p, p[1:], strict=False)) for n, (p, d) in paths.items())
    stops = [n for n in parent if n % 3 == 0]

    def near(n):
        x, depth, seen = parent[n], 0, set()
        while x in parent and x not in stops and x not in seen:
            seen.add(x)
            x, depth = parent[x], depth + 1
        return (x, depth) if x in parent and x in stops else None

    got = {r.id: (r.target, r.depth) for r in tree.nearest(df, spark.createDataFrame([(s,) for s in stops], "id long")).collect()}
    assert got == {n: near(n) for n in parent if parent[n] is not None and near(n)}
    assert tree.reach(df.limit(0)).count() == tree.paths(df.limit(0)).count() == 0


def test_a_million_nodes_and_a_cycle(spark):
    """Also a chain of 3,000, far deeper than recursion would go."""
    n = 1_000_000
    rows = spark.range(n).select("id", F.when(F.col("id") == 0, None).when(F.col("id") < 3000, F.col("id") - 1).when(F.col("id") == 900_000, 900_002).when(F.col("id").isin(900_001, 900_002), F.col("id") - 1).otherwise(F.expr("id div 7")).alias("parent"))
    got = {r.state: (r.n, r.deep) for r in tree.reach(rows).groupBy("state").agg(F.count("*").alias("n"), F.max("depth").alias("deep")).collect()}
    assert got["cycle"] == (3, None) and got["reached"] == (n - 3, 3001)


TEXTS = {"a": "x = 1\n\t é = 'ß🎉'\n\n  last", "b": "", "c": "\n", "d": "äö\r\nü\rz\n", "e": "no break", "f": None, "long": "ab🎉" * 30_000 + "\nend"}


def test_points_of_coordinates(spark):
    """Against slices of the texts themselves, at every line and column and beyond."""
    files = spark.createDataFrame(list(TEXTS.items()), "path string, source string")
    want, asked = {}, []
    for path, text in TEXTS.items():
        lines = (text or "").split("\n")
        for no in range(0, len(lines) + 2):
            own = lines[no - 1] + ("\n" if no < len(lines) else "") if 1 <= no <= len(lines) else None
            for column in [None, 0, -1, *range(1, min(len(own or ""), 20) + 4), len(own or "") + 1, len(own or "") + 2]:
                asked.append((path, no, column))
                if text is None or own is None:
                    continue
                start = len("\n".join(lines[: no - 1]).encode()) + (no > 1)
                if column is None:
                    want[path, no, None] = start + len(own) - len(own.lstrip(" \t"))
                elif 1 <= column <= len(own) + 1:
                    want[path, no, column] = start + len(own[: column - 1].encode())
    index = coordinates.line_index(files)
    got = coordinates.points(spark.createDataFrame(sorted(set(asked), key=repr), "path string, line long, column long"), index)
    assert {(r.path, r.line, r.column): r.point for r in got.collect()} == want
    assert index.filter("path = 'long' and line_no = 1").select(F.length("wide")).first()[0] == 90_001


def test_characters_of_bytes(spark):
    files = spark.createDataFrame(list(TEXTS.items()), "path string, source string")
    want = {}
    for path, text in TEXTS.items():
        if text is not None:
            each = [i for i, c in enumerate(text) for _ in c.encode()] + [len(text)]
            want |= {(path, b): c for b, c in list(enumerate(each))[-40:]}
    asked = spark.createDataFrame([*want, ("a", 10**6), ("a", -1), ("zz", 0)], "path string, point long")
    assert {(r.path, r.point): r.char for r in coordinates.chars_of_bytes(asked, coordinates.line_index(files)).collect()} == want


def test_lines_end_with_any_break(spark):
    files = spark.createDataFrame([(k, v) for k, v in {**TEXTS, "mix": "a\r\n\r\nb\r\rc\n\rd\r"}.items()], "path string, source string")
    got = {}
    for r in coordinates.line_index(files, any_break=True).select("path", "line_no", "start_char").collect():
        got.setdefault(r.path, {})[r.line_no] = r.start_char
    text = "a\r\n\r\nb\r\rc\n\rd\r"
    starts = [0] + [i + 1 for i, c in enumerate(text) if c == "\n" or (c == "\r" and text[i + 1 : i + 2] != "\n")]
    assert [got["mix"][i] for i in sorted(got["mix"])] == starts and got["d"] == {1: 0, 2: 4, 3: 6, 4: 8} and got["b"] == {1: 0} and "f" not in got
    assert [(r.line_no, r.line, r.start_byte, r.end_byte) for r in sequence.lines(files.filter("path = 'a'")).collect()][1] == (2, "\t é = 'ß🎉'", 6, 22)


def test_owners_of_edges(spark):
    """A call's own place, another edge's source, or the owner of that."""
    nodes = spark.createDataFrame([("m", "a", 1, None), ("n", "a", 2, "m"), ("o", "c", 1, "gone")], "id string, path string, start_line long, owner string")
    edges = spark.createDataFrame([("1", "call", "n", None, 2, 3), ("2", "cfg", "n", "c", 9, 9), ("3", "cfg", "o", None, None, None), ("4", "call", "x", None, 1, 1), ("5", "call", "m", "c", 2, None)], "id string, kind string, source string, path string, line long, column long")
    got = {r.id: (r.path, r.line, r.column) for r in coordinates.edge_coordinates(edges, nodes).collect()}
    assert got == {"1": ("a", 2, 3), "2": ("a", 1, None), "3": ("c", 1, None), "4": (None, 1, 1), "5": ("c", 2, None)}
    files = spark.createDataFrame(list(TEXTS.items()), "path string, source string")
    ranges = spark.createDataFrame([("a", "a#2", 0, 100, 2), ("a", "a#1", 5, 12, 1), ("c", "c#0", 0, 1, 0)], "path string, range_id string, start_byte long, end_byte long, ordinal long")
    found = coordinates.owners(coordinates.edge_coordinates(edges, nodes), coordinates.line_index(files), ranges)
    assert {r.id: r.owner for r in found.collect()} == {"1": "a#1", "2": "a#2", "3": "c#0"}


def test_nodes_without_an_owner_do_not_meet_in_one_task(spark):
    """Edges, most of whose nodes have no owner, are not dealt by that owner; what they stand at is the same."""
    from loomgrid.operators import coordinates

    nodes = spark.range(4000).selectExpr("'n' || id as id", "'p' || (id % 50) as path", "cast(id as int) as start_line", "case when id % 100 = 1 then 'n' || (id - 1) when id % 100 = 2 then 'gone' end as owner")
    edges = spark.range(4000).selectExpr("id", "if(id % 2 = 0, 'call', 'import') as kind", "'n' || (id + if(id % 100 = 0, 1, 0)) as source", "cast(null as string) as path", "7 as line", "3 as column")
    found = coordinates.edge_coordinates(edges, nodes)
    own = {r.id: r for r in nodes.collect()}
    for r in found.collect():
        node = own[f"n{r.id + (r.id % 100 == 0)}"]
        at = node if r.id % 2 == 0 else own.get(node.owner, node)
        assert (r.path, r.line, r.column) == (at.path, 7 if r.id % 2 == 0 else at.start_line, 3 if r.id % 2 == 0 else None)
    assert found.count() == 4000
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # the join by owner takes the nodes that have one, and no edges
    assert plan.count("Join LeftOuter") == 2 and "Union" in plan.split("Join LeftOuter")[1]
