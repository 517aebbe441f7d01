"""Prose and code of Markdown, and small analyzer payloads."""

import json
import random

from loomgrid.functions import prose
from loomgrid.operators import payload

CASES = [
    ("see [a](b)", "see [a]\\(b)"), ("`[a](b)` [a](b)", "`[a](b)` [a]\\(b)"), ("``x` [a](b)`` ](", "``x` [a](b)`` ]\\("), ("one ` two [a](b)", "one ` two [a]\\(b)"), ("` a\n\n](b) `", "` a\n\n]\\(b) `"), ("`a\n](b)` ](c)", "`a\n](b)` ]\\(c)"),
    ("```py\n](x)\n```\n](y)", "```py\n](x)\n```\n]\\(y)"), ("```\n](x)\n~~~\n](y)\n````  \n](z)", "```\n](x)\n~~~\n](y)\n````  \n]\\(z)"), ("~~~ a`b\n](x)\n~~~~\n](y)", "~~~ a`b\n](x)\n~~~~\n]\\(y)"), ("``` a`b\n](x)", "``` a`b\n]\\(x)"),
    ("    ](code)\n](prose)\n    ](still prose)", "    ](code)\n]\\(prose)\n    ]\\(still prose)"), ("\t](code)\n\n    ](code)", "\t](code)\n\n    ](code)"), ("   ```\n](x)\n    ```\n](y)", "   ```\n](x)\n    ```\n](y)"), ("```\n](x)\n``` no\n](y)", "```\n](x)\n``` no\n](y)"),
    ("", ""), ("\n\n", "\n\n"), ("a\r\n](b)\r\n", "a\r\n]\\(b)\r\n"), ("`a`](b)`c`", "`a`]\\(b)`c`"), ("`` ` `` ](b) ` ``", "`` ` `` ]\\(b) ` ``"),
]


def test_links_of_prose(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)] + [(-1, None)], "i int, t string")
    got = {r.i: (r.a, r.b) for r in df.select("i", prose.literal_links(df.t).alias("a"), prose.prose_only(df.t).alias("b")).collect()}
    assert {i: got[i][0] for i in range(len(CASES))} == {i: want for i, (_, want) in enumerate(CASES)}
    assert got[-1] == (None, None) and got[1][1] == " [a](b)" and got[6][1] == "](y)" and got[10][1] == "](prose)\n    ](still prose)"


def test_pieces_are_the_text():
    """Also in time linear in the number of backticks."""
    rng = random.Random(5)
    for _ in range(500):
        text = "".join(rng.choice(["`", "``", "```", "~~~", "\n", "\n\n", "    ", "a", " ", "]("]) for _ in range(rng.randint(0, 30)))
        assert "".join(p for _, p in prose.pieces(text)) == text
    many = " ".join("`" * (1 + i % 700) for i in range(20_000))
    assert "".join(p for _, p in prose.pieces(many)) == many


def normalised(spark, body, files):
    df = spark.createDataFrame([("cpg", json.dumps(body) if isinstance(body, dict) else body)], "namespace string, payload string")
    nodes, edges, omitted = payload.normalised(df, spark.createDataFrame([(f,) for f in files], "path string"))
    return {r.id: r for r in nodes.collect()}, {r.id: r for r in edges.collect()}, {r.what: r["count"] for r in omitted.collect()}


def test_places_that_are_no_source_file(spark):
    """Methods that an analyzer makes up keep their identity without an invented place."""
    for bad in ("demo", "<empty>", "go.mod"):
        body = {
            "methods": [{"nodeId": 1, "file": bad, "name": "<clinit>", "fullName": "demo.<clinit>"}, {"nodeId": 2, "file": "demo.go", "name": "helper", "fullName": "demo.helper"}],
            "cfg": [{"methodId": 1, "file": bad, "nodes": [{"i": 0, "nodeId": 3}], "edges": []}], "reachingDefs": [{"source": {"nodeId": 4, "file": bad}, "target": {"nodeId": 5, "file": "demo.go"}}],
        }
        nodes, edges, omitted = normalised(spark, body, ["demo.go", "go.mod"])
        assert {i for i, n in nodes.items() if n.path is None} == {"cpg/method/1", "cpg/cfg/1/0", "cpg/dfn/4"} and nodes["cpg/method/2"].path == "demo.go"
        assert (len(nodes), len(edges), omitted) == (5, 1, {"unknown_node_location": 3})


def test_a_payload(spark):
    call = lambda n, **more: {"nodeId": n, "callerFile": "a.ts", "callerId": 1, "caller": "f", "line": 3, "name": "g", "code": "g()", "methodFullName": "x.g", **more}
    body = {
        "methods": [{"nodeId": 1, "file": "./a.ts", "line": 1, "name": "f", "fullName": "a.f"}, {"nodeId": 2, "file": "a.ts", "line": 9, "name": "plain", "fullName": "plain"}],
        "calls": [call(10), call(11, callerId=None, line=4), call(12, name="<operator>.add"), call(13, name="require"), call(14, code="_tmp_1.push(a)"), call(15, callerId=77)],
        "imports": [{"nodeId": 20, "file": "a.ts", "line": 3, "code": "import x"}, {"nodeId": 21, "file": "a.ts", "line": 5, "code": "<empty>"}, {"nodeId": 22, "file": "gone.ts", "line": 5, "code": "import y"}],
        "cfg": [{"methodId": 1, "file": "a.ts", "nodes": [{"i": 0, "line": 1, "label": "A"}, {"i": 1, "line": 2, "label": "B"}], "edges": [{"from": 0, "to": 1}, {"from": 1, "to": 7}]}],
        "dataflowPaths": [{"methodId": 1, "sampled": True, "elements": [{"nodeId": i, "file": "a.ts", "line": i, "label": f"v{i}"} for i in (30, 31, 32)]}], "callsWithoutOwner": 4,
    }
    nodes, edges, omitted = normalised(spark, body, ["a.ts"])
    assert {i: n.kind for i, n in nodes.items()} == {
        "cpg/method/1": "method", "cpg/method/2": "function", "cpg/caller/a.ts:4:f": "function", "cpg/caller/a.ts:3:f": "function", "cpg/cfg/1/0": "cfg_node", "cpg/cfg/1/1": "cfg_node", "file:a.ts": "file",
        "cpg/dfn/30": "dataflow_node", "cpg/dfn/31": "dataflow_node", "cpg/dfn/32": "dataflow_node",
    }
    assert nodes["cpg/cfg/1/0"].owner == "cpg/method/1" and nodes["cpg/method/1"].path == "a.ts"
    assert {i: (e.source, e.target, e.kind) for i, e in edges.items()} == {
        "cpg/call/10": ("cpg/method/1", None, "call"), "cpg/call/11": ("cpg/caller/a.ts:4:f", None, "call"), "cpg/call/15": ("cpg/caller/a.ts:3:f", None, "call"), "cpg/cfgedge/1/0->1": ("cpg/cfg/1/0", "cpg/cfg/1/1", "cfg"),
        "cpg/import/20": ("file:a.ts", None, "import"), "cpg/import/22": (None, None, "import"), "cpg/vfp/1/1": ("cpg/dfn/30", "cpg/dfn/31", "dataflow"), "cpg/vfp/1/2": ("cpg/dfn/31", "cpg/dfn/32", "dataflow"),
    }
    assert omitted == {"call:import_statement": 1, "call:synthetic": 1, "cfg_edge_without_node": 1, "calls_without_owner": 4}
    assert normalised(spark, '{"methods": [', ["a.ts"]) == ({}, {}, {"unreadable": 1})
    assert normalised(spark, {}, []) == ({}, {}, {})


def test_numstat(spark):
    from loomgrid.functions.numstat import numstat

    blocks = ["a1\tone: two\0\n3\t4\tx.py\0" + "1\t0\t\0old\tname\0new name\0" + "-\t-\tlogo.png\0" + "2\t2\tx.py\0", "b2\tempty", "c3\t\0\n0\t0\tz\n9\0junk\0" + "5\t1\t\0gone", None]
    got = sorted(map(tuple, numstat(spark.createDataFrame([(b,) for b in blocks], "block string")).collect()))
    assert got == [("a1", "one: two", "new name", 1, "old\tname"), ("a1", "one: two", "x.py", 11, None), ("c3", "", "", 6, "gone"), ("c3", "", "z\n9", 0, None)]
