"""Operators on small literals, where the plain tables cannot show a case."""

import ast

import pyarrow as pa
from loomgrid.functions import source_facts, text
from loomgrid.operators import account, cluster, graph, scan, sequence, tree
from loomgrid.streaming import events
from pyspark.sql import functions as F


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


def test_canonical_path(spark):
    cases = {"a/./b//c": "a/b/c", "a/../b": "b", "../a": None, "/a": None, "C:\\a": None, "a\\b": "a/b", "": None, "a/..": None, "a/../../b": None}
    rows = spark.createDataFrame([(k,) for k in cases], "p string").select("p", scan.canonical_path(F.col("p")).alias("c")).collect()
    assert {r.p: r.c for r in rows} == cases


def test_language_of_last_registration(spark):
    files = spark.createDataFrame([("a.PY",), ("b.xyz",), ("Makefile",)], "path string")
    reg = spark.createDataFrame([(".py", "old", 0), (".py", "new", 1)], "suffix string, language string, ordinal int")
    assert {r.path: r.language for r in scan.with_language(files, reg).collect()} == {"a.PY": "new", "b.xyz": "xyz", "Makefile": ""}


def test_excluded_folders_and_tests(spark):
    assert not one(spark, scan.included, "a/node_modules/b.js") and one(spark, scan.included, "src/venv")
    assert one(spark, scan.is_test, "tests/a.py") and one(spark, scan.is_test, "src/test_a.py") and not one(spark, scan.is_test, "src/contest.py")


def test_read_tree(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 1\n")
    rows = scan.read_tree(spark, str(tmp_path)).collect()
    assert [(r.path.rsplit("/", 1)[-1], r.bytes, bytes(r.content)) for r in rows] == [("a.py", 6, b"x = 1\n")]


def test_spans_merge_when_adjacent(spark):
    spans = spark.createDataFrame([("a", 1, 3), ("a", 4, 6), ("a", 8, 9), ("a", 2, 5), ("b", 1, 1)], "path string, start_line long, end_line long")
    assert sorted(map(tuple, sequence.merge_spans(spans, "path").collect())) == [("a", 1, 6), ("a", 8, 9), ("b", 1, 1)]


def test_byte_offsets_of_wide_letters(spark):
    files = spark.createDataFrame([("a", "ß\n🎉x\n")], "path string, source string")
    assert sorted(map(tuple, sequence.lines(files).collect())) == [("a", 1, "ß", 0, 3), ("a", 2, "🎉x", 3, 9), ("a", 3, "", 9, 10)]


def test_owner_of_lines(spark):
    ranges = spark.createDataFrame([("a.py", "A", 0, 40, 0), ("b.py", "B", 0, 40, 1), ("a.py", "C", 40, 60, 2)], "path string, range_id string, start_byte long, end_byte long, ordinal int")
    points = spark.createDataFrame([("a.py", 12), ("a.py", 40), ("a.py", 60), ("b.py", 14)], "path string, point long")
    assert {(r.path, r.point): r.owner for r in sequence.owner_of_points(points, ranges, width=16).collect()} == {("a.py", 12): "A", ("a.py", 40): "C", ("b.py", 14): "B"}


def test_slices_are_one_hop(spark):
    nodes = spark.createDataFrame([("a", "a.py"), ("b", "b.py"), ("c", "c.py")], "id string, path string")
    edges = spark.createDataFrame([("e1", "a", "b", "import"), ("e2", "b", "c", "call")], "id string, source string, target string, kind string")
    n, e = graph.slice_of(nodes, edges, paths=["a.py"], direction="out")
    assert {r.id for r in n.collect()} == {"a", "b"} and {r.id for r in e.collect()} == {"e1"}
    n, e = graph.slice_of(nodes, edges, kind="call")
    assert {r.id for r in n.collect()} == {"b", "c"} and {r.id for r in e.collect()} == {"e2"}
    n, e = graph.slice_of(nodes, edges, paths=["none.c"])
    assert n.count() == 0 and e.count() == 0


def test_capabilities_first_of_equal_rank(spark):
    rows = spark.createDataFrame([("c", "call", "empty", 0), ("c", "call", "not_requested", 1), ("c", "import", "failed", 2)], "language string, graph string, status string, ordinal int")
    wanted = spark.createDataFrame([("c", "call"), ("c", "import"), ("c", "cfg")], "language string, graph string")
    assert {r["graph"]: r.status for r in graph.merged_capabilities(rows, wanted).collect()} == {"call": "empty", "import": "failed", "cfg": "unavailable"}


def test_cycles_end(spark):
    nodes = spark.createDataFrame([("r", None), ("a", "r"), ("x", "y"), ("y", "x")], "id string, parent string")
    assert {r.id for r in tree.paths(nodes).collect()} == {"r", "a"}


def test_chunks_reset(spark):
    rows = spark.createDataFrame([("k", i, c) for i, c in enumerate([5, 5, 1, 20, 3])], "k string, i int, c long")
    got = {r.i: r.chunk for r in sequence.budget_chunks(rows, "k", "i", "c", 10, 3).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 2, 4: 3}


def test_communities():
    ring = [(f"{g}{i}", f"{g}{(i + d) % 14}", 1.0) for g in "abcd" for i in range(14) for d in (1, 2, 3)]
    found = cluster.louvain(ring + [("a0", "b0", 0.1), ("b1", "c1", 0.1)])
    assert len(set(found.values())) == 4 and all(len({found[f"{g}{i}"] for i in range(14)}) == 1 for g in "abcd")
    assert found == cluster.louvain(list(reversed(ring)) + [("b1", "c1", 0.1), ("a0", "b0", 0.1)])


def test_packing():
    place = cluster.best_fit([("a", 6), ("b", 5), ("c", 4), ("d", 30)], 10)
    assert place["a"] == place["c"] != place["b"] and place["d"] not in (place["a"], place["b"])


def test_python_facts():
    source = "LIMIT = 3\nclass Pool:\n    def take(self, n=1, *, wait=True):\n        raise ValueError('no')\n"
    assert [x[:3] for x in source_facts.facts(source)] == [("constant", "LIMIT", "3"), ("param_default", "Pool.take", "n=1"), ("param_default", "Pool.take", "wait=True"), ("raise", "Pool.take", "ValueError('no')")]
    assert source_facts.declarations(source) == [("class", "Pool", 2, 4), ("method", "Pool.take", 3, 4)]
    assert source_facts.facts("def (") == []


def test_long_sources_are_parsed_in_pieces(spark, monkeypatch):
    """No tree of a whole long source is held, and its facts are those of the whole."""
    part = 'def f{0}(a, b={0}):\n    if a:\n        raise ValueError(b)\ntry:\n    X{0} = """\ndef no(c=1): pass\n"""\nfinally:\n    pass\n@d\nclass C{0}:\n    def g(self, *, k={0}):\n        pass\n'
    source, parse, seen = "LIMIT = 3\r\n" + "".join(part.format(i) for i in range(3000)), ast.parse, []
    monkeypatch.setattr(source_facts, "PIECE", len(source))
    want = source_facts.facts(source), source_facts.declarations(source)
    monkeypatch.setattr(source_facts, "PIECE", 100)
    monkeypatch.setattr(source_facts.ast, "parse", lambda x: seen.append(len(x)) or parse(x))
    assert (source_facts.facts(source), source_facts.declarations(source)) == want and len(want[0]) == 12_001 and len(want[1]) == 9_000
    assert max(seen) < 2_000 < len(source)
    assert source_facts.facts(source + "else:\n  pass\n") == source_facts.declarations(source + "x = (") == []
    got = source_facts.python_facts(spark.createDataFrame([("p", source), ("q", None), ("r", "def (")], "path string, source string")).collect()
    assert [tuple(r)[1:] for r in got] == want[0] and {r.path for r in got} == {"p"}


def test_texts_reach_python_in_small_batches(spark):
    """Counting tokens holds a few texts at a time, not thousands."""
    own = spark.newSession()
    texts = own.range(0, 400, 1, 1).selectExpr("cast(id as string) as path", "case when id > 0 then repeat('word ', 10000) end as source")
    counts = source_facts.token_counts(texts, "/opt/tokenizers/byte_bpe_50k.tiktoken")
    assert {(r.path == "0", r.tokens > 9_999) for r in counts.collect()} == {(True, False), (False, True)} and counts.filter("path = 0").first().tokens == 0

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"size": [b.nbytes]})

    assert texts.mapInArrow(sizes, "size long").agg(F.max("size")).first()[0] < 2 * source_facts.BATCH_BYTES


def test_texts(spark):
    assert one(spark, text.summary_sentence, "First one. Second.") == "First one."
    assert one(spark, text.summary_sentence, "See e.g. the map. More.") == "See e.g. the map." and one(spark, text.summary_sentence, "no end\nhere") == "no end"
    assert one(spark, text.word_tokens, "parseHTTPHeaders and classes") == ["parse", "http", "header", "classe"]
    assert [one(spark, text.short_name, x) for x in ("a::b::c", "grp:x", "plain")] == ["b::c", "x", "plain"]
    assert one(spark, text.fenced, "a``b") == "``` a``b ```"
    got = one(spark, lambda c: text.mentions(c, F.array(F.lit("Loader"))), "see `Pool.take` and run_all(x), Loader, _private")
    assert (got.ticks, got.code, got.names) == (["Pool", "take"], ["run_all"], ["Loader"])
    assert one(spark, source_facts.casefolded, "Straße") == "strasse"
    assert one(spark, lambda c: text.first_words(c, 2), "a b c") == "a b…"


def test_unknown_cost_is_unknown(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0)], "t string, usd double")
    assert {r.t: r.usd for r in rows.groupBy("t").agg(account.sum_if_complete(F.col("usd")).alias("usd")).collect()} == {"a": None, "b": 2.0}


def test_stream_counts_once(spark, small, tmp_path):
    stream = events.windowed_counts(events.read_events(spark, f"{small}/events.parquet"))
    got = events.run_once(stream, "windowed_test", "complete", str(tmp_path))
    assert got.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{small}/events.parquet").count()
