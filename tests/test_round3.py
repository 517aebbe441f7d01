"""Faults of queries that larger tables and odd rows have shown."""

import duckdb

from loomgrid import plans


def against_sql(spark, name, d, *tables):
    """Sorted rows of a query and of its SQL over the tables of a folder."""
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet/*.parquet'")
    want = con.sql(plans.ORACLE[name])
    got = plans.QUERIES[name](spark, str(d)).select(*want.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    return sorted(map(tuple, got.collect()), key=key), sorted(want.fetchall(), key=key)


def test_branch_caps_of_words_beside_umlauts_and_of_no_language(spark, tmp_path):
    rows = [(1, "sagt dieöau", "de"), (2, "und die Sonne", "de"), (3, "dieb", "de"), (4, "die", None), (5, None, "de"), (6, "x", "fr"), (7, "ödie_", "de"), (8, "a\nThe b", "en")]
    spark.createDataFrame([(i, t, g, "s", len(t or "")) for i, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got, want = against_sql(spark, "branch_caps", tmp_path, "documents")
    assert got == want and {r[0]: r[2] for r in got} == {1: 100, 2: 100, 3: 60, 4: 60, 5: 60, 6: 100, 7: 60, 8: 100}


def test_calls_of_one_id_ask_for_their_own_callees(spark):
    """Facts are looked up once for each distinct list of callees, not once for each id."""
    from loomgrid.operators import calls

    none = lambda ddl: spark.createDataFrame([], ddl)
    methods = spark.createDataFrame([(i, f"m{i}", f"p.m{i}", "a.java") for i in range(4)], "node_id long, name string, full_name string, file string")
    rows = [("x", [(0, None, False)]), ("x", [(1, None, False), (2, None, False)]), ("x", [(0, None, False)]), ("y", [])]
    asked = spark.createDataFrame([(i, 3, "a.java", "any", "n", "", c) for i, c in rows], "id string, caller_id long, caller_file string, full_name string, name string, code string, callees array<struct<node_id:long,full_name:string,external:boolean>>")
    got = calls.resolve(asked, methods, none("full_name string, name string, file string, inherits array<string>"), none("path string"), none("module string"), none("name string"))
    assert sorted((r.id, r.basis, r.n_targets, r.target or -1) for r in got.collect()) == [("x", "callee", 1, -1), ("x", "callee", 2, -1), ("y", "none", 0, -1)]


def test_overlap_of_a_large_candidate_meets_groups_not_members(spark):
    """A candidate with 200,000 members on each side: 40 billion pairs of members, two of a member and a group."""
    from loomgrid.operators import cluster

    left = spark.range(200_000).selectExpr("id as member", "'c' as candidate")
    groups = spark.range(200_000).selectExpr("if(id % 3 = 0, 1, 2) as `group`", "id as member", "'c' as candidate")
    got = cluster.placed_by_overlap(left, groups).groupBy("group").count().collect()
    assert [tuple(r) for r in got] == [(2, 200_000)]


def test_jaccard_pairs_do_not_meet_on_an_item_of_all_sets(spark):
    """One item is in 200,000 sets, which are else apart: 20 billion pairs share it, none is alike but the two at the end."""
    from loomgrid.operators import text_match

    sets = spark.range(200_000).selectExpr("id", "explode(array(-1, 4 * id, 4 * id + 1, 4 * id + 2)) as item")
    more = spark.createDataFrame([(i, x) for i in (900_001, 900_002) for x in (-1, -2, -3)] + [(900_002, -4)], "id long, item long")
    assert [tuple(r) for r in text_match.jaccard_pairs(sets.unionByName(more)).collect()] == [(900_001, 900_002, 0.75)]


def test_payload_texts_are_read_once(spark):
    """What is made of payloads comes from stored lists, none of it reads a text again."""
    from loomgrid.operators import payload

    texts = spark.createDataFrame([("n", '{"methods": [{"nodeId": 1, "file": "a.py", "line": 2, "name": "f", "fullName": "m.f"}], "callsWithoutOwner": 2}'), ("n", "{")], "namespace string, payload string")
    nodes, edges, omitted = payload.normalised(texts, spark.createDataFrame([("a.py",)], "path string"))
    assert not any("from_json" in df._jdf.queryExecution().optimizedPlan().toString() for df in (nodes, edges, omitted))
    assert [tuple(r) for r in nodes.collect()] == [("n/method/1", "method", "a.py", 2, "m.f", None)] and edges.count() == 0
    assert sorted(map(tuple, omitted.collect())) == [("n", "calls_without_owner", 2), ("n", "unreadable", 1)]


def test_modularity_of_labels_is_that_of_shares_of_one(spark):
    """A weight meets its ends once for all replicates; the results are those of the general form."""
    from loomgrid.operators import account

    weights = spark.range(60).selectExpr("concat('i', id % 7) as a", "concat('i', (id * 5 + 1) % 11) as b", "cast(1 + id % 3 as double) as weight")
    labels = spark.range(33).selectExpr("id div 11 - 1 as replicate", "concat('i', id % 11) as item", "concat('g', (id * id) % 4) as `group`")
    rounded = lambda df: sorted((r.replicate, round(r.q, 9)) for r in df.collect())
    got = rounded(account.modularity_of_labels(weights, labels))
    assert len(got) == 3 and got == rounded(account.modularity_of_replicates(weights, account.hard(labels)))


def test_equal_declarations_are_resolved_once(spark, monkeypatch):
    """1,000 rows of one declaration ask as one row; each has its result."""
    from loomgrid.operators import imports

    asked, seen = imports.asked, []
    monkeypatch.setattr(imports, "asked", lambda rows, roots: seen.append(rows.count()) or asked(rows, roots))
    rows = spark.range(1_000).selectExpr("concat('d', id) as id", "'a/b.rb' as path", "'require_relative \"c\"' as expression").unionByName(spark.createDataFrame([("x", None, None), ("y", "", None), ("y", "", None)], "id string, path string, expression string"))
    files = spark.createDataFrame([("a/b.rb",), ("a/c.rb",)], "path string")
    got = imports.resolve(rows, files, spark.createDataFrame([], "module string, root string")).groupBy("status", "target").count()
    assert seen == [3] and sorted(tuple(r) for r in got.filter("target is not null").collect()) == [("resolved", "a/c.rb", 1_000)]
    assert [tuple(r) for r in got.filter("target is null").collect()] == [("unresolved", None, 2)]


def test_bootstrap_sends_values_and_shuffles_no_picks(spark, monkeypatch):
    """Picks are added up where they are drawn; of more values than are sent, the results are the same."""
    from loomgrid.operators import account

    rows = spark.range(300).selectExpr("if(id % 10 = 0, null, (id * 37) % 50) as v")
    calls, numbered = [], account.numbered
    monkeypatch.setattr(account, "numbered", lambda *a: calls.append(1) or numbered(*a))
    got = account.bootstrap(rows, "v", 40).collect()
    assert not calls
    monkeypatch.setattr(account, "MAX_VALUES", 10)
    assert got == account.bootstrap(rows, "v", 40).collect() and calls and got[0].n == 270
    assert tuple(account.bootstrap(rows.filter("v is null"), "v", 40).first()) == (0, None, None, None)


def test_cascade_lists_targets_once_a_key(spark):
    """Targets are listed where they are grouped, not again for every row that has them."""
    from loomgrid.operators import graph

    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c")], "id long, k string")
    table = spark.createDataFrame([("a", "y"), ("a", "x"), ("a", "x"), ("b", "z")], "k string, target string")
    got = graph.cascade(rows, [("exact", ["k"], table)], "id")
    assert "array_join" not in got._jdf.queryExecution().optimizedPlan().toString().splitlines()[0]
    assert sorted((r.id, r.status, r.targets) for r in got.collect()) == [(1, "ambiguous", "x,y"), (2, "ambiguous", "x,y"), (3, "resolved", "z"), (4, "unresolved", None)]
