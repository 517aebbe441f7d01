"""What grows with the square of a table is written out, not shuffled or stored."""


def shuffled(spark, run):
    """Records and bytes that the stages of these actions write to shuffles."""
    sc = spark.sparkContext

    def total():
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        own = [stages.apply(i) for i in range(stages.size())]
        return sum(s.shuffleWriteRecords() for s in own), sum(s.shuffleWriteBytes() for s in own)

    before = total()
    out = run()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    after = total()
    return out, after[0] - before[0], after[1] - before[1]


def test_files_of_go_packages_are_not_shuffled_once_an_import(spark, monkeypatch):
    """300 imports of a package of 300 files are 90,000 rows, which no shuffle carries; lists of any length give the same."""
    from loomgrid.operators import imports

    rows = spark.range(300).selectExpr("concat('d', id) as id", "concat('go/a/f', id, '.go') as path", "'import \"x.org/b\"' as expression").unionByName(spark.createDataFrame([("none", "go/a/f1.go", 'import "x.org/c"'), ("far", "go/a/f1.go", 'import "fmt"')], "id string, path string, expression string"))
    files = spark.range(300).selectExpr("concat('go/b/g', id, '.go') as path").unionByName(spark.createDataFrame([("go/b/g1_test.go",), ("go/a/f1.go",)], "path string"))
    modules = spark.createDataFrame([("x.org", "go")], "module string, root string")
    found, records, _ = shuffled(spark, lambda: imports.resolve(rows, files, modules).collect())
    assert records < 45_000
    names = sorted(f"go/b/g{i}.go" for i in range(300))
    expected = [(f"d{i}", k, "resolved", name) for i in range(300) for k, name in enumerate(names)] + [("none", 0, "unresolved", None), ("far", 0, "external", "fmt")]
    told = lambda rows: sorted(((r.id, r["index"], r.status, r.target) for r in rows), key=str)
    assert told(found) == sorted(expected, key=str)
    monkeypatch.setattr(imports, "GO_LIST", 7)
    assert told(imports.resolve(rows, files, modules).collect()) == told(found)


def test_lists_of_targets_are_not_shuffled_once_a_row(spark):
    """2,000 rows of one key have a list of 2,000 targets each, which no shuffle carries with them."""
    from loomgrid.operators import graph

    rows = spark.range(2_000).selectExpr("id", "'a' as k", "'b' as l").unionByName(spark.createDataFrame([(-1, "c", "b"), (-2, "c", "c"), (-3, None, "b")], "id long, k string, l string"))
    exact = spark.range(2_000).selectExpr("'a' as k", "concat('target', id) as target")
    near = spark.createDataFrame([("b", "y"), ("a", "z")], "l string, target string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found, _, size = shuffled(spark, lambda: graph.cascade(rows, [("exact", ["k"], exact), ("near", ["l"], near)], "id").collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert size < 500_000
    listed = ",".join(sorted(f"target{i}" for i in range(2_000)))
    assert {r.id: tuple(r)[1:] for r in found} == {i: ("exact", "ambiguous", listed) for i in range(2_000)} | {-1: ("near", "resolved", "y"), -2: (None, "unresolved", None), -3: ("near", "resolved", "y")}


def test_weights_carry_a_byte_a_replicate(spark):
    """Weights meet their ends' groups in all replicates as short arrays; null and missing groups count as in the general form."""
    from loomgrid.operators import account

    weights = spark.range(20_000).selectExpr("concat('i', id % 97) as a", "concat('i', 97 + id % 101) as b", "cast(1 + id % 3 as double) as weight")
    labels = spark.range(198 * 31).selectExpr("id div 198 - 1 as replicate", "concat('i', id % 198) as item", "if(id % 50 = 7, null, concat('a long name of a group ', hash(id) % 20)) as `group`").filter("replicate <> 5 or item <> 'i3'")
    rounded = lambda df: sorted((r.replicate, round(r.q, 9)) for r in df.collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got, _, size = shuffled(spark, lambda: rounded(account.modularity_of_labels(weights, labels)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(got) == 31 and got == rounded(account.modularity_of_replicates(weights, account.hard(labels)))
    assert size < 800_000
