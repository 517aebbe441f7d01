"""Corpus tables in the engine's shapes, made from the plain tables of a data folder.

Each view is a source table and a list of expressions in the SQL that Spark and
DuckDB share, so that a query and its oracle start from one definition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgrid.sources import repository

#: view: (table, expressions)
VIEWS: dict[str, tuple[str, list[str]]] = {
    "files": ("documents", ["doc_id as ordinal", "source || '/' || lang || '/doc_' || doc_id || '.txt' as path", "lang as language", "text as source", "md5(text) as digest"]),
    "page_files": ("pages", ["page_id as ordinal", "url as path", "html as source", "md5(html) as digest"]),
    "units": ("part", ["p_partkey as ordinal", "'u' || p_partkey as id", "'pkg' || (p_partkey % 25) || '/mod' || (p_partkey % 200) || '.py' as path", "lower(p_type) as kind", "replace(p_name, ' ', '_') as name", "cast(1 + 10 * (p_partkey div 200) as bigint) as start_line", "cast(10 + 10 * (p_partkey div 200) as bigint) as end_line", "p_size as size", "p_name as summary"]),
    "edges": (
        "lineitem",
        [
            "md5(l_orderkey || '|' || l_partkey || '|' || l_suppkey || '|' || l_linenumber || '|' || cast(l_quantity as bigint) || '|' || cast(round(l_extendedprice * 100) as bigint)) as id", "'u' || l_partkey as source",
            "case when l_returnflag = 'R' then null else 'u' || l_suppkey end as target", "case when l_linestatus = 'F' then 'call' else 'import' end as kind",
            "case l_returnflag when 'N' then 'resolved' when 'A' then 'ambiguous' else 'unresolved' end as status", "'pkg' || (l_partkey % 25) || '/mod' || (l_partkey % 200) || '.py' as path",
            "cast(l_linenumber + 10 * (l_partkey div 200) as bigint) as line", "l_orderkey as ordinal", "cast(l_quantity as bigint) as weight",
        ],
    ),
    "repo_files": ("part", [f"{repository.path('p_partkey')} as path"]),
    "declarations": ("lineitem", ["l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey as id", f"{repository.path('l_partkey')} as path", f"{repository.declaration('l_partkey', '(l_suppkey * 8 + l_partkey % 8)', 'l_linenumber')} as expression"]),
    "methods": ("part", ["p_partkey as node_id", "'m' || (p_partkey % 40) as name", f"{repository.method('p_partkey')} as full_name", f"{repository.method_file('p_partkey')} as file"]),
    "types": ("supplier", ["'com.acme.K' || (s_suppkey % 300) as full_name", "'K' || (s_suppkey % 300) as name", "'java/app' || (s_suppkey % 10) || '/com/acme/K' || (s_suppkey % 300) || '.java' as file", "case when s_suppkey % 6 <> 5 then 'com.acme.K' || ((s_suppkey + 1) % 300) end as base"]),
    "calls": (
        "lineitem",
        [
            "l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey as id", "l_partkey as caller_id", f"{repository.method_file('l_partkey')} as caller_file", f"{repository.called('l_partkey', '(l_suppkey * 8 + l_partkey % 8)', 'l_linenumber')} as full_name",
            "'n' || (l_suppkey % 9) as name", "case when l_linenumber <> 7 then 'call()' when l_suppkey % 3 = 0 then 'len(x[0], \")\")' when l_suppkey % 3 = 1 then 'len(x).real()' else 'mine(x)' end as code",
            "case when l_linenumber = 1 or (l_linenumber = 2 and l_suppkey % 2 = 0) then l_suppkey * 8 + l_partkey % 8 end as first_callee", "case when l_linenumber = 2 and l_suppkey % 2 = 0 then l_suppkey * 8 + l_partkey % 8 + 8 end as second_callee",
            f"case when l_linenumber in (3, 5, 6) or (l_linenumber = 7 and l_partkey % 8 > 1) then {repository.called('l_partkey', '(l_suppkey * 8 + l_partkey % 8)', 'l_linenumber')} when l_linenumber = 2 and l_suppkey % 2 = 1 then 'ext.lib' || (l_suppkey % 4) end as outside",
        ],
    ),
    "sites": (
        "lineitem",
        [
            "l_orderkey * 8 + l_linenumber as node", "l_partkey as k", "'cpg' || (l_partkey % 8) as namespace", "l_suppkey % 9 as s", f"{repository.method_file('l_partkey')} as path", "l_linenumber as line",
            *(f"{v} as {n}" for n, v in repository.sites("l_partkey", "l_suppkey % 9").items()), f"{repository.reason('l_partkey', 'l_suppkey % 9')} as expected",
        ],
    ),
    "tree_regions": ("region", ["'r' || r_regionkey as id", "'root' as parent", "r_name as title"]),
    "tree_nations": ("nation", ["'n' || n_nationkey as id", "'r' || n_regionkey as parent", "n_name as title"]),
    "supplier_units": ("supplier", ["'s' || s_suppkey as unit", "'n' || s_nationkey as node", "cast(round(s_acctbal * 100) as bigint) as cents"]),
    "customer_units": ("customer", ["'c' || c_custkey as unit", "'n' || c_nationkey as node", "cast(round(c_acctbal * 100) as bigint) as cents"]),
    "commit_files": ("lineitem", ["l_orderkey as commit_id", "l_partkey as file", "cast(l_quantity as bigint) as lines"]),
    "task_events": ("events", ["event_id", "ts", "user_id as task", "event_type as status", "cast(round(value * 100) as bigint) as tokens", "props"]),
    "turns": ("conversations", ["conv_id", "turn", "role", "text"]),
    "votes": ("labels", ["doc_id as item", "quality", "toxic"]),
}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = VIEWS[name]
    return load(spark, sf_dir, table).selectExpr(*columns)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The module tree: one root, regions, nations."""
    root = spark.range(1).selectExpr("'root' as id", "cast(null as string) as parent", "'World' as title")
    return root.unionByName(view(spark, sf_dir, "tree_regions")).unionByName(view(spark, sf_dir, "tree_nations"))


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "supplier_units").unionByName(view(spark, sf_dir, "customer_units"))


def unit_meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """from and to, a customer and the supplier of what they ordered, once an item."""
    orders, items = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    met = items.join(orders, items.l_orderkey == orders.o_orderkey)
    return met.selectExpr("'c' || o_custkey as `from`", "'s' || l_suppkey as `to`")


def unit_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """from, to and count of customers and the suppliers of what they ordered."""
    return unit_meetings(spark, sf_dir).groupBy("from", "to").count()


_MORE = {
    "nodes": "nodes as (select 'root' as id, cast(null as varchar) as parent, 'World' as title union all select * from tree_regions union all select * from tree_nations)",
    "membership": "membership as (select * from supplier_units union all select * from customer_units)",
    "unit_links": "unit_links as (select 'c' || o_custkey as \"from\", 's' || l_suppkey as \"to\", count(*) as count from lineitem join orders on l_orderkey = o_orderkey group by 1, 2)",
}


def _duck(expression: str) -> str:
    return expression.replace(" div ", " // ")


def oracle(body: str, *views: str, recursive: bool = False) -> str:
    """DuckDB SQL of a body over these views."""
    need = [v for v in views if v in VIEWS] + (["tree_regions", "tree_nations"] if "nodes" in views else []) + (["supplier_units", "customer_units"] if "membership" in views else [])
    parts = [f"{v} as (select {', '.join(map(_duck, VIEWS[v][1]))} from {VIEWS[v][0]})" for v in dict.fromkeys(need)] + [_MORE[v] for v in views if v in _MORE]
    text = body.strip()
    if not parts:
        return text
    word = "with recursive" if recursive or text.lower().startswith("with recursive") else "with"
    if text.lower().startswith("with recursive"):
        return f"{word} {', '.join(parts)}, {text[len('with recursive'):]}"
    if text.lower().startswith("with"):
        return f"{word} {', '.join(parts)}, {text[4:]}"
    return f"{word} {', '.join(parts)} {text}"
