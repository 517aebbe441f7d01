"""Graph operators over nodes (id, ...) and edges (source, target, kind, status, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.operators.rounds import stored

#: The order of capability statuses, best first by rank.
STATUS_RANK = {"resolved": 6, "partial": 5, "empty": 4, "not_requested": 4, "unsupported": 3, "failed": 2, "unavailable": 1}


def ranked_status(status: Column) -> Column:
    return F.element_at(F.create_map(*(x for k, v in STATUS_RANK.items() for x in (F.lit(k), F.lit(v)))), status)


def status_matrix(edges: DataFrame, statuses: list[str], by: list[str], scaffold: DataFrame) -> DataFrame:
    """Counts by these columns and status, with zeros for the scaffold's combinations, and their total."""
    counts = edges.groupBy(*by).agg(*(F.count_if(F.col("status") == s).alias(s) for s in statuses), F.count("*").alias("total"))
    return scaffold.join(counts, by, "left").select(*by, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in [*statuses, "total"]))


def dangling(edges: DataFrame, nodes: DataFrame, end: str = "target") -> DataFrame:
    """Edges with an end that is no node; a null end is none."""
    return edges.filter(F.col(end).isNotNull()).join(nodes.select(F.col("id").alias(end)), end, "left_anti")


def unit_edges(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """from, to, kind and count of resolved edges between different owners; owners: id, unit."""
    a, b = owners.select(F.col("id").alias("source"), F.col("unit").alias("from")), owners.select(F.col("id").alias("target"), F.col("unit").alias("to"))
    met = edges.filter("status = 'resolved'").join(a, "source").join(b, "target").filter("`from` <> `to`")
    return met.groupBy("from", "to", "kind").agg(F.count("*").alias("count"))


def rolled_up(links: DataFrame, members: DataFrame) -> DataFrame:
    """Directed sums of links (from, to, count) between different groups; members: unit, node."""
    a, b = members.select(F.col("unit").alias("from"), F.col("node").alias("a")), members.select(F.col("unit").alias("to"), F.col("node").alias("b"))
    return links.join(a, "from").join(b, "to").filter("a <> b").groupBy("a", "b").agg(F.sum("count").alias("count"))


def ties(directed: DataFrame) -> DataFrame:
    """Sums of both directions: each pair once, the lesser name first."""
    return directed.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("count").alias("count"))


def degree(links: DataFrame) -> DataFrame:
    """Sum of counts on both sides of each unit."""
    both = links.select(F.col("from").alias("unit"), "count").unionByName(links.select(F.col("to").alias("unit"), "count"))
    return both.groupBy("unit").agg(F.sum("count").alias("degree"))


def top_per_key(rows: DataFrame, key: str, order: list, k: int) -> DataFrame:
    """The first k rows of each key, numbered."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long")).filter(F.col("place") <= k)


def slice_of(nodes: DataFrame, edges: DataFrame, paths: list[str] | None = None, node_id: str | None = None, kind: str | None = None, direction: str = "both") -> tuple[DataFrame, DataFrame]:
    """One hop around the nodes of these paths, or of this id: the kept nodes and edges.

    Edges are filtered by kind first. With no selection all edges of the kind are
    kept. With a kind and no id, a selected node that keeps no edge is dropped.
    """
    kept = edges.filter(F.col("kind") == kind) if kind else edges
    if paths is None and node_id is None:
        ends = kept.select(F.col("source").alias("id")).unionByName(kept.select(F.col("target").alias("id")))
        return nodes.join(ends, "id", "left_semi"), kept
    wanted = F.lit(False)
    if paths is not None:
        wanted = wanted | F.col("path").isin(paths)
    if node_id is not None:
        wanted = wanted | (F.col("id") == node_id)
    chosen = nodes.filter(wanted).select("id")
    out_ = kept.join(chosen.withColumnRenamed("id", "source"), "source", "left_semi")
    in_ = kept.join(chosen.withColumnRenamed("id", "target"), "target", "left_semi")
    own = {"out": out_, "in": in_}.get(direction)
    own = out_.unionByName(in_, allowMissingColumns=True).distinct() if own is None else own
    ends = own.select(F.col("source").alias("id")).unionByName(own.select(F.col("target").alias("id")))
    keep = ends if kind and node_id is None else ends.unionByName(chosen)
    return nodes.join(keep, "id", "left_semi"), own.select(*edges.columns)


def merged_capabilities(rows: DataFrame, scaffold: DataFrame) -> DataFrame:
    """For each language and graph the status of the highest rank, the first of equals; what is missing is unavailable. rows: language, graph, status, ordinal."""
    best = rows.groupBy("language", "graph").agg(F.max_by("status", F.struct(ranked_status(F.col("status")), -F.col("ordinal"))).alias("status"))
    return scaffold.join(best, ["language", "graph"], "left").withColumn("status", F.coalesce("status", F.lit("unavailable")))


def call_capability(resolved: Column, ambiguous: Column, unresolved: Column, external: Column) -> Column:
    return F.when(resolved + ambiguous + unresolved + external == 0, "empty").when(ambiguous + unresolved > 0, "partial").otherwise("resolved")


def prefer_resolved(imports: DataFrame, backend: str) -> DataFrame:
    """Without this backend's unresolved imports of which another backend resolved the same source and expression."""
    better = imports.filter((F.col("backend") != backend) & (F.col("status") == "resolved")).select("source", "expression").distinct()
    poor = (F.col("backend") == backend) & (F.col("status") == "unresolved")
    return imports.filter(~poor).unionByName(imports.filter(poor).join(better, ["source", "expression"], "left_anti"))


def cascade(rows: DataFrame, lookups: list[tuple[str, list[str], DataFrame]], key: str) -> DataFrame:
    """The first look-up with a match decides: basis, status (resolved by one target, ambiguous by several) and targets.

    lookups: name, columns to match, and a table of these columns and target.
    """
    # a row learns its rule and its targets' number first; a list can be long, so it meets its rows last and no shuffle of rows carries it
    own = F.sort_array(F.collect_set("target"))
    lists = {name: (columns, stored(table.groupBy(*columns).agg(F.size(own).alias("_n"), F.array_join(own, ",").alias("targets")))) for name, columns, table in lookups}
    out = rows
    for name, (columns, found) in lists.items():
        out = out.join(found.select(*columns, F.col("_n").alias(f"_n_{name}")), columns, "left")
    n = F.coalesce(*(F.col(f"_n_{name}") for name in lists))
    basis = F.coalesce(*(F.when(F.col(f"_n_{name}").isNotNull(), F.lit(name)) for name in lists))
    status = F.when(n.isNull(), "unresolved").when(n == 1, "resolved").otherwise("ambiguous")
    used = dict.fromkeys([key, *(c for columns, _ in lists.values() for c in columns)])
    told = stored(out.select(*used, basis.alias("basis"), status.alias("status")))
    every = told.filter("basis is null").select(key, "basis", "status", F.lit(None).cast("string").alias("targets"))
    for name, (columns, found) in lists.items():
        every = every.unionByName(told.filter(F.col("basis") == name).join(found.drop("_n"), columns).select(key, "basis", "status", "targets"))
    return every


def graph_state(present: Column, schema_ok: Column, completed: Column, edges: Column, failed: Column, unsupported: Column, languages: Column) -> Column:
    """absent, unsupported, failed, provided or empty, by the first rule that holds."""
    return (
        F.when(~present, "absent").when(~schema_ok, "unsupported").when(~F.coalesce(completed, F.lit(True)), "failed").when(edges > 0, "provided")
        .when(F.coalesce(completed, F.lit(False)), "empty").when(failed > 0, "failed").when(unsupported > 0, "unsupported").when(languages == 0, "unsupported").otherwise("empty")
    )
