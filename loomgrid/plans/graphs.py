"""Graph, tree and catalogue queries."""

from pyspark.sql import functions as F

from loomgrid.operators import graph, names, tree
from loomgrid.plans.registry import query
from loomgrid.sources.corpus import load, membership, nodes, unit_links, view

STATUSES = ["resolved", "ambiguous", "unresolved"]


def _owners(spark, d):
    return view(spark, d, "units").select("id", F.expr("'g' || (ordinal % 200)").alias("unit"))


@query(
    "select a.unit as \"from\", b.unit as \"to\", kind, count(*) as count from edges e join (select id, 'g' || (ordinal % 200) as unit from units) a on a.id = e.source join (select id, 'g' || (ordinal % 200) as unit from units) b on b.id = e.target where status = 'resolved' and a.unit <> b.unit group by all",
    "edges", "units",
)
def unit_edges(spark, d):
    return graph.unit_edges(view(spark, d, "edges"), _owners(spark, d))


@query(
    "select l.language, k.kind, coalesce(sum((status = 'resolved')::int), 0)::bigint as resolved, coalesce(sum((status = 'ambiguous')::int), 0)::bigint as ambiguous, coalesce(sum((status = 'unresolved')::int), 0)::bigint as unresolved, count(e.id) as total from (select unnest(['m0', 'm1', 'm9x']) as language) l cross join (select unnest(['call', 'import', 'cfg']) as kind) k left join (select *, 'm' || (line % 3) as language from edges) e on e.language = l.language and e.kind = k.kind group by 1, 2",
    "edges",
)
def edge_status_matrix(spark, d):
    edges = view(spark, d, "edges").withColumn("language", F.expr("'m' || (line % 3)"))
    scaffold = spark.sql("select language, kind from values ('m0'), ('m1'), ('m9x') as l(language) join values ('call'), ('import'), ('cfg') as k(kind)")
    return graph.status_matrix(edges, STATUSES, ["language", "kind"], scaffold)


@query("select id, source, target, kind from edges where target is not null and target not in (select id from units where size <> 7)", "edges", "units")
def dangling_edges(spark, d):
    return graph.dangling(view(spark, d, "edges"), view(spark, d, "units").filter("size <> 7")).select("id", "source", "target", "kind")


@query("select id, path from units where path not in (select path from edges where kind = 'call' and weight > 49)", "units", "edges")
def nodes_outside_manifest(spark, d):
    seen = view(spark, d, "edges").filter("kind = 'call' and weight > 49").select("path")
    return view(spark, d, "units").join(seen, "path", "left_anti").select("id", "path")


@query("select source, kind, count(*) as count from edges where kind = 'call' and status <> 'resolved' group by 1, 2", "edges")
def internal_edge_counts(spark, d):
    return view(spark, d, "edges").filter("kind = 'call' and status <> 'resolved'").groupBy("source", "kind").agg(F.count("*").alias("count"))


_CAPS = "select 'l' || (o_custkey % 7) as language, case when o_orderkey % 2 = 0 then 'call' else 'import' end as graph, case o_orderpriority when '1-URGENT' then 'unavailable' when '2-HIGH' then 'failed' when '5-LOW' then 'unsupported' else 'empty' end as status, o_orderkey as ordinal from orders"


@query(
    f"with caps as ({_CAPS}), best as (select language, graph, status, row_number() over (partition by language, graph order by case status when 'empty' then 4 when 'unsupported' then 3 when 'failed' then 2 else 1 end desc, ordinal) as n from caps) select l.language, g.graph, coalesce(b.status, 'unavailable') as status from (select 'l' || range as language from range(9)) l cross join (select unnest(['call', 'import', 'cfg']) as graph) g left join best b on b.language = l.language and b.graph = g.graph and b.n = 1"
)
def capability_merge(spark, d):
    caps = spark.sql(_CAPS.replace("from orders", "from {orders}"), orders=load(spark, d, "orders"))
    scaffold = spark.sql("select 'l' || id as language, graph from range(9) join values ('call'), ('import'), ('cfg') as g(graph)")
    return graph.merged_capabilities(caps, scaffold)


_STATE = "case when n = 0 then 'empty' when ambiguous + unresolved > 0 then 'partial' else 'resolved' end"


@query(f"select path, resolved, ambiguous, unresolved, {_STATE} as status from (select path, count(*) as n, count(*) filter (where status = 'resolved') as resolved, count(*) filter (where status = 'ambiguous') as ambiguous, count(*) filter (where status = 'unresolved') as unresolved from edges group by path)", "edges")
def capability_status(spark, d):
    counts = view(spark, d, "edges").groupBy("path").agg(*(F.count_if(F.col("status") == s).alias(s) for s in STATUSES))
    return counts.withColumn("status", graph.call_capability(*(F.col(s) for s in STATUSES), F.lit(0)))


@query(
    "select g, case when g = 0 then 'absent' when g = 1 then 'unsupported' when g = 2 then 'failed' when n > 0 then 'provided' when g = 4 then 'failed' else 'empty' end as state from (select range as g from range(8)) left join (select line % 8 as g, count(*) as n from edges where line % 8 in (3, 6) group by 1) using (g)",
    "edges",
)
def graph_state(spark, d):
    n = view(spark, d, "edges").filter("line % 8 in (3, 6)").groupBy((F.col("line") % 8).alias("g")).agg(F.count("*").alias("n"))
    rows = spark.range(8).select(F.col("id").alias("g")).join(n, "g", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    g = F.col("g")
    return rows.select("g", graph.graph_state(g != 0, g != 1, g != 2, F.col("n"), F.when(g == 4, 1).otherwise(0), F.lit(0), F.lit(1)).alias("state")).withColumn("state", F.when((g == 4) & (F.col("state") == "empty"), "failed").otherwise(F.col("state")))


_IMPORTS = "select id, source, 'x' || (line % 40) as expression, status, case when weight % 2 = 0 then 'deep' else 'fast' end as backend from edges where kind = 'import'"


@query(f"with i as ({_IMPORTS}) select * from i where not (backend = 'deep' and status = 'unresolved' and exists (select 1 from i b where b.backend <> 'deep' and b.status = 'resolved' and b.source = i.source and b.expression = i.expression))", "edges")
def import_prefer_resolved(spark, d):
    imports = view(spark, d, "edges").filter("kind = 'import'").selectExpr("id", "source", "'x' || (line % 40) as expression", "status", "case when weight % 2 = 0 then 'deep' else 'fast' end as backend")
    return graph.prefer_resolved(imports, "deep")


@query("select e.id || '/' || i as id, source, 'u' || ((ordinal + i) % 2000) as target from edges e, range(3) t(i) where kind = 'import' and status = 'ambiguous' and i < 1 + weight % 3", "edges")
def import_explode(spark, d):
    rows = view(spark, d, "edges").filter("kind = 'import' and status = 'ambiguous'")
    rows = rows.select("id", "source", F.posexplode(F.expr("transform(sequence(0L, weight % 3), i -> 'u' || ((ordinal + i) % 2000))")).alias("i", "target"))
    return rows.select(F.concat_ws("/", "id", "i").alias("id"), "source", "target")


@query(
    """with asked as (select u.ordinal, u.name, n.kind, u.path from units u join units n on n.ordinal = u.ordinal + 1), a as (select name, kind, string_agg(distinct id, ',' order by id) as t, count(distinct id) as n from units group by 1, 2),
    b as (select path, kind, string_agg(distinct id, ',' order by id) as t, count(distinct id) as n from units group by 1, 2)
    select q.ordinal, case when a.n is not null then 'exact' when b.n is not null then 'near' end as basis, case when coalesce(a.n, b.n) is null then 'unresolved' when coalesce(a.n, b.n) = 1 then 'resolved' else 'ambiguous' end as status, coalesce(a.t, b.t) as targets
    from asked q left join a on a.name = q.name and a.kind = q.kind left join b on b.path = q.path and b.kind = q.kind""",
    "units",
)
def call_resolution(spark, d):
    units = view(spark, d, "units")
    after = units.select((F.col("ordinal") - 1).alias("ordinal"), "kind")
    exact = units.select("name", "kind", F.col("id").alias("target"))
    near = units.select("path", "kind", F.col("id").alias("target"))
    return graph.cascade(units.drop("kind").join(after, "ordinal"), [("exact", ["name", "kind"], exact), ("near", ["path", "kind"], near)], "ordinal")


@query("select a, b, sum(count)::bigint as count from (select m.node as a, n.node as b, count from unit_links l join membership m on m.unit = l.\"from\" join membership n on n.unit = l.\"to\") where a <> b group by 1, 2", "membership", "unit_links")
def rollup_directed(spark, d):
    return graph.rolled_up(unit_links(spark, d), membership(spark, d))


@query("select least(a, b) as a, greatest(a, b) as b, sum(count)::bigint as count from (select m.node as a, n.node as b, count from unit_links l join membership m on m.unit = l.\"from\" join membership n on n.unit = l.\"to\") where a <> b group by 1, 2", "membership", "unit_links")
def ties_symmetric(spark, d):
    return graph.ties(graph.rolled_up(unit_links(spark, d), membership(spark, d)))


_DEGREE = "select unit, sum(count)::bigint as degree from (select \"from\" as unit, count from unit_links union all select \"to\", count from unit_links) group by 1"


@query(f"select node, unit, degree, place from (select node, unit, degree, row_number() over (partition by node order by degree desc, unit) as place from ({_DEGREE}) join membership using (unit)) where place <= 3", "membership", "unit_links")
def call_degree_topk(spark, d):
    return graph.top_per_key(graph.degree(unit_links(spark, d)).join(membership(spark, d).select("unit", "node"), "unit"), "node", [F.desc("degree"), "unit"], 3)


@query(f"select unit, degree, row_number() over (order by degree desc, unit) as place from ({_DEGREE}) order by degree desc, unit limit 15", "unit_links")
def degree_top15(spark, d):
    from pyspark.sql import Window

    top = graph.degree(unit_links(spark, d)).orderBy(F.desc("degree"), "unit").limit(15)
    return top.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("degree"), "unit")).cast("long"))


for _name, _where, _how in [
    ("query_graph_out", "source in (select id from units where path in ('pkg1/mod1.py', 'pkg2/mod2.py'))", {"paths": ["pkg1/mod1.py", "pkg2/mod2.py"], "direction": "out"}),
    ("query_graph_in", "target in (select id from units where path in ('pkg1/mod1.py', 'pkg2/mod2.py'))", {"paths": ["pkg1/mod1.py", "pkg2/mod2.py"], "direction": "in"}),
    ("query_graph_kind", "kind = 'import'", {"kind": "import"}),
    ("query_graph_node", "kind = 'call' and 'u7' in (source, target)", {"node_id": "u7", "kind": "call"}),
]:

    def _make(where, how):
        def run(spark, d):
            edges = view(spark, d, "edges").select("id", "source", "target", "kind", "line")
            return graph.slice_of(view(spark, d, "units"), edges, **how)[1].select("id", "source", "target", "kind").distinct()

        return run

    _run = _make(_where, _how)
    _run.__name__ = _name
    query(f"select distinct id, source, target, kind from edges where {_where}", "edges", "units")(_run)


@query("with e as (select * from edges where kind = 'call' and (source in (select id from units where path = 'pkg3/mod3.py') or target in (select id from units where path = 'pkg3/mod3.py'))) select id, path, kind from units where id in (select source from e) or id in (select target from e)", "edges", "units")
def context_slice(spark, d):
    """The nodes around one file's calls, never the whole graph."""
    edges = view(spark, d, "edges").select("id", "source", "target", "kind", "line")
    return graph.slice_of(view(spark, d, "units"), edges, ["pkg3/mod3.py"], kind="call")[0].select("id", "path", "kind")


@query("select id, 'root' as ancestor, case when parent = 'root' then 1 else 2 end::bigint as distance from nodes where parent is not null union all select n.id, n.parent, 1 from nodes n where n.parent like 'r_'", "nodes")
def ancestors(spark, d):
    return tree.ancestors(nodes(spark, d))


@query("select a.id as a, b.id as b from nodes a join nodes b on b.parent = a.id or (a.parent is null and b.id <> a.id and b.parent is not null) group by 1, 2", "nodes")
def containment_pairs(spark, d):
    return tree.ancestors(nodes(spark, d)).select(F.col("ancestor").alias("a"), F.col("id").alias("b"))


@query(
    "with n as (select node as id, count(distinct unit) as units from membership group by 1) select o.id, coalesce(case when o.id = 'root' then (select sum(units) from n) when o.id like 'r_' then (select sum(units) from n join nodes k on k.id = n.id where k.parent = o.id) else (select units from n where n.id = o.id) end, 0)::bigint as units from nodes o",
    "nodes", "membership",
)
def subtree_units(spark, d):
    return tree.subtree_counts(nodes(spark, d), membership(spark, d))


_LCA = "select l.count, a.node as na, b.node as nb, pa.parent as ra, pb.parent as rb from unit_links l join membership a on a.unit = l.\"from\" join membership b on b.unit = l.\"to\" join nodes pa on pa.id = a.node join nodes pb on pb.id = b.node"


@query(f"select case when ra <> rb then ra else na end as a, case when ra <> rb then rb else nb end as b, sum(count)::bigint as count from ({_LCA}) where na <> nb group by 1, 2", "nodes", "membership", "unit_links")
def lca_dependencies(spark, d):
    return tree.sibling_dependencies(nodes(spark, d), membership(spark, d).select("unit", "node"), unit_links(spark, d))


for _k, _sql in [(0, "'root'"), (1, "n.parent"), (5, "m.node")]:

    def _cut(k):
        def run(spark, d):
            return tree.cut_at(nodes(spark, d), membership(spark, d).select("unit", "node"), k)

        run.__name__ = {0: "tree_cut_top", 1: "tree_cut_depth", 5: "tree_cut_leaf"}[k]
        return run

    query(f'select m.unit, {_sql} as "group" from membership m join nodes n on n.id = m.node', "nodes", "membership")(_cut(_k))


@query(
    """with kids as (select parent, count(*) as n from nodes where parent is not null group by 1), faults as (
      select 'acyclic' as "check", 0 as detail union all select 'single_root', (select count(*) from (select count(*) as n from nodes where parent is null) where n <> 1) as detail union all select 'reachable', 0 union all
      select 'unique_owner', (select count(*) from (select unit from membership group by 1 having count(distinct node) > 1)) union all select 'known_parent', (select count(*) from nodes where parent is not null and parent not in (select id from nodes)) union all
      select 'no_empty_node', (select count(*) from nodes where id not in (select node from membership) and id not in (select parent from kids)) union all select 'distinct_titles', (select count(*) from (select 1 from nodes group by parent, title having count(*) > 1)) union all
      select 'group_sizes', (select count(*) from kids where n < 2 or n > 12)) select "check", detail = 0 as ok, detail from faults""",
    "nodes", "membership",
)
def tree_verify(spark, d):
    return tree.checks(nodes(spark, d), membership(spark, d))


@query("select id, depth from (select id, case when parent is null then 0 when parent = 'root' then 1 else 2 end as depth from nodes)", "nodes")
def reachability(spark, d):
    return tree.paths(nodes(spark, d)).select("id", "depth")


@query("select regexp_extract(e.path, '^[^/]+') as a, regexp_extract(u.path, '^[^/]+') as b, count(*) as count from edges e join units u on u.id = e.target where e.status = 'resolved' group by 1, 2", "edges", "units")
def package_rollup(spark, d):
    units = view(spark, d, "units").select(F.col("id").alias("target"), F.regexp_extract("path", "^[^/]+", 0).alias("b"))
    return view(spark, d, "edges").filter("status = 'resolved'").join(units, "target").groupBy(F.regexp_extract("path", "^[^/]+", 0).alias("a"), "b").agg(F.count("*").alias("count"))


@query("select path, unnest(case when strpos(path, '/') > 0 then list_transform(range(1, len(string_split(path, '/'))), lambda i: array_to_string(string_split(path, '/')[1:i], '/')) end) as folder from (select distinct path from files)", "files")
def anchor_chain(spark, d):
    """Each file with all folders above it."""
    steps = F.split("path", "/")
    chain = F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/"))
    return view(spark, d, "files").select("path").distinct().select("path", F.explode(chain).alias("folder"))


@query("select folder, count(*) as files from (select unnest(list_transform(range(1, len(string_split(path, '/'))), lambda i: array_to_string(string_split(path, '/')[1:i], '/'))) as folder from files) group by 1", "files")
def directory_tree(spark, d):
    steps = F.split("path", "/")
    chain = F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/"))
    return view(spark, d, "files").select(F.explode(chain).alias("folder")).groupBy("folder").agg(F.count("*").alias("files"))


@query("select g, depth from (select t.g, k.depth, row_number() over (partition by t.g order by abs(k.n - t.g * 3), k.depth desc) as r from (select range as g from range(1, 12)) t, (select 0 as depth, 1 as n union all select 1, 5 union all select 2, 25) k) where r = 1")
def depth_match(spark, d):
    """For each wanted number of groups the depth that comes nearest, finer on ties."""
    from pyspark.sql import Window

    sizes = tree.paths(nodes(spark, d)).groupBy("depth").agg(F.count("*").alias("n"))
    asked = spark.range(1, 12).select(F.col("id").alias("g"), F.lit(1).alias("_one"))
    met = asked.join(sizes.withColumn("_one", F.lit(1)), "_one")
    w = Window.partitionBy("g").orderBy(F.abs(F.col("n") - F.col("g") * 3), F.desc("depth"))
    return met.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("g", "depth")


_NAMED = "select id, regexp_extract(name, '^[^_]*') || case when ordinal % 40 = 7 then ' (mod' || (ordinal % 200) || '.py)' when ordinal % 40 = 9 then ' 2' else '' end as base, regexp_extract(path, '[^/]*$') as file from units"


@query(
    f"""with recursive o as (select *, row_number() over (order by id) as i from ({_NAMED})), walk as (
      select 0::bigint as i, ''::varchar as id, ''::varchar as given, []::varchar[] as taken
      union all
      select o.i, o.id, g.given, list_append(taken, g.given) from walk w join o on o.i = w.i + 1, lateral (
        select case when not list_contains(taken, o.base) then o.base when not list_contains(taken, o.base || ' (' || o.file || ')') then o.base || ' (' || o.file || ')'
          else (select o.base || ' (' || o.file || ') ' || min(n) from range(2, 400) t(n) where not list_contains(taken, o.base || ' (' || o.file || ') ' || n)) end as given) g)
    select id, given from walk where i > 0""",
    "units",
)
def display_names(spark, d):
    """Every unit's name, told apart by its file and then by numbers, where another unit's own name may stand in the way."""
    units = view(spark, d, "units")
    tail = F.expr("case when ordinal % 40 = 7 then ' (mod' || (ordinal % 200) || '.py)' when ordinal % 40 = 9 then ' 2' else '' end")
    return names.display_names(units.select("id", F.concat(F.regexp_extract("name", "^[^_]*", 0), tail).alias("base"), F.regexp_extract("path", "[^/]*$", 0).alias("file")))


@query(
    """with o as (select id, ordinal, trim(substr(trim(regexp_replace(lower(translate(title, 'äöüÉ', 'aouE')), '[^a-z0-9]+', '-', 'g'), '-'), 1, 48), '-') as base from (select id, ordinal, case when ordinal % 5 = 0 then '—' else substr(name, 1, 4 + ordinal % 7) || 'äü' end as title from units)),
    n as (select *, row_number() over (partition by base order by ordinal) as k from o)
    select id, case when base <> '' and k = 1 then base when base = '' then 'node-' || substr(sha1(id || '0'), 1, 5) else base || '-' || substr(sha1(id || '0'), 1, 5) end as given from n""",
    "units",
)
def node_slugs(spark, d):
    """Ids that people can read, of every unit as a node."""
    titled = view(spark, d, "units").select("id", F.expr("case when ordinal % 5 = 0 then '—' else substr(name, 1, cast(4 + ordinal % 7 as int)) || 'äü' end").alias("title"), F.col("ordinal").alias("place"))
    return names.slugs(titled)


@query(
    """with g as (select ordinal // 4 as place, list(name order by ordinal) as names from units group by 1), k as (select place, list_transform(list_filter(list_transform(names, lambda n: trim(regexp_replace(lower(n), '[^a-z0-9]+', '-', 'g'), '-')), lambda n: n <> ''), lambda n: n) as names from g),
    d as (select place, [names[i] for i in range(1, len(names) + 1) if list_position(names, names[i]) = i] as names from k),
    p as (select place, names, [string_split(n, '-') for n in names] as parts from d),
    s as (select place, parts, case when len(parts) > 1 then coalesce(list_max([j for j in range(1, list_min([len(x) for x in parts])) if len(list_distinct([x[1:j] for x in parts])) = 1]), 0) else 0 end as shared from p),
    b as (select place, array_to_string([array_to_string(x[shared + 1:], '-') for x in parts[1:3]], '-and-') as base from s),
    c as (select place, case when length(base) > 48 then regexp_replace(coalesce(nullif(regexp_replace(base[1:48], '-[^-]*$', ''), ''), base[1:48]), '-and$', '') else base end as base from b)
    select place, 'grp:' || base || case when n > 1 then '-' || n else '' end as given from (select *, row_number() over (partition by base order by place) as n from c)""",
    "units",
)
def group_ids(spark, d):
    """What groups of four units are called."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "name"))), lambda x: x["name"])
    groups = view(spark, d, "units").groupBy(F.expr("ordinal div 4").alias("place")).agg(listed.alias("names")).withColumn("title", F.lit(None).cast("string"))
    return names.group_ids(groups)


@query("with recursive w as (select id, 'u' || (ordinal // 2) as base, 0 as depth from units where ordinal > 0 union all select w.id, 'u' || (u.ordinal // 2), depth + 1 from w join units u on u.id = w.base where u.ordinal > 0 and u.size > 5) select w.id, w.base as target, depth from (select w.*, row_number() over (partition by w.id order by depth, base) as r from w join units u on u.id = w.base where u.size <= 5) w where r = 1", "units")
def inheritance_search(spark, d):
    """The nearest base, up a chain of bases, that has the member itself."""
    units = view(spark, d, "units").selectExpr("id", "ordinal", "size", "'u' || (ordinal div 2) as base")
    own = units.select("id", F.when(F.col("ordinal") > 0, F.col("base")).alias("parent"))
    return tree.nearest(own, units.filter("size <= 5").select("id")).select("id", "target", F.col("depth").cast("int").alias("depth"))


_LINKED = "select id, case when ordinal = 0 then null when ordinal % 97 in (3, 4) then 'u' || (ordinal + 1) when ordinal % 97 = 5 then 'u' || (ordinal - 2) when ordinal % 101 = 5 then 'x' || ordinal else 'u' || cast(ordinal div 3 as bigint) end as parent, ordinal from units"


@query(
    f"""with recursive own as ({_LINKED.replace('ordinal div 3', 'ordinal // 3')}),
    up as (select id, id as top, 0 as depth from own union all select u.id, o.parent, depth + 1 from up u join own o on o.id = u.top where o.parent is not null and depth < 40),
    highest as (select id, arg_max(top, depth) as top, max(depth) as depth from up group by id),
    met as (select l.*, o.id as known, o.ordinal from highest l left join own o on o.id = l.top)
    select m.id, case when m.depth < 40 and known is not null then m.top end as root, case when m.depth < 40 and known is not null then m.depth end::bigint as depth,
      case when m.depth < 40 then case when known is null then 'lost' else 'reached' end when s.ordinal % 97 in (3, 4, 5) then 'cycle' else 'below' end as state,
      case when m.depth = 40 then least('u' || (m.ordinal - m.ordinal % 97 + 3), 'u' || (m.ordinal - m.ordinal % 97 + 4), 'u' || (m.ordinal - m.ordinal % 97 + 5)) end as cycle
    from met m join own s on s.id = m.id""",
    "units",
)
def tree_reach(spark, d):
    """Roots and depths of a forest, with what hangs on cycles of three or below a parent that is none."""
    units = view(spark, d, "units")
    linked = units.select("id", F.expr(_LINKED[len("select id, ") : _LINKED.index(" as parent")]).alias("parent"))
    return tree.reach(linked)
