"""Clustering, packing, tree assembly, run checks and source facts."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgrid.functions import source_facts
from loomgrid.operators import cluster, graph, scan, sequence
from loomgrid.plans.registry import query
from loomgrid.sources.corpus import load, membership, nodes, unit_links, view

_W = "w as (select least(\"from\", \"to\") as a, greatest(\"from\", \"to\") as b, round(sum((1 + ln(greatest(count, 1))) / ln(2.718281828459045 + callers)), 6) as weight from (select l.*, c.callers from unit_links l join (select \"to\", count(distinct \"from\") as callers from unit_links group by 1) c using (\"to\")) where \"from\" <> \"to\" group by 1, 2)"


def _weights(spark, d):
    links = unit_links(spark, d)
    callers = links.groupBy("to").agg(F.count_distinct("from").alias("callers"))
    return cluster.weighted_graph(links, callers, spark.createDataFrame([], "a string, b string, cosine double"))


@query(f"with {_W} select * from w", "unit_links")
def weighted_graph(spark, d):
    return _weights(spark, d)


@query(f"with {_W} select least(x.node, y.node) as a, greatest(x.node, y.node) as b, round(round(sum(weight), 6), 4) as weight from w join membership x on x.unit = w.a join membership y on y.unit = w.b group by 1, 2", "membership", "unit_links")
def contract(spark, d):
    groups = membership(spark, d).select(F.col("unit").alias("item"), F.col("node").alias("group"))
    return cluster.contracted(_weights(spark, d), groups).withColumn("weight", F.round("weight", 4))


def _nation_graph(spark, d):
    directed = graph.rolled_up(unit_links(spark, d), membership(spark, d))
    return graph.ties(directed).withColumn("weight", F.col("count").cast("double"))


@query()
def louvain_groups(spark, d):
    """Communities of nations by what flows between them; the graph of nations has as many nodes as the tree has leaves."""
    w = _nation_graph(spark, d).select("a", "b", "weight")
    items = w.select(F.col("a").alias("item")).union(w.select("b")).distinct().withColumn("component", F.lit(0))
    return cluster.louvain_by_component(w, items, 1.0)


@query()
def skeleton_tree(spark, d):
    """Levels of communities: the nations' groups, then the groups' groups under one root."""
    first = louvain_groups(spark, d)
    w = cluster.contracted(_nation_graph(spark, d).select("a", "b", "weight"), first).filter("a <> b")
    items = first.select(F.col("group").alias("item")).distinct().withColumn("component", F.lit(0))
    second = cluster.louvain_by_component(w, items, 0.5).select(F.col("item").alias("group"), F.col("group").alias("top"))
    return first.join(second, "group", "left").select("item", "group", F.coalesce("top", "group").alias("top"), F.lit("root").alias("root"))


@query("select ordinal, path, case when s = 'src0' then 'core' else s end as area, language = 'en' as is_test from (select ordinal, path, language, split_part(path, '/', 1) as s from files)", "files")
def subsystem_assign(spark, d):
    s = F.split("path", "/")[0]
    return view(spark, d, "files").select("ordinal", "path", F.when(s == "src0", "core").otherwise(s).alias("area"), (F.col("language") == "en").alias("is_test"))


@query()
def batch_plan(spark, d):
    """Each area's files in reading batches of at most 25,000 characters."""
    files = view(spark, d, "files").select(F.split("path", "/")[0].alias("area"), "path", F.length("source").cast("long").alias("tokens"))
    return cluster.batches(files, 25_000)


@query()
def shape_repair(spark, d):
    """Nations' unit counts, small ones merged into those they are most tied to."""
    sizes = membership(spark, d).groupBy(F.col("node").alias("group")).agg(F.count("*").alias("n"))
    ties = _nation_graph(spark, d).select("a", "b", "weight")
    least = sizes.agg(F.percentile("n", F.lit(1 / 3)).cast("long")).first()[0]
    return cluster.merged_small(sizes, ties, least, 4 * least)


@query(
    "with given as (select kind as key, id as member from units where ordinal % 5 <> 0 union all select kind, id from units where ordinal % 50 = 1 union all select kind, 'x' || ordinal from units where ordinal % 100 = 2), g as (select key, member, count(*) as n from given group by 1, 2) select coalesce(m.kind, g.key) as key, count(*) filter (where g.n is null) as missing, count(*) filter (where g.n > 1) as repeated, count(*) filter (where m.id is null) as unknown from units m full join g on g.key = m.kind and g.member = m.id group by 1",
    "units",
)
def layer_partition_check(spark, d):
    u = view(spark, d, "units")
    given = u.filter("ordinal % 5 <> 0").selectExpr("kind as key", "id as member").unionByName(u.filter("ordinal % 50 = 1").selectExpr("kind as key", "id as member")).unionByName(u.filter("ordinal % 100 = 2").selectExpr("kind as key", "'x' || ordinal as member"))
    return cluster.partition_check(given, u.selectExpr("kind as key", "id as member"))


@query("select member, \"group\" from (select l.id as member, g.size % 7 as \"group\", row_number() over (partition by l.id order by count(*) desc, g.size % 7) as n from units l join units g on g.path = l.path and g.size % 5 <> 0 where l.size % 5 = 0 group by 1, 2) where n = 1", "units")
def candidate_overlap(spark, d):
    u = view(spark, d, "units")
    left = u.filter("size % 5 = 0").selectExpr("id as member", "path as candidate")
    return cluster.placed_by_overlap(left, u.filter("size % 5 <> 0").selectExpr("size % 7 as `group`", "id as member", "path as candidate"))


@query("with w as (select path, unnest(string_split(name, '_')) as word from units), t as (select path, word, count(*) as n, row_number() over (partition by path order by count(*) desc, word) as i from w group by 1, 2) select path, array_to_string(list(word order by i), ' ') || ' in ' || split_part(path, '/', 1) as title from t where i <= 2 group by path", "units")
def program_titles(spark, d):
    words = view(spark, d, "units").select("path", F.explode(F.split("name", "_")).alias("word")).groupBy("path", "word").agg(F.count("*").alias("n"))
    top = graph.top_per_key(words, "path", [F.desc("n"), "word"], 2)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"])
    return top.groupBy("path").agg(F.concat(F.array_join(listed, " "), F.lit(" in "), F.substring_index("path", "/", 1)).alias("title"))


_ANSWER = "'{\"units\":[{\"h\":[' || event_id % 7 || ',' || event_id % 5 || '],\"explain\":\"' || status || '\"}],\"notes\":\"n\"}'"


@query("select event_id, unnest(list_distinct([event_id % 7, event_id % 5])) as number, status as explain from task_events", "task_events")
def answer_decode(spark, d):
    answer = F.from_json(F.expr(_ANSWER), "units array<struct<h: array<bigint>, explain: string>>, notes string")
    units = view(spark, d, "task_events").select("event_id", F.explode(answer["units"]).alias("u"))
    return units.select("event_id", F.explode(F.array_distinct("u.h")).alias("number"), F.col("u.explain").alias("explain"))


@query("select id, name, kind from units where kind in ('economy', 'standard') and id not in (select target from edges where target is not null)", "units", "edges")
def detail_gaps(spark, d):
    u = view(spark, d, "units").filter(F.col("kind").isin("economy", "standard")).select("id", "name", "kind")
    return u.join(view(spark, d, "edges").select(F.col("target").alias("id")), "id", "left_anti")


@query("select id, case when size % 3 = 0 then 'unit' when size % 3 = 1 then 'grouped' else 'index_only' end as how, case when size % 3 = 1 then 'u' || (ordinal // 10 * 10) end as unit from units", "units")
def dispositions(spark, d):
    how = F.when(F.col("size") % 3 == 0, "unit").when(F.col("size") % 3 == 1, "grouped").otherwise("index_only")
    return view(spark, d, "units").select("id", how.alias("how"), F.when(how == "grouped", F.expr("'u' || (ordinal div 10 * 10)")).alias("unit"))


@query("select id, size, size - 30 as over from units where size > 30", "units")
def over_long_units(spark, d):
    return view(spark, d, "units").filter("size > 30").select("id", "size", (F.col("size") - 30).alias("over"))


@query("select path, run::bigint as run, min(ordinal) as first, max(ordinal) as last, kind from (select *, sum(fresh) over (partition by path order by ordinal) as run from (select *, case when lag(kind) over (partition by path order by ordinal) is not distinct from kind then 0 else 1 end as fresh from units)) group by path, run, kind", "units")
def coalesce_adjacent(spark, d):
    by = Window.partitionBy("path").orderBy("ordinal")
    own = view(spark, d, "units").withColumn("fresh", F.when(F.lag("kind").over(by).eqNullSafe(F.col("kind")), 0).otherwise(1)).withColumn("run", F.sum("fresh").over(by))
    return own.groupBy("path", "run", "kind").agg(F.min("ordinal").alias("first"), F.max("ordinal").alias("last")).select("path", "run", "first", "last", "kind")


@query("select id, count(*) as rows, count(distinct coalesce(source, '') || '>' || coalesce(target, '')) as ends, count(*) filter (where source = target) as loops from edges group by id having count(*) > 1 or count(*) filter (where source = target) > 0", "edges")
def graph_identity(spark, d):
    """Ids that stand for several rows, and edges from a node to itself."""
    by = view(spark, d, "edges").groupBy("id").agg(F.count("*").alias("rows"), F.count_distinct(F.concat(F.coalesce("source", F.lit("")), F.lit(">"), F.coalesce("target", F.lit("")))).alias("ends"), F.count_if(F.col("source") == F.col("target")).alias("loops"))
    return by.filter("rows > 1 or loops > 0")


@query("select source, resolved, ambiguous, unresolved, array_to_string(names[1:3], ',') as shown, greatest(len(names) - 3, 0) as omitted from (select source, count(*) filter (where status = 'resolved') as resolved, count(*) filter (where status = 'ambiguous') as ambiguous, count(*) filter (where status = 'unresolved') as unresolved, coalesce(list_sort(list(distinct target) filter (where target is not null)), []) as names from edges group by source)", "edges")
def graph_evidence_rows(spark, d):
    """Counts by status, three of the targets, and how many are left out."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("resolved", "ambiguous", "unresolved")]
    by = view(spark, d, "edges").groupBy("source").agg(*counts, F.sort_array(F.collect_set("target")).alias("names"))
    return by.select("source", "resolved", "ambiguous", "unresolved", F.array_join(F.slice("names", 1, 3), ",").alias("shown"), F.greatest(F.size("names").cast("long") - 3, F.lit(0)).cast("long").alias("omitted"))


_REL = "d as (select m.node as a, n.node as b, sum(count)::bigint as count from unit_links l join membership m on m.unit = l.\"from\" join membership n on n.unit = l.\"to\" where m.node <> n.node group by 1, 2), m as (select a.id as a, b.id as b from nodes a join nodes b on a.parent = b.parent where a.id < b.id and a.id like 'n%' and (substr(a.id, 2)::int + substr(b.id, 2)::int) % 3 = 0)"


@query(f"with {_REL} select coalesce(d.a, m.a) as a, coalesce(d.b, m.b) as b, coalesce(d.count, 0) as count, case when d.count > 0 and m.a is not null then 'graph_confirmed' else 'graph_only' end as source, r.count as reverse_count from d full join m on m.a = d.a and m.b = d.b left join d r on r.a = coalesce(d.b, m.b) and r.b = coalesce(d.a, m.a)", "nodes", "membership", "unit_links")
def relationship_view(spark, d):
    """Dependencies a model named and those the graph shows, with the counts of both directions."""
    directed = graph.rolled_up(unit_links(spark, d), membership(spark, d))
    n = nodes(spark, d).filter("id like 'n%'")
    a, b = n.select(F.col("id").alias("a"), "parent"), n.select(F.col("id").alias("b"), "parent")
    named = a.join(b, "parent").filter("a < b and (cast(substring(a, 2) as int) + cast(substring(b, 2) as int)) % 3 = 0").select("a", "b", F.lit(True).alias("_m"))
    both = directed.join(named, ["a", "b"], "full_outer").withColumn("source", F.when((F.col("count") > 0) & F.col("_m"), "graph_confirmed").otherwise("graph_only"))
    back = directed.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("count").alias("reverse_count"))
    return both.join(back, ["a", "b"], "left").select("a", "b", F.coalesce("count", F.lit(0)).alias("count"), "source", "reverse_count")


@query("select id, case when n = 1 and parent is not null then parent else id end as promoted from (select k.id, k.parent, (select count(*) from nodes c where c.parent = k.parent) as n from nodes k)", "nodes")
def tree_promote(spark, d):
    """An only child gives way to its parent."""
    t = nodes(spark, d)
    n = t.groupBy("parent").agg(F.count("*").alias("n"))
    return t.join(n, "parent", "left").select("id", F.when((F.col("n") == 1) & F.col("parent").isNotNull(), F.col("parent")).otherwise(F.col("id")).alias("promoted"))


@query("select node, unit, degree from (select node, unit, degree, row_number() over (partition by node order by degree desc, unit) as n from (select unit, sum(count)::bigint as degree from (select \"from\" as unit, count from unit_links union all select \"to\", count from unit_links) group by 1) join membership using (unit)) where n = 1", "membership", "unit_links")
def film_modules(spark, d):
    """The unit of the highest degree of each system."""
    deg = graph.degree(unit_links(spark, d)).join(membership(spark, d).select("unit", "node"), "unit")
    return graph.top_per_key(deg, "node", [F.desc("degree"), "unit"], 1).select("node", "unit", "degree")


@query("select node, unit, degree, round(sum(words / 2.03e0) over (order by degree desc, node), 3) as until from (select node, unit, degree, 10 + degree % 7 as words from (select node, unit, degree, row_number() over (partition by node order by degree desc, unit) as n from (select unit, sum(count)::bigint as degree from (select \"from\" as unit, count from unit_links union all select \"to\", count from unit_links) group by 1) join membership using (unit)) where n = 1)", "membership", "unit_links")
def film_plan(spark, d):
    """The chosen modules in order, with the seconds until each ends; as many rows as systems."""
    by = Window.partitionBy(F.lit(0)).orderBy(F.desc("degree"), "node")
    return film_modules(spark, d).select("node", "unit", "degree", F.round(F.sum((10 + F.col("degree") % 7) / 2.03).over(by), 3).alias("until"))


@query("select 'paths_unique' as \"check\", count(distinct path) = count(*) as ok from files union all select 'digests', count(*) filter (where digest <> md5(source)) = 0 from files union all select 'one_module', (select count(*) from (select id from units group by 1 having count(distinct path) > 1)) = 0 union all select 'no_unplanned', (select count(*) from edges where path not in (select path from units)) = 0", "files", "units", "edges")
def run_verify(spark, d):
    files, units, edges = view(spark, d, "files"), view(spark, d, "units"), view(spark, d, "edges")
    one = lambda name, ok: ok.select(F.lit(name).alias("check"), "ok")
    return (
        one("paths_unique", files.agg((F.count_distinct("path") == F.count("*")).alias("ok")))
        .unionByName(one("digests", files.agg((F.count_if(F.col("digest") != F.md5("source")) == 0).alias("ok"))))
        .unionByName(one("one_module", units.groupBy("id").agg(F.count_distinct("path").alias("n")).agg((F.count_if(F.col("n") > 1) == 0).alias("ok"))))
        .unionByName(one("no_unplanned", edges.join(units.select("path"), "path", "left_anti").agg((F.count("*") == 0).alias("ok"))))
    )


def _sources(spark, d):
    """Python sources made of the units: one module a file, a function a unit."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "name", "size"))), lambda x: F.concat(F.lit("def "), x["name"], F.lit("_"), x["ordinal"].cast("string"), F.lit("(a, b="), x["size"].cast("string"), F.lit("):\n    raise ValueError(b)\n")))
    return view(spark, d, "units").groupBy("path").agg(F.concat(F.lit("LIMIT = 3\n"), F.array_join(lines, "\n")).alias("source"))


@query("select path, 'constant' as kind, 'LIMIT' as symbol, '3' as text from units group by path union all select path, 'param_default', name || '_' || ordinal, 'b=' || size from units union all select path, 'raise', name || '_' || ordinal, 'ValueError(b)' from units", "units")
def python_facts(spark, d):
    return source_facts.python_facts(_sources(spark, d)).select("path", "kind", "symbol", "text")


@query("select path, 'function' as kind, name || '_' || ordinal as name from units", "units")
def python_declarations(spark, d):
    return source_facts.python_declarations(_sources(spark, d)).select("path", "kind", "name")


@query()
def token_counts(spark, d):
    return source_facts.token_counts(view(spark, d, "files").select("path", "source"), "/opt/tokenizers/byte_bpe_50k.tiktoken")


@query()
def token_sections(spark, d):
    """Tokens of each line group of the files, by the section that holds their first byte."""
    pieces = sequence.chunks(sequence.lines(view(spark, d, "files")), 20)
    named = pieces.select(F.concat_ws("#", "path", "chunk").alias("path"), F.col("text").alias("source"))
    return source_facts.token_counts(named, "/opt/tokenizers/byte_bpe_50k.tiktoken")


@query("select date_trunc('day', ts) as start, event_type, count(*) as n from events group by 1, 2")
def event_windows(spark, d):
    """The batch form of the windowed stream."""
    return load(spark, d, "events").groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("start"), "event_type").agg(F.count("*").alias("n"))


@query()
def event_stream_state(spark, d):
    """Users whose errors run to three, by a stateful stream read to its end."""
    from loomgrid.streaming import events

    return events.run_to_files(events.streaks(events.read_events(spark, f"{d}/events.parquet")))


@query("select page_id, lower(regexp_extract(url, '(\\.[^./?#]+)([?#].*)?$', 1)) as suffix, not regexp_matches(url, '/(build|dist|vendor|target)/') as included from pages")
def page_suffixes(spark, d):
    return load(spark, d, "pages").select("page_id", F.lower(F.regexp_extract("url", r"(\.[^./?#]+)([?#].*)?$", 1)).alias("suffix"), scan.included(F.col("url")).alias("included"))


