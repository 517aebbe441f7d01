"""Scans, predicates, manifests, drift and set operations."""

from pyspark.sql import functions as F

from loomgrid.operators import scan, sequence
from loomgrid.plans.registry import query
from loomgrid.sources.corpus import load, view


@query("select path, language, sha256(source) as sha256 from files where language in ('en', 'fr')", "files")
def files_manifest(spark, d):
    return scan.manifest(view(spark, d, "files"), ["en", "fr"])


@query("select path, language, case when ordinal % 3 = 0 then 'tests/' || path else path end as placed, ordinal % 3 = 0 as is_test from files", "files")
def test_split(spark, d):
    placed = view(spark, d, "files").select("path", "language", F.expr("case when ordinal % 3 = 0 then 'tests/' || path else path end").alias("placed"))
    return placed.withColumn("is_test", scan.is_test(F.col("placed")))


@query("select page_id, url, regexp_extract(url, '([^/?#]*)([?#].*)?$', 1) as name from pages where regexp_matches(url, '\\.(html|json|toml)([?#].*)?$')")
def config_manifest(spark, d):
    return load(spark, d, "pages").filter(F.col("url").rlike(r"\.(html|json|toml)([?#].*)?$")).select("page_id", "url", F.regexp_extract("url", r"([^/?#]*)([?#].*)?$", 1).alias("name"))


@query("select path, strlen(source)::bigint as bytes, 'skipped' as state from files where strlen(source) > 20000 union all select path, strlen(source)::bigint, 'read' from files where strlen(source) <= 20000", "files")
def oversize_diagnostics(spark, d):
    sized = view(spark, d, "files").select("path", F.octet_length("source").cast("long").alias("bytes"))
    return sized.filter("bytes > 20000").withColumn("state", F.lit("skipped")).unionByName(sized.filter("bytes <= 20000").withColumn("state", F.lit("read")))


@query(
    """select ordinal, path, case lower(regexp_extract(path, '(\\.[^./]+)$', 1)) when '.py' then 'python' when '.0' then 'zero' else substr(lower(regexp_extract(path, '(\\.[^./]+)$', 1)), 2) end as language
    from (select ordinal, replace(path, '.txt', case ordinal % 4 when 0 then '.TXT' when 1 then '.py' when 2 then '.xyz' else '' end) as path from files)""",
    "files",
)
def language_lookup(spark, d):
    files = view(spark, d, "files").select("ordinal", F.expr("replace(path, '.txt', case ordinal % 4 when 0 then '.TXT' when 1 then '.py' when 2 then '.xyz' else '' end)").alias("path"))
    registered = spark.createDataFrame([(s, n, i) for i, (s, n) in enumerate([(".py", "snake"), *scan.LANGUAGES])], "suffix string, language string, ordinal int")
    return scan.with_language(files, registered).select("ordinal", "path", "language")


@query(
    """with recursive asked as (
      select page_id, case page_id % 5 when 0 then './a//b/' || page_id when 1 then 'x/../y/' || page_id when 2 then '/abs/' || page_id when 3 then '../up/' || page_id else 'p\\q\\..\\' || page_id end as asked from pages),
    steps as (select page_id, asked, string_split(replace(asked, '\\', '/'), '/') as s from asked),
    walk as (
      select page_id, asked, s, 1 as i, []::varchar[] as kept, true as ok from steps
      union all
      select page_id, asked, s, i + 1, case when s[i] in ('', '.') then kept when s[i] = '..' then kept[:-2] else list_append(kept, s[i]) end, ok and not (s[i] = '..' and len(kept) = 0) from walk where i <= len(s))
    select page_id, asked, case when regexp_matches(asked, '^([/\\\\]|[A-Za-z]:)') or not ok or len(kept) = 0 then null else array_to_string(kept, '/') end as canonical from walk where i = len(s) + 1"""
)
def path_canonical(spark, d):
    asked = load(spark, d, "pages").select("page_id", F.expr(r"case page_id % 5 when 0 then './a//b/' || page_id when 1 then 'x/../y/' || page_id when 2 then '/abs/' || page_id when 3 then '../up/' || page_id else 'p\\q\\..\\' || page_id end").alias("asked"))
    return asked.withColumn("canonical", scan.canonical_path(F.col("asked")))


_AFTER = "after_files as (select ordinal, path, case when ordinal % 7 = 0 then md5(digest) else digest end as digest from files where ordinal % 11 <> 0 union all select ordinal, 'new/' || path, digest from files where ordinal % 13 = 0)"


def _after(spark, d):
    files = view(spark, d, "files").select("ordinal", "path", "digest")
    kept = files.filter("ordinal % 11 <> 0").withColumn("digest", F.expr("case when ordinal % 7 = 0 then md5(digest) else digest end"))
    return kept.unionByName(files.filter("ordinal % 13 = 0").withColumn("path", F.concat(F.lit("new/"), "path")))


_DRIFT = "case when b.path is null then 'removed' when a.path is null then 'added' else 'changed' end"


@query(f"with {_AFTER} select coalesce(a.path, b.path) as path, {_DRIFT} as change from files a full join after_files b on a.path = b.path where a.digest is distinct from b.digest", "files")
def drift(spark, d):
    return scan.drift(view(spark, d, "files"), _after(spark, d))


@query(
    f"with {_AFTER}, gone as (select a.path, {_DRIFT} as change from files a left join after_files b on a.path = b.path where a.digest is distinct from b.digest) select ordinal, url, 'src' || (ordinal % 20) as source from (select page_id as ordinal, url, page_id from pages) p where exists (select 1 from gone g join files f using (path) where f.ordinal = p.page_id)",
    "files",
)
def stale_pages(spark, d):
    changes = scan.drift(view(spark, d, "files"), _after(spark, d))
    paths = view(spark, d, "files").select("ordinal", "path")
    pages = load(spark, d, "pages").select(F.col("page_id").alias("ordinal"), "url").join(paths, "ordinal")
    return scan.stale(pages, changes).select("ordinal", "url", F.expr("'src' || (ordinal % 20)").alias("source"))


@query("select distinct e.path from edges e where e.path in (select path from units) and e.path not in (select path from units where size > 48)", "edges", "units")
def unmanifested(spark, d):
    units = view(spark, d, "units")
    anchors = view(spark, d, "edges").select("path").distinct()
    return anchors.join(units.select("path"), "path", "left_semi").join(units.filter("size > 48").select("path"), "path", "left_anti")


@query("select task, event_id, status, tokens from (select *, row_number() over (partition by task, status order by ts desc, event_id desc) as n from task_events) where n = 1", "task_events")
def ledger_latest_row(spark, d):
    return sequence.first_wins(view(spark, d, "task_events"), ["task", "status"], [F.desc("ts"), F.desc("event_id")]).select("task", "event_id", "status", "tokens")


@query("select event_id, try_cast(json_extract_string(case when event_id % 9 = 0 then replace(props, '}', '') else props end, '$.k') as bigint) as k from task_events where event_id % 9 <> 0", "task_events")
def transcript_malformed(spark, d):
    """Lines that are no JSON are left out."""
    rows = view(spark, d, "task_events").select("event_id", F.expr("case when event_id % 9 = 0 then replace(props, '}', '') else props end").alias("line"))
    return rows.withColumn("_v", F.from_json("line", "k long, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})).filter("_v._corrupt is null").select("event_id", F.col("_v.k").alias("k"))


_TITLES = "case when o_orderpriority like '1-%' then 'fix' when o_orderpriority like '2-%' then 'feature' when o_orderpriority like '5-%' then 'docs' else 'other' end"


@query(f"select {_TITLES} as category, count(*) as commits, count(*) filter (where o_orderstatus = 'F') as merged, sum(n)::bigint as files from orders join (select l_orderkey, count(distinct l_partkey) as n from lineitem group by 1) on l_orderkey = o_orderkey where n between 2 and 15 group by 1")
def commit_funnel(spark, d):
    sizes = view(spark, d, "commit_files").groupBy("commit_id").agg(F.count_distinct("file").alias("n")).filter("n between 2 and 15")
    met = load(spark, d, "orders").join(sizes, F.col("o_orderkey") == F.col("commit_id"))
    return met.groupBy(F.expr(_TITLES).alias("category")).agg(F.count("*").alias("commits"), F.count_if(F.col("o_orderstatus") == "F").alias("merged"), F.sum("n").alias("files"))


_REASON = "case when kind = 'import' then 'import_statement' when weight < 5 then 'operator' when weight % 7 = 0 then 'synthetic' when line % 5 = 0 then 'literal' when status = 'unresolved' and weight > 45 then 'macro' end"


@query(f"select id, source, line, weight, {_REASON} as reason, exists (select 1 from edges i where i.kind = 'import' and i.path = e.path and i.line = e.line) as on_import_line from edges e where kind = 'call'", "edges")
def call_reason(spark, d):
    """The reason why a call row is no call, and whether an import stands on its line."""
    edges = view(spark, d, "edges")
    lines = edges.filter("kind = 'import'").select("path", "line", F.lit(True).alias("_hit")).distinct()
    return edges.filter("kind = 'call'").join(lines, ["path", "line"], "left").select("id", "source", "line", "weight", F.expr(_REASON).alias("reason"), F.coalesce("_hit", F.lit(False)).alias("on_import_line"))


@query("select ordinal, replace(path, 'src1', '<repo>') as path, replace(source, 'the', '<repo>') as text from files", "files")
def scrub_text(spark, d):
    return view(spark, d, "files").select("ordinal", scan.scrub(F.col("path"), "src1").alias("path"), scan.scrub(F.col("source"), "the").alias("text"))


@query("select event_id, case when c in ('click', 'view', 'error') then c else 'other' end as choice from (select event_id, case when event_id % 4 = 0 then json_extract_string('[\"' || status || '\"]', '$[0]') when event_id % 4 = 1 then upper(status) else status end as c from task_events)", "task_events")
def enum_repair(spark, d):
    """A valid choice stays, a list of one is unwrapped, anything else becomes the default."""
    raw = F.expr("case when event_id % 4 = 0 then '[\"' || status || '\"]' when event_id % 4 = 1 then upper(status) else status end")
    one = F.when(raw.startswith("["), F.get(F.from_json(raw, "array<string>"), F.lit(0))).otherwise(raw)
    return view(spark, d, "task_events").select("event_id", F.when(one.isin("click", "view", "error"), one).otherwise("other").alias("choice"))


@query("select id, source, target, kind, line from (select *, row_number() over (partition by id, source, target, kind order by ordinal, line, weight) as n from edges) where n = 1", "edges")
def graph_merge_first_wins(spark, d):
    return sequence.first_wins(view(spark, d, "edges"), ["id", "source", "target", "kind"], ["ordinal", "line", "weight"]).select("id", "source", "target", "kind", "line")


@query("select conv_id, role, turn, length(text)::bigint as chars from (select *, row_number() over (partition by conv_id, role order by turn, text) as n from turns) where n = 1", "turns")
def answer_first_wins(spark, d):
    return sequence.first_wins(view(spark, d, "turns"), ["conv_id", "role"], ["turn", "text"]).select("conv_id", "role", "turn", F.length("text").cast("long").alias("chars"))


_SPANS = "select path, greatest(line - 1, 1) as s, line + 1 + weight % 3 as e from edges"


@query(
    f"""with s as ({_SPANS}), m as (select *, case when s > coalesce(max(e) over (partition by path order by s, e rows between unbounded preceding and 1 preceding) + 1, -1) then 1 else 0 end as fresh from s),
    i as (select *, sum(fresh) over (partition by path order by s, e rows unbounded preceding) as island from m) select path, min(s)::bigint as start_line, max(e)::bigint as end_line from i group by path, island""",
    "edges",
)
def span_merge(spark, d):
    rows = view(spark, d, "edges").select("path", F.col("line").alias("start_line"), F.expr("line + weight % 3").alias("end_line"))
    return sequence.merge_spans(rows, "path", context=1)


_LINES = """l as (select path, generate_subscripts(string_split(source, chr(10)), 1) as line_no, unnest(string_split(source, chr(10))) as line from files),
 n as (select path, line_no::bigint as line_no, line, coalesce(sum(strlen(line) + 1) over (partition by path order by line_no rows between unbounded preceding and 1 preceding), 0)::bigint as start_byte from l)"""


@query(f"with {_LINES} select path, line_no, line, start_byte, start_byte + strlen(line) + 1 as end_byte from n", "files")
def line_offsets(spark, d):
    return sequence.lines(view(spark, d, "files"))


@query(f"with {_LINES}, c as (select path, (line_no - 1) // 5 as chunk, min(start_byte) as s, max(start_byte + strlen(line) + 1) as e from n group by 1, 2), k as (select *, s = coalesce(lag(e) over (partition by path order by s), 0) as ok from c) select path, bool_and(ok) as contiguous, max(e) as length, count(*) as pieces from k group by path", "files")
def partition_check(spark, d):
    return sequence.contiguous(sequence.chunks(sequence.lines(view(spark, d, "files")), 5), "path")


@query("select path, sha256(source) as sha256, true as same from files", "files")
def reassemble_digest(spark, d):
    files = view(spark, d, "files")
    whole = sequence.assembled(sequence.chunks(sequence.lines(files), 5), "path", "start_line", "text")
    return whole.join(files.select("path", "source"), "path").select("path", "sha256", (F.col("whole") == F.col("source")).alias("same"))


@query(
    f"""with {_LINES}, c as (select path, (line_no - 1) // 5 as chunk, min(start_byte) as s, max(start_byte + strlen(line) + 1) as e from n group by 1, 2),
    p as (select path, (strlen(source) * k // 10)::bigint as point from files, range(10) t(k)) select p.path, p.point, c.path || '#' || c.chunk as owner from p join c on c.path = p.path and p.point >= c.s and p.point < c.e""",
    "files",
)
def ownership_range_join(spark, d):
    files = view(spark, d, "files")
    ranges = sequence.chunks(sequence.lines(files), 5).select("path", F.concat_ws("#", "path", "chunk").alias("range_id"), "start_byte", "end_byte", F.col("chunk").alias("ordinal"))
    points = files.select("path", F.explode(F.expr("transform(sequence(0L, 9L), k -> octet_length(source) * k div 10)")).alias("point"))
    return sequence.owner_of_points(points.select("path", "point").distinct(), ranges).join(points, ["path", "point"])


@query(
    f"""with {_LINES}, c as (select path, (line_no - 1) // 5 as chunk, min(start_byte) as s, max(start_byte + strlen(line) + 1) as e from n group by 1, 2), t as (select * from c where chunk % 3 = 1),
    w as (select path, max(e) as length from c group by 1), r as (select path, s, e from t union all select path, length, length from w),
    g as (select *, coalesce(max(e) over (partition by path order by s, e rows between unbounded preceding and 1 preceding), 0) as f from r) select path, f::bigint as start_byte, s as end_byte from g where s > f""",
    "files",
)
def range_subtract(spark, d):
    pieces = sequence.chunks(sequence.lines(view(spark, d, "files")), 5)
    return sequence.holes(pieces.groupBy("path").agg(F.max("end_byte").alias("length")), pieces.filter("chunk % 3 = 1"), "path")


@query("select path, row_number() over (partition by path order by start_line, ordinal) as number, id from units", "units")
def batch_numbers(spark, d):
    from pyspark.sql import Window

    return view(spark, d, "units").select("path", F.row_number().over(Window.partitionBy("path").orderBy("start_line", "ordinal")).cast("long").alias("number"), "id")


@query("select task, run, value, length from (select task, run::bigint as run, value, count(*) as length from (select *, sum(fresh) over (partition by task order by ts, event_id rows unbounded preceding) as run from (select task, ts, event_id, status = 'error' as value, case when lag(status = 'error') over (partition by task order by ts, event_id) is not distinct from (status = 'error') then 0 else 1 end as fresh from task_events)) group by 1, 2, 3) where value and length >= 3", "task_events")
def limit_streak(spark, d):
    """Three errors in a row or more."""
    return sequence.runs(view(spark, d, "task_events"), "task", ["ts", "event_id"], F.col("status") == "error").filter("value and length >= 3").select("task", "run", "value", "length")


@query(
    """with recursive o as (select task, event_id, tokens, row_number() over (partition by task order by event_id) as i from task_events),
    w as (select task, event_id, tokens, i, tokens as used, 1 as n, 0 as chunk from o where i = 1
      union all select o.task, o.event_id, o.tokens, o.i, case when w.used + o.tokens > 60000 or w.n >= 12 then o.tokens else w.used + o.tokens end, case when w.used + o.tokens > 60000 or w.n >= 12 then 1 else w.n + 1 end, case when w.used + o.tokens > 60000 or w.n >= 12 then w.chunk + 1 else w.chunk end from w join o on o.task = w.task and o.i = w.i + 1)
    select task, event_id, tokens, chunk from w""",
    "task_events",
)
def layer_chunks_budget(spark, d):
    return sequence.budget_chunks(view(spark, d, "task_events"), "task", "event_id", "tokens", 60000, 12)


@query("select task, event_id, tokens, spent from (select *, (sum(tokens) over (partition by task order by event_id rows unbounded preceding))::bigint as spent from task_events) where spent <= 100000", "task_events")
def budget_prefix(spark, d):
    return sequence.budget_prefix(view(spark, d, "task_events"), "task", ["event_id"], "tokens", 100000).select("task", "event_id", "tokens", "spent")


@query("select id, (select count(*) from commit_files c where c.file = u.ordinal) as seen from units u where ordinal in (select file from commit_files) except all select id, 0 from units where size > 40", "units", "commit_files")
def coverage_sets(spark, d):
    seen = view(spark, d, "commit_files").groupBy(F.col("file").alias("ordinal")).agg(F.count("*").alias("seen"))
    units = view(spark, d, "units")
    return units.join(seen, "ordinal").select("id", "seen").exceptAll(units.filter("size > 40").select("id", F.lit(0).cast("long").alias("seen")))


@query("select conv_id, list_distinct_in_order as roles from (select conv_id, array_to_string(list(role order by first_turn), ',') as list_distinct_in_order from (select conv_id, role, min(turn) as first_turn from turns group by 1, 2) group by 1)", "turns")
def ordered_distinct(spark, d):
    roles = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    return view(spark, d, "turns").groupBy("conv_id").agg(F.array_join(F.array_distinct(roles), ",").alias("roles"))
