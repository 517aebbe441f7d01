"""The queries of this subpackage and their SQL, as __spark_entry__.py registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.llm import chat, decontaminate, divergence, jaccard, langid, licenses, mixing, ordered, periodic, quality, secrets, sharding, suffixes, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics and verdict of every document."""
    return quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of 50 words or more that documents share."""
    return suffixes.passages(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reads back from every formatted conversation, and from one that says the template's own marks."""
    said = "\\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.render(rows.unionByName(more)))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under a similarity of 0.9 of three-word shingles."""
    return jaccard.join(table(spark, sf_dir, "documents"), 3, 90)


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mixing.take(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    found = secrets.scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"] != secrets.ADDED)
    return found.select("doc_id", *(count(k) for k, *_ in secrets.KINDS), F.sha2(secrets.spelled(base), 256).alias("base_sha256"), secrets.spelled(F.col("spans")).alias("spans"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return sharding.assign(table(spark, sf_dir, "documents"))


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How every page's revisit resolves."""
    found = warc.resolve(warc.recrawl(table(spark, sf_dir, "pages")))
    told = F.array_join(F.transform("headers", lambda x: F.concat(x["name"], F.lit(": "), x["value"])), "\n")
    return found.select(F.expr("record_id div 2").alias("page_id"), "canonical_url", "outcome", F.expr("response_id div 2").alias("response_page_id"), F.sha2(told, 256).alias("headers_sha256"))


def held_out():
    """Whether a row is held out; one without doc_id is not, and teaches nothing."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(~held_out()))
    return langid.identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each source of a language is from the others, and which terms set it apart."""
    return divergence.audit(ordered.small_batches(table(spark, sf_dir, "documents")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest run of every document and digests of all, with repeats put into a tenth of the documents."""
    return periodic.longest(periodic.detect(periodic.planted(ordered.small_batches(table(spark, sf_dir, "documents")))))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and the licences that every document names."""
    found = licenses.scan(ordered.small_batches(table(spark, sf_dir, "documents")))
    at = F.transform("base", lambda s: s["first_word"])
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        licenses.labels("base").alias("base_labels"), licenses.labels("base", "found").alias("labels"), "score",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_suffix_dedup, op2_decontamination, op3_chat_format, op4_jaccard_join, op5_source_mix, op6_secret_scan, op7_sharding, op8_quality_rules, op9_warc_revisits, op10_language_id, op11_source_divergence, op12_periodic_runs, op13_license_scan)}

_SOURCE = "coalesce('0' || source, '1')"
_KEY = "('0x' || substr(md5({}), 1, 15))::bigint"

_OP5 = f"""
with recursive docs as (
  select doc_id, {_SOURCE} as src, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         {_KEY.format(f"'{mixing.SEED}|' || coalesce(doc_id::varchar, '')")} as k
  from documents),
sources as (
  select src, sum(size)::bigint as source_size, [3.0e0, 1.0e0, 2.0e0][((row_number() over (order by src) - 1) % 3 + 1)::int] as w from docs group by src),
levels as (
  select *, 2.0e0 * source_size as most,
         (1.5e0 * (sum(source_size) over ())::double - coalesce(sum(2.0e0 * source_size) over (order by 2.0e0 * source_size / w, src rows between unbounded preceding and 1 preceding), 0))
         / sum(w) over (order by 2.0e0 * source_size / w, src rows between current row and unbounded following) as level
  from sources),
plan as (
  select src, source_size, least(most, coalesce((select level from levels l where l.level * l.w < l.most order by l.most / l.w, l.src limit 1) * w, most)) as target from levels),
cuts as (
  select src, floor(target)::bigint as words, round(sum(floor(target)::bigint) over (order by src)::double / (sum(floor(target)::bigint) over ())::double * {1 << mixing.BITS}.0e0)::bigint as hi
  from plan where floor(target) > 0),
parts as (
  select *, coalesce(lag(hi) over (order by src), 0) as lo from cuts),
points as (
  select i as slot, list_sum([((i >> b) & 1) << ({mixing.BITS - 1} - b) for b in range({mixing.BITS})])::bigint as x
  from (select unnest(range((select (sum(words) // {mixing.BLOCK} + 1) * 2 + 1000 from cuts)::bigint)) as i)),
slots as (
  select slot, src, row_number() over (partition by src order by slot) - 1 as k from points join parts on x >= lo and x < hi),
placed as (
  select d.doc_id, d.src, d.size, p.source_size, p.target, floor(p.target)::bigint as words,
         (sum(d.size) over (partition by d.src order by d.k, d.doc_id rows unbounded preceding) - d.size)::bigint as at_word
  from docs d join plan p using (src)),
ends as (
  select *, (least(size, greatest(0, words - at_word)) + least(size, greatest(0, words - source_size - at_word)))::bigint as taken,
         case when words > source_size + at_word then least(source_size + at_word + size, words) else least(at_word + size, words) end - 1 as last_word
  from placed)
select doc_id, size, source_size, target, taken, a.slot as first_slot, b.slot as last_slot
from ends
left join slots a on a.src = ends.src and taken > 0 and a.k = at_word // {mixing.BLOCK}
left join slots b on b.src = ends.src and taken > 0 and b.k = last_word // {mixing.BLOCK}
"""

#: DuckDB has no crc32: the tests use this for the rest of op7's columns.
OP7_SHARDS = f"""
with docs as (
  select doc_id, {_SOURCE} as src, strlen(coalesce(text, ''))::bigint + 1 as size, coalesce(text, '') as body,
         {_KEY.format(f"'{sharding.SEED}|' || coalesce(text, '')")} as kt,
         {_KEY.format(f"'{sharding.SEED}|' || coalesce(doc_id::varchar, '')")} as kd
  from documents),
groups as (
  select kt, min(src) as home, count(*) as n from docs group by kt),
within as (
  select *, sum(n) over (partition by home order by kt) - n as r, sum(n) over (partition by home) as m from groups),
dealt as (
  select kt, sum(n) over (order by (2 * r + n)::double / (2 * m)::double, home, kt) - n as first, sum(n) over () as total from within),
placed as (
  select doc_id, size, first + row_number() over (partition by kt order by kd, doc_id) - 1 as p, total from docs join dealt using (kt))
select doc_id, size, (p * 8 // total)::int as shard, row_number() over (partition by p * 8 // total order by p) - 1 as slot from placed
"""

_OP9 = r"""
with parts as (
  select page_id, html, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as rest from pages),
named as (
  select page_id, html,
         regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), '^www[0-9]*\.', ''), ':(80|443)$', '') as host,
         regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') as path,
         list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda p: p <> '' and not regexp_matches(lower(p), '^(utm_[a-z]+|ref|fbclid|gclid|sid|sessionid)(=|$)'))) as q
  from parts),
crawl as (
  select page_id, md5(coalesce(html, '')) as tag, strlen(coalesce(html, '')) as n,
         host || case when path = '' then '/' else path end || case when len(q) > 0 then '?' || array_to_string(q, '&') else '' end as canonical_url
  from named),
latest as (
  select canonical_url, max(page_id) as response_page_id from crawl where n > 0 and canonical_url is not null group by canonical_url),
met as (
  select c.page_id, c.canonical_url, c.tag, l.response_page_id, r.n, case when r.page_id is null then 'no_response' when r.tag = c.tag then 'resolved' else 'mismatch' end as outcome
  from crawl c left join latest l using (canonical_url) left join crawl r on r.page_id = l.response_page_id)
select page_id, canonical_url, outcome, response_page_id,
       case when outcome = 'resolved' then sha256('content-length: ' || n || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || (page_id + 1000000000000) || chr(10) || 'etag: W/"' || tag || '"') end as headers_sha256
from met
"""

_OP11 = f"""
with docs as (
  select row_number() over () as d, coalesce(lang, '') as lang, coalesce(source, '') as source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as words
  from documents),
spoken as (
  select d, lang, source, unnest(words) as term from docs),
kept as (
  select lang, term, count(*) as n from spoken group by lang, term having count(distinct d) >= {divergence.MIN_DOCS}),
langs as (
  select lang, coalesce(sum(n), 0)::hugeint as total, count(n)::hugeint as v from (select distinct lang from docs) left join kept using (lang) group by lang),
groups as (
  select distinct lang, source from docs),
held as (
  select lang, source, term, count(*) as n from spoken semi join kept using (lang, term) group by all),
totals as (
  select lang, source, coalesce(sum(n), 0)::hugeint as total from groups left join held using (lang, source) group by all),
shares as (
  select g.lang, g.source, k.term, coalesce(h.n, 0) as n, 1 + 1000000000::hugeint * (coalesce(h.n, 0) + 5) // (t.total + 5 * l.v) as p, 1 + 1000000000::hugeint * (k.n + 5) // (l.total + 5 * l.v) as q
  from groups g join langs l using (lang) join totals t using (lang, source) join kept k on k.lang = g.lang left join held h on h.lang = g.lang and h.source = g.source and h.term = k.term),
pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, sum(abs(a.p - b.p)) as value
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
  union all
  select a.lang, a.source, 'pair', b.source, 0 from groups a join groups b on a.lang = b.lang and a.source <> b.source join langs l on l.lang = a.lang where l.v = 0),
terms as (
  select lang, source, 'term' as part, term as item, p - q as value from shares where n > 0 and p > q)
select lang, source, part, item, value::bigint as value, rank::int as rank
from (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (from pairs union all from terms))
where part = 'pair' or rank <= {divergence.TOP}
"""

ORACLE: dict[str, str] = {"op5_source_mix": _OP5, "op9_warc_revisits": _OP9, "op11_source_divergence": _OP11}
