"""Texts of pages: prose and code, and scalar functions on names and messages."""

from pyspark.sql import functions as F

from loomgrid.functions import numstat, prose
from loomgrid.plans.registry import query
from loomgrid.sources.corpus import load, view

# every sentence is followed by a line with a link and a code span, and by a fence that opens or closes
_MARKED = "replace(replace(replace(replace(replace(replace(source, '`', ''), '~~~', ''), chr(9), ' '), chr(13), ' '), '    ', ' '), '. ', '.' || chr(10) || 'see [a](b) and `x](y)` too' || chr(10) || '```' || chr(10))"
_PIECES = f"p as (select ordinal, i, piece, i % 2 = 0 as code from (select ordinal, generate_subscripts(string_split({_MARKED}, chr(10) || '```' || chr(10)), 1) as i, unnest(string_split({_MARKED}, chr(10) || '```' || chr(10))) as piece from files))"


@query(f"with {_PIECES} select ordinal, md5(string_agg(case when code then piece else replace(replace(replace(piece, '`x](y)`', chr(1)), '](', ']\\('), chr(1), '`x](y)`') end, chr(10) || '```' || chr(10) order by i)) as digest from p group by ordinal", "files")
def literal_links(spark, d):
    """Links in the prose of every file made visible, code untouched."""
    return view(spark, d, "files").select("ordinal", F.md5(prose.literal_links(F.expr(_MARKED))).alias("digest"))


@query(f"with {_PIECES} select ordinal, md5(string_agg(case when code then '' else replace(piece, '`x](y)`', '') || case when i < n then chr(10) else '' end end, '' order by i)) as digest from (select *, max(i) over (partition by ordinal) as n from p) group by ordinal", "files")
def prose_for_links(spark, d):
    """The prose of every file alone."""
    return view(spark, d, "files").select("ordinal", F.md5(prose.prose_only(F.expr(_MARKED))).alias("digest"))


@query(
    "select 'c' || l_orderkey as sha, 'change ' || (l_orderkey % 7) as subject, case when l_linenumber % 3 = 2 then 'new/' else '' end || 'f' || l_partkey || '.py' as path, sum(cast(l_quantity as bigint) + l_linenumber)::bigint as lines, min(case when l_linenumber % 3 = 2 then 'f' || l_partkey || '.py' end) as renamed_from from lineitem where l_linenumber <> 4 group by all"
)
def numstat_rows(spark, d):
    """Changed lines per path of every order's lines as a commit, with renames and binary files."""
    path, old = F.expr("concat('f', l_partkey, '.py')"), F.col("l_linenumber") % 3 == 2
    counts = F.when(F.col("l_linenumber") == 4, F.lit("-\t-\t")).otherwise(F.concat(F.col("l_quantity").cast("bigint").cast("string"), F.lit("\t"), F.col("l_linenumber").cast("string"), F.lit("\t")))
    record = F.concat(F.lit("\n"), counts, F.when(old, F.concat(F.lit("\0"), path, F.lit("\0new/"), path)).otherwise(path))
    rows = load(spark, d, "lineitem").select("l_orderkey", record.alias("r"))
    blocks = rows.groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_list("r")), "\0").alias("r"))
    return numstat.numstat(blocks.select(F.concat(F.lit("c"), F.col("l_orderkey").cast("string"), F.expr("concat('\tchange ', l_orderkey % 7)"), F.lit("\0"), "r", F.lit("\0")).alias("block")))
