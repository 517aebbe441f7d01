"""Source coordinates: what owns them, and bytes, characters and lines of texts."""

from pyspark.sql import functions as F

from loomgrid.operators import coordinates, sequence
from loomgrid.plans.registry import query
from loomgrid.plans.scans import _LINES
from loomgrid.sources.corpus import view

_EDGES = "select path || '#' || k as id, case when k % 2 = 0 then 'call' else 'import' end as kind, path || '/' || (k % 6) as source, case when k % 5 <> 4 then path end as path, 1 + (ordinal * 7 + k * 3) % 12 as line, case when k % 3 > 0 then 1 + (ordinal + k * 17) % 120 end as \"column\" from files, range(10) t(k)"
_NODES = "select path || '/' || k as id, path, 1 + k * 2 as start_line, case when k % 3 = 1 then path || '/' || (k - 1) end as owner from files, range(6) t(k)"


@query(
    f"""with {_LINES}, m as (select *, start_byte + strlen(line) + 1 as end_byte from n), e as ({_EDGES}), n1 as ({_NODES}),
    spot as (select e.id, case when e.kind = 'call' then coalesce(e.path, s.path) else coalesce(o.path, s.path) end as path, case when e.kind = 'call' then e.line else coalesce(o.start_line, s.start_line) end as line, case when e.kind = 'call' then e."column" end as col
      from e left join n1 s on s.id = e.source left join n1 o on o.id = s.owner),
    p as (select spot.id, spot.path, spot.line, n.start_byte + case when col is null then strlen(regexp_extract(n.line, '^[ \t]*')) else strlen(substr(n.line || chr(10), 1, col - 1)) end as point
      from spot join m n on n.path = spot.path and n.line_no = spot.line join files f on f.path = spot.path
      where col is null or col <= length(n.line) + case when n.end_byte > strlen(f.source) then 1 else 2 end),
    c as (select path, (line_no - 1) // 5 as chunk, min(start_byte) as s, max(end_byte) as e from m group by 1, 2)
    select p.id, p.path, p.line, p.point, c.path || '#' || c.chunk as owner, c.path || '~' || (c.chunk // 3) as unit from p join c on c.path = p.path and p.point >= c.s and p.point < c.e""",
    "files",
)
def query_edges_by_owner(spark, d):
    """Edges by the unit into which what owns their coordinate is folded: a call's line and column, else where its owner starts."""
    files = view(spark, d, "files")
    steps = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    edges = files.select("path", "ordinal", steps(10).alias("k")).select(
        F.expr("path || '#' || k as id"), F.expr("case when k % 2 = 0 then 'call' else 'import' end as kind"), F.expr("path || '/' || (k % 6) as source"), F.expr("case when k % 5 <> 4 then path end as path"),
        F.expr("1 + (ordinal * 7 + k * 3) % 12 as line"), F.expr("case when k % 3 > 0 then 1 + (ordinal + k * 17) % 120 end as `column`"),
    )
    nodes = files.select("path", steps(6).alias("k")).selectExpr("path || '/' || k as id", "path", "1 + k * 2 as start_line", "case when k % 3 = 1 then path || '/' || (k - 1) end as owner")
    index = coordinates.line_index(files)
    # files of one text are few lines of any length; chunks are runs of five lines
    pieces = index.groupBy("path", F.expr("(line_no - 1) div 5").alias("chunk")).agg(F.min("start_byte").alias("start_byte"), (F.max("end_byte") + 1).alias("_end"), F.max("end_byte").alias("end_byte"))
    size = files.select("path", F.octet_length("source").cast("long").alias("_size"))
    ranges = pieces.join(size, "path").select("path", F.concat_ws("#", "path", "chunk").alias("range_id"), "start_byte", F.when(F.col("end_byte") == F.col("_size"), F.col("_end")).otherwise(F.col("end_byte")).alias("end_byte"), F.col("chunk").alias("ordinal"))
    found = coordinates.owners(coordinates.edge_coordinates(edges, nodes), index, ranges)
    return found.select("id", "path", "line", "point", "owner", F.expr("path || '~' || (cast(substring_index(owner, '#', -1) as bigint) div 3) as unit"))


@query(
    """with c as (select path, source, unnest(string_split(source, '')) as ch, generate_subscripts(string_split(source, ''), 1) as i from files where length(source) > 0),
    w as (select path, i - 1 as char, sum(strlen(ch)) over (partition by path order by i) - strlen(ch) as s, sum(strlen(ch)) over (partition by path order by i) as e from c),
    p as (select distinct path, (strlen(source) * k // 10)::bigint as point, strlen(source) as size, length(source) as n from files, range(11) t(k))
    select p.path, p.point, coalesce(w.char, p.n)::bigint as char from p left join w on w.path = p.path and p.point >= w.s and p.point < w.e""",
    "files",
)
def bytes_to_chars(spark, d):
    """The character at eleven bytes of every file, its end among them."""
    files = view(spark, d, "files")
    at = files.select("path", F.explode(F.expr("transform(sequence(0L, 10L), k -> octet_length(source) * k div 10)")).alias("point")).distinct()
    return coordinates.chars_of_bytes(at, coordinates.line_index(files)).select("path", "point", "char")


_BROKEN = "replace(replace(source, '. ', '.' || chr(13) || chr(10)), ', ', ',' || chr(13))"


@query(f"with t as (select path, replace(replace({_BROKEN}, chr(13) || chr(10), chr(1) || chr(10)), chr(13), chr(10)) as s from files), l as (select path, generate_subscripts(string_split(s, chr(10)), 1) as line_no, unnest(string_split(s, chr(10))) as line from t) select path, line_no, coalesce(sum(length(line) + 1) over (partition by path order by line_no rows between unbounded preceding and 1 preceding), 0)::bigint as start_char from l", "files")
def line_starts_any_break(spark, d):
    """Where the lines of every file start, in characters, if LF, CR and CRLF all end one."""
    return coordinates.line_index(view(spark, d, "files").withColumn("source", F.expr(_BROKEN)), any_break=True).select("path", "line_no", "start_char")
