"""Look-ups over a catalogue: find, resolve, query and source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.functions.text import first_words
from loomgrid.operators.sequence import merge_spans


def find(records: DataFrame, term: str, fields: list[str], limit: int = 25) -> DataFrame:
    """Records any of whose fields holds the term, whatever the case, with the fields that do.

    Exact names come first, then the catalogue's order; rank says so.
    """
    term = term.lower()
    hits = F.filter(F.array(*(F.when(F.contains(F.lower(F.col(f).cast("string")), F.lit(term)), F.lit(f)) for f in fields)), lambda f: f.isNotNull())
    found = records.withColumn("matched_fields", hits).filter(F.size("matched_fields") > 0)
    exact = (F.lower("name") == term) | (F.lower("id") == term)
    return found.withColumn("exact", exact).orderBy(F.desc("exact"), "ordinal").limit(limit).withColumn("summary", first_words(F.col("summary"), 25))


def resolve(asked: DataFrame, steps: list[tuple[str, DataFrame]]) -> DataFrame:
    """For each term the ids of the first step with a match; ambiguous if they are several. steps: name and a table of term and id."""
    rows = reduce(DataFrame.unionByName, (t.select("term", "id", F.lit(i).alias("_i"), F.lit(n).alias("step")) for i, (n, t) in enumerate(steps)))
    met = asked.join(rows, "term", "left")
    first = met.groupBy("term").agg(F.min("_i").alias("_f"))
    own = met.join(first, "term").filter(F.col("_i").eqNullSafe(F.col("_f")))
    return own.groupBy("term").agg(F.first("step").alias("step"), F.count_distinct("id").alias("matches"), F.when(F.count_distinct("id") == 1, F.min("id")).alias("id"))


def catalog(symbols: DataFrame, units: DataFrame, dispositions: DataFrame) -> DataFrame:
    """Symbols with their unit's detail and how they were placed; a disposition overrides a unit, which overrides the symbol."""
    joined = symbols.join(units.select("id", F.col("kind").alias("_uk"), F.col("explain").alias("_ue")), "id", "left").join(dispositions.select("id", "how", "reason"), "id", "left")
    return joined.select("id", "name", F.coalesce("_uk", "kind").alias("kind"), F.coalesce("how", F.when(F.col("_ue").isNotNull(), "unit"), F.lit("index_only")).alias("how"), F.coalesce("reason", "_ue", F.lit("")).alias("detail"))


def source_lines(lines: DataFrame, spans: DataFrame, context: int = 0) -> DataFrame:
    """Numbered lines of merged spans; lines: path, line_no, line. Spans beyond the file are cut."""
    merged = merge_spans(spans, "path", context=context)
    each = merged.select("path", F.explode(F.sequence("start_line", "end_line")).alias("line_no")).distinct()
    return lines.join(each, ["path", "line_no"])


def rendered_ranges(path: Column, start: Column, end: Column) -> Column:
    return F.concat(path, F.lit(":L"), start.cast("string"), F.when(end > start, F.concat(F.lit("-L"), end.cast("string"))).otherwise(F.lit("")))
