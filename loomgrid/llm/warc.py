"""Not-modified revisit resolution: an as-of join of WARC revisits to full responses.

A crawler that is told "304 Not Modified" stores a revisit record without a body.
Here each revisit finds the latest strictly earlier full response of the same
canonical URL; its validators are checked (an ETag by weak comparison, else
Last-Modified, and a payload digest if there is one), and the response's headers
are merged with those that a 304 may update.

One URL may hold a third of all records. Rows are dealt by ranges of (URL, time),
so that such a URL covers many partitions; the join runs within each partition,
and the latest response of earlier partitions, one row per partition and URL, is
joined on.

Outcomes: `resolved`, `unverified` (no validator on either side to compare),
`mismatch` (the response is another version) and `no_response`. Defined results:
a null URL matches nothing; a null time comes before all others and so has no
earlier response. Of responses at one time the one of the highest record_id
counts. A response that is not complete (`status` other than 200) is no full one.
Repeated rows give their results each. An empty table gives no rows. Header names
are compared in lower case. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.llm.ordered import cut, parts

#: Headers that a 304 response updates (RFC 9110, 15.4.5), with Last-Modified.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
#: Query parameters that name a visit, not a page.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid|sid|sessionid)(=|$)"


def canonical(url: Column) -> Column:
    """Host without www and default port in lower case, path without trailing slashes, other parameters sorted; no scheme or fragment."""
    rest = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, "^[^/?]*", 0)), r"^www[0-9]*\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    return F.concat(host, F.when(path == "", F.lit("/")).otherwise(path), F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(F.lit("")))


def _headers(headers: Column) -> Column:
    """name and value by name; of one name the last value by code point."""
    pairs = F.array_sort(F.transform(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))), lambda x: F.struct(F.lower(x["key"]).alias("name"), F.coalesce(x["value"], F.lit("")).alias("value"))))
    return F.filter(pairs, lambda x, i: ~F.coalesce(F.get(pairs, i + 1)["name"] == x["name"], F.lit(False)))


def _value(pairs: Column, name: str) -> Column:
    return F.get(F.filter(pairs, lambda x: x["name"] == name), F.lit(0))["value"]


def resolve(records: DataFrame) -> DataFrame:
    """record_id, canonical_url, outcome, response_id and headers (name and value by name) of each revisit.

    records: record_id long, url string, at long, kind `response` or `revisit`, status int, headers map<string,string>, digest string.
    """
    rows = records.select("record_id", canonical(F.col("url")).alias("canonical_url"), "at", "kind", "status", _headers(F.col("headers")).alias("headers"), "digest")
    full = (F.col("kind") == "response") & (F.col("status") == 200) & F.col("canonical_url").isNotNull() & F.col("at").isNotNull()
    rows = rows.withColumn("_full", F.when(full, F.struct("at", "record_id", "headers", "digest"))).withColumn("_late", F.when(F.col("kind") == "revisit", 0).otherwise(1))
    rows = rows.filter("_full is not null or kind = 'revisit'").select("record_id", "canonical_url", "at", "headers", "digest", "_full", "_late")
    # at one time revisits come first, so that no response of that time is in a partition before them
    dealt = cut(rows.repartitionByRange(parts(rows), "canonical_url", "at", "_late", "record_id").withColumn("_part", F.spark_partition_id()))
    near = Window.partitionBy("_part", "canonical_url").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    far = Window.partitionBy("canonical_url").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = dealt.groupBy("_part", "canonical_url").agg(F.max("_full").alias("_end")).withColumn("_end", F.max("_end").over(far)).filter("_end is not null")
    own = dealt.withColumn("_near", F.max("_full").over(near)).filter("_late = 0")
    met = own.join(carried, ["_part", "canonical_url"], "left").withColumn("_r", F.when(F.col("canonical_url").isNotNull() & F.col("at").isNotNull(), F.coalesce("_near", "_end")))
    theirs = F.col("_r.headers")

    def same(name: str, weak: bool = False) -> Column:
        a, b = _value(F.col("headers"), name), _value(theirs, name)
        return F.regexp_replace(a, "^W/", "") == F.regexp_replace(b, "^W/", "") if weak else a == b

    checks = [F.coalesce(same("etag", True), same("last-modified")), F.col("digest") == F.col("_r.digest")]
    wrong = F.coalesce(~checks[0], F.lit(False)) | F.coalesce(~checks[1], F.lit(False))
    outcome = F.when(F.col("_r").isNull(), "no_response").when(wrong, "mismatch").when(checks[0].isNull() & checks[1].isNull(), "unverified").otherwise("resolved")
    fresh = F.filter("headers", lambda x: x["name"].isin(PERMITTED))
    kept = F.filter(theirs, lambda x: ~F.exists(fresh, lambda y: y["name"] == x["name"]))
    merged = F.when(outcome.isin("resolved", "unverified"), F.array_sort(F.concat(kept, fresh)))
    return met.select("record_id", "canonical_url", outcome.alias("outcome"), F.when(outcome != "no_response", F.col("_r.record_id")).alias("response_id"), merged.alias("headers"))


def recrawl(pages: DataFrame, later: int = 1_000_000_000_000) -> DataFrame:
    """Records of a crawl and of a second one in which every page is said not to be modified.

    A page is a response (record_id 2 * page_id, at page_id; a null or empty body
    is none) and then a revisit (2 * page_id + 1, at page_id + later) with the ETag
    of what the first crawl got; where another page of that URL came later, the
    latest response is another version.
    """
    etag = F.concat(F.lit('"'), F.md5(F.coalesce(F.col("html"), F.lit(""))), F.lit('"'))
    first = pages.select(
        (2 * F.col("page_id")).alias("record_id"), "url", F.col("page_id").alias("at"), F.lit("response").alias("kind"), F.when(F.coalesce(F.length("html"), F.lit(0)) > 0, 200).otherwise(204).alias("status"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.octet_length(F.coalesce(F.col("html"), F.lit(""))).cast("string"), F.lit("ETag"), etag, F.lit("Date"), F.col("page_id").cast("string")).alias("headers"),
    )
    second = pages.select(
        (2 * F.col("page_id") + 1).alias("record_id"), "url", (F.col("page_id") + later).alias("at"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"),
        F.create_map(F.lit("Content-Length"), F.lit("0"), F.lit("ETag"), F.concat(F.lit("W/"), etag), F.lit("Date"), (F.col("page_id") + later).cast("string"), F.lit("X-Cache"), F.lit("hit")).alias("headers"),
    )
    return first.unionByName(second).withColumn("digest", F.lit(None).cast("string"))
