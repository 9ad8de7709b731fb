"""Not-modified revisits of web archives (operator 2).

A revisit record says that a page hadn't changed. It is resolved by an as-of join to the latest
full response of the same canonical URL with an earlier time; the validators must agree (ETag if
the revisit has one, else Last-Modified), and the headers that a 304 answer may update replace
those of the full response.

The as-of join is a fill-forward over records in order of URL and time. Records are ranged by
(URL, time), so one URL with many captures spreads over many parts; inside a part a window finds
the latest full response, and what a part inherits from the parts before it follows from one
summary row per part.

Defined cases: a record without URL or time can't be placed and, if a revisit, is ``unplaced``;
of full responses at the same time the greatest record id counts; a response at the revisit's own
time isn't earlier; without an earlier response a revisit is ``orphan``, with other validators
``modified``, without validators ``unverified``; header names are case-insensitive and the last of
repeated names counts; rows that repeat return each; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

# Fields that a 304 answer may carry for the stored response (RFC 9110, 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")

HEADERS = "array<struct<name:string,value:string>>"
FULL = f"struct<ts:bigint,id:bigint,etag:string,last_modified:string,headers:{HEADERS}>"


def canonical(url: Column) -> Column:
    """One form of the URLs of a page: no scheme, www. or default port, host in lower case, no
    fragment, no tracking parameters, no slash at the end."""
    u = F.regexp_replace(url, r"#.*$", "")
    u = F.regexp_replace(u, r"^(?i)[a-z][a-z0-9+.-]*://(?:www\.)?", "")
    host, rest = F.regexp_extract(u, r"^([^/?]*)", 1), F.regexp_extract(u, r"^[^/?]*(.*)$", 1)
    rest = F.regexp_replace(rest, r"([?&])(?:utm_[a-z]+|ref)=[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(rest, r"&{2,}", "&"), r"\?&+", "?")
    rest = F.regexp_replace(F.regexp_replace(rest, r"[?&]+$", ""), r"/+$", "")
    return F.concat(F.regexp_replace(F.lower(host), r":(?:80|443)$", ""), rest)


def _lowered(headers: Column) -> Column:
    return F.transform(headers, lambda h: F.struct(F.lower(h["name"]).alias("name"), h["value"].alias("value")))


def merge_headers(full: Column, revisit: Column) -> Column:
    """The full response's headers, with the permitted ones of the revisit in place of its own; by name."""
    fresh = F.filter(revisit, lambda h: h["name"].isin(*PERMITTED))
    names = F.transform(fresh, lambda h: h["name"])
    stay = F.filter(full, lambda h: ~F.array_contains(names, h["name"]))
    return F.array_sort(F.concat(stay, fresh))


def _agree(a: Column, b: Column) -> Column:
    weak = lambda x: F.regexp_replace(x, r"^W/", "")
    return F.coalesce(weak(a) == weak(b), F.lit(False))


def resolve(records: DataFrame) -> DataFrame:
    """records: record_id long, url, ts long, kind ('response' or 'revisit'), headers (name, value).

    Gives a row per revisit: record_id, url (canonical), ts, status, ref_id and headers (merged).
    """
    df = records.select(
        F.col("record_id").cast("long").alias("id"), canonical(F.col("url")).alias("key"), F.col("ts").cast("long").alias("ts"), "kind",
        F.coalesce(_lowered(F.col("headers").cast(HEADERS)), F.array().cast(HEADERS)).alias("h"),
    )
    ranged = df.repartitionByRange("key", "ts").withColumn("part", F.spark_partition_id())
    last = lambda name: F.try_element_at(F.filter("h", lambda h: h["name"] == name), F.lit(-1))["value"]
    etag, modified = last("etag"), last("last-modified")
    own = F.struct("ts", "id", etag.alias("etag"), modified.alias("last_modified"), F.col("h").alias("headers"))
    ranged = ranged.withColumn("full", F.when(F.col("kind") == "response", own))
    staged = materialize(ranged.withColumn("etag", etag).withColumn("last_modified", modified))

    placed = staged.filter("key is not null and ts is not null")
    earlier = Window.partitionBy("part", "key").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    filled = placed.withColumn("near", F.max("full").over(earlier)).filter("kind = 'revisit'")
    carried = _carried(placed)
    found = filled.join(F.broadcast(carried), "part", "left")
    found = found.withColumn("base", F.coalesce("near", F.when(F.col("key") == F.col("in_key"), F.col("in_full"))))
    lost = staged.filter("kind = 'revisit' and (key is null or ts is null)")
    found = found.select("id", "key", "ts", "h", "etag", "last_modified", "base").unionByName(lost.select("id", "key", "ts", "h", "etag", "last_modified", F.lit(None).cast(FULL).alias("base")))
    same = F.when(F.col("etag").isNotNull(), _agree(F.col("etag"), F.col("base.etag"))).otherwise(_agree(F.col("last_modified"), F.col("base.last_modified")))
    status = (
        F.when(F.col("key").isNull() | F.col("ts").isNull(), "unplaced").when(F.col("base").isNull(), "orphan")
        .when(F.col("etag").isNull() & F.col("last_modified").isNull(), "unverified").when(same, "resolved").otherwise("modified")
    )
    out = found.withColumn("status", status)
    ok = F.col("status") == "resolved"
    return out.select(
        F.col("id").alias("record_id"), F.col("key").alias("url"), "ts", "status",
        F.when(ok, F.col("base.id")).alias("ref_id"), F.when(ok, merge_headers(F.col("base.headers"), F.col("h"))).alias("headers"),
    )


def _carried(placed: DataFrame) -> DataFrame:
    """part, in_key, in_full: the last URL before a part and its latest full response. One row per part
    comes to the driver; parts are as many as shuffle partitions."""
    ends = placed.groupBy("part").agg(F.max("key").alias("key"))
    full = placed.join(F.broadcast(ends.withColumnsRenamed({"part": "p", "key": "k"})), (F.col("part") == F.col("p")) & (F.col("key") == F.col("k")))
    rows = full.groupBy("part", "key").agg(F.max("full").alias("full")).orderBy("part").toLocalIterator()
    out, key, best = [], None, None
    for r in rows:
        out.append((r["part"], key, best))
        best = r["full"] if r["full"] is not None else best if r["key"] == key else None
        key = r["key"]
    return placed.sparkSession.createDataFrame(out, f"part int, in_key string, in_full {FULL}")


def captures(pages: DataFrame) -> DataFrame:
    """Archive records of a table of pages: each page is a full response at time 10 * page_id, and is
    asked for again later, when the answer is 304 with an ETag, a Last-Modified date, or an ETag of
    another version, by page_id mod 3."""
    tag = F.md5(F.coalesce("html", F.lit("")))
    day = F.concat(F.lit("day "), (F.col("page_id") % 365).cast("string"))
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), v.cast("string").alias("value"))
    first = F.array(pair("Content-Type", F.lit("text/html")), pair("Content-Length", F.octet_length("html")), pair("ETag", tag), pair("Last-Modified", day), pair("Date", F.col("page_id") * 10))
    again = F.array(pair("Date", F.col("page_id") * 10 + 1005), pair("Content-Length", F.lit(0)), pair("Cache-Control", F.lit("max-age=60")))
    third = F.col("page_id") % 3
    again = F.concat(again, F.when(third == 0, F.array(pair("etag", tag))).when(third == 1, F.array(pair("last-modified", day))).otherwise(F.array(pair("ETag", F.concat(tag, F.lit("-old"))))))
    both = F.array(
        F.struct((F.col("page_id") * 2).alias("record_id"), (F.col("page_id") * 10).alias("ts"), F.lit("response").alias("kind"), first.alias("headers")),
        F.struct((F.col("page_id") * 2 + 1).alias("record_id"), (F.col("page_id") * 10 + 1005).alias("ts"), F.lit("revisit").alias("kind"), again.alias("headers")),
    )
    return pages.select("url", F.explode(both).alias("r")).select("r.record_id", "url", "r.ts", "r.kind", "r.headers")


def query(pages: DataFrame) -> DataFrame:
    out = resolve(captures(pages))
    lines = F.array_join(F.transform("headers", lambda h: F.concat_ws(": ", h["name"], h["value"])), "; ")
    return out.select("record_id", "url", "ts", "status", "ref_id", lines.alias("headers"))


ORACLE = """
WITH c AS (
  SELECT page_id, page_id * 10 AS ts, page_id * 10 + 1005 AS again, md5(coalesce(html, '')) AS tag, 'day ' || (page_id % 365) AS day, octet_length(encode(html)) AS size,
    regexp_replace(regexp_replace(url, '#.*$', ''), '^(?i)[a-z][a-z0-9+.-]*://(?:www\\.)?', '') AS u
  FROM pages),
p AS (
  SELECT *, regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)), ':(?:80|443)$', '') || regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    regexp_replace(regexp_extract(u, '^[^/?]*(.*)$', 1), '([?&])(?:utm_[a-z]+|ref)=[^&]*', '\\1', 'g'), '&{2,}', '&', 'g'), '\\?&+', '?', 'g'), '[?&]+$', ''), '/+$', '') AS key FROM c),
r AS (
  SELECT v.page_id, v.key, v.again AS ts, CASE v.page_id % 3 WHEN 0 THEN v.tag WHEN 2 THEN v.tag || '-old' END AS etag, CASE v.page_id % 3 WHEN 1 THEN v.day END AS day,
    max(f.page_id) AS ref FROM p v LEFT JOIN p f ON f.key = v.key AND f.ts < v.again GROUP BY ALL),
j AS (
  SELECT r.*, f.tag AS ftag, f.day AS fday, f.size AS fsize,
    CASE WHEN ref IS NULL THEN 'orphan' WHEN (etag IS NOT NULL AND etag = f.tag) OR (etag IS NULL AND r.day = f.day) THEN 'resolved' ELSE 'modified' END AS status
  FROM r LEFT JOIN p f ON f.page_id = r.ref)
SELECT page_id * 2 + 1 AS record_id, key AS url, ts, status, CASE WHEN status = 'resolved' THEN ref * 2 END AS ref_id,
  CASE WHEN status = 'resolved' THEN 'cache-control: max-age=60; content-length: ' || fsize || '; content-type: text/html; date: ' || ts || '; etag: ' || ftag || '; last-modified: ' || fday END AS headers
FROM j
"""
