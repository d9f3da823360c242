"""WARC not-modified revisits: an as-of join to the latest earlier full response of the same canonical URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.session import cut_lineage

from .columns import read

#: Header fields that a 304 answer may bring and that replace stored ones (RFC 9110, 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")


def _plain_escapes(text: Column) -> Column:
    """``text`` with percent-encoded letters, digits and ``-._~`` written plainly, and other escapes in upper case."""
    token = F.regexp_extract_all(text, F.lit(r"%[0-9A-Fa-f]{2}|[^%]+|%"), F.lit(0))

    def plain(x: Column) -> Column:
        letter = F.char(F.conv(F.substring(x, 2, 2), 16, 10).cast("int"))
        return F.when(~x.rlike("^%[0-9A-Fa-f]{2}$"), x).when(letter.rlike("^[A-Za-z0-9._~-]$"), letter).otherwise(F.upper(x))

    return F.array_join(F.transform(token, plain), "")


def canonical_url(url: Column) -> Column:
    """Host, path and parameters without scheme, fragment, ``www.``, port 80 or 443, last slashes of the path, empty,
    ``utm_*`` and ``ref`` parameters; the host in lower case, parameters in order, escapes as RFC 3986 normalizes them."""
    bare = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    clean = _plain_escapes(bare)
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(clean, r"^[^/?]*", 0)), r"^www\.", ""), r":(80|443)?$", "")
    path = F.regexp_replace(F.regexp_extract(clean, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    given = F.split(F.regexp_extract(clean, r"^[^?]*\?(.*)$", 1), "&")
    kept = F.array_sort(F.filter(given, lambda x: ~x.rlike(r"^(utm_[^=]*=.*|ref=.*|)$")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


#: What a revisit takes from its response.
_TAKEN = ("record_id", "etag", "last_modified", "headers", "digest")


def with_latest_response(records: DataFrame, tasks: int) -> DataFrame:
    """Revisits among records with a ``site`` and a time, each row once, with ``target``: ``_TAKEN`` of the last response of
    the site with a smaller time, or of the same time and a smaller id. Null if there is none.

    Responses of one time and id, repeated ones among them, go by entity tag, date, digest and a hash of the headers, the
    last one first. Records are cut into ranges of (site, time), each handled apart, so a site with most records spreads over
    many, and a response that most revisits refer to is never a join key. What a range inherits from those before it is
    one row a range, so it is broadcast.
    """
    order = ["site", "time", "record_id"]
    ties = ["time", "record_id", "etag", "last_modified", "digest", "mark"]
    columns = [*order, "kind", "etag", "last_modified", "headers", "digest", F.xxhash64(F.array_sort(F.map_entries("headers"))).alias("mark")]
    ranged = cut_lineage(records.select(*columns).repartitionByRange(tasks, *order).withColumn("part", F.spark_partition_id()), "ranged")
    response = F.when(F.col("kind") == "response", F.struct(*_TAKEN))
    # at one time and id, a response stands after the revisit
    before = Window.partitionBy("part", "site").orderBy("time", "record_id", F.col("kind").desc(), *ties[2:]).rowsBetween(Window.unboundedPreceding, -1)
    inside = ranged.withColumn("own", F.last(response, ignorenulls=True).over(before)).filter("kind = 'revisit'")
    # the last response of each site in each part, where the site goes on in a later part: the part's last site
    ends = ranged.groupBy("part").agg(F.min("site").alias("first_site"), F.max("site").alias("site"))
    latest = ranged.filter("kind = 'response'").join(F.broadcast(ends.select("part", "site")), ["part", "site"]).groupBy("part", "site").agg(
        F.max_by(F.struct(*_TAKEN), F.struct(*ties)).alias("last"))
    sites = ends.select("part", F.col("first_site").alias("site"), F.lit(None).cast(latest.schema["last"].dataType).alias("last"), F.lit(0).alias("given"))
    sites = sites.union(latest.select("part", "site", "last", F.lit(1).alias("given")))
    earlier = Window.partitionBy("site").orderBy("part", "given").rowsBetween(Window.unboundedPreceding, -1)
    carried = sites.withColumn("carried", F.last("last", ignorenulls=True).over(earlier)).filter("given = 0")
    joined = inside.join(F.broadcast(carried.select("part", "site", "carried")), ["part", "site"], "left")
    return joined.withColumn("target", F.coalesce("own", "carried"))


def _folded(headers: Column) -> Column:
    """Headers with names in lower case; of names that differ in case only, the value of the last in byte order (``etag``
    after ``ETag``: maps have no order of their own). Null: no headers."""
    entries = F.transform(
        F.array_sort(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))),
        lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.reverse(F.transform(entries, lambda e: e["key"]))
    return F.map_from_entries(F.filter(entries, lambda e, i: F.size(names) - F.array_position(names, e["key"]) == i))


def _opaque(etag: Column) -> Column:
    """An entity tag without its weakness mark: not-modified answers compare weakly."""
    return F.regexp_replace(etag, "^W/", "")


def resolve(records: DataFrame, permitted: tuple[str, ...] = PERMITTED) -> DataFrame:
    """Resolve revisits: ``record_id, url, time, kind, etag, last_modified, headers (map), digest`` ->
    ``record_id, target_id, outcome, headers, digest``, one row for each revisit row.

    Outcomes: ``missing`` (no earlier response), ``mismatch`` (its validator is another one), ``unchecked`` (no
    validator in common) and ``resolved``. Only resolved revisits get the response's digest and its headers, those
    permitted in the revisit over them; header names are in lower case, and of names that differ in case only the last
    in byte order counts. Entity tags are compared first, dates only where one side has no tag. Repeated rows and ids multiply nothing:
    a revisit given twice gives two equal rows, a response given twice counts once. Null ids are allowed. Records with
    a null url or time resolve to nothing; other kinds and columns are left out. Bodies are never shuffled, only digests.
    """
    tasks = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = records.select("record_id", "url", "time", "kind", "etag", "last_modified", "headers", "digest").filter("kind IN ('response', 'revisit')")
    keyed = own.withColumn("site", canonical_url(F.col("url")))
    placed = F.col("site").isNotNull() & F.col("time").isNotNull()
    met = with_latest_response(keyed.filter(placed), tasks).select("record_id", "etag", "last_modified", "headers", "target")
    lost = keyed.filter(~placed & (F.col("kind") == "revisit"))
    met = met.unionByName(lost.select("record_id", "etag", "last_modified", "headers", F.lit(None).cast(met.schema["target"].dataType).alias("target")))
    theirs = lambda name: F.col(f"target.{name}")
    same = F.when(F.col("etag").isNotNull() & theirs("etag").isNotNull(), _opaque(F.col("etag")) == _opaque(theirs("etag"))).otherwise(
        F.col("last_modified") == theirs("last_modified"))
    outcome = F.when(F.col("target").isNull(), "missing").when(same.isNull(), "unchecked").when(same, "resolved").otherwise("mismatch")
    ok = F.col("outcome") == "resolved"
    named = met.withColumns({
        "outcome": outcome, "allowed": F.map_filter(_folded(F.col("headers")), lambda k, _: k.isin(*permitted)), "stored": _folded(theirs("headers"))})
    rest = F.map_filter("stored", lambda k, _: ~F.array_contains(F.map_keys("allowed"), k))
    return named.select(
        "record_id", theirs("record_id").alias("target_id"), "outcome", F.when(ok, F.map_concat(rest, "allowed")).alias("headers"),
        F.when(ok, theirs("digest")).alias("digest"),
    )


def crawl_records(pages: DataFrame) -> DataFrame:
    """WARC records that Spark derives from pages: each page is answered in full at time page_id (every eleventh answer is
    lost), and asked for again 1 to 1,000 ticks later with its entity tag, the weak form of it, a date or a stale tag."""
    page = F.col("page_id")
    tag = F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    dated = F.concat(F.lit("day "), (page % 7).cast("string"))
    full = pages.filter(page % 11 != 0).select(
        (page * 2).alias("record_id"), "url", page.alias("time"), F.lit("response").alias("kind"), tag.alias("etag"), dated.alias("last_modified"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.char_length("html").cast("string"),
                     F.lit("ETag"), tag, F.lit("Cache-Control"), F.lit("max-age=60")).alias("headers"),
        F.md5("html").alias("digest"),
    )
    asked = F.when(page % 5 == 0, F.concat(F.lit("W/"), tag)).when(page % 5 == 2, F.lit('"stale"')).when(page % 5 != 1, tag)
    again = pages.select(
        (page * 2 + 1).alias("record_id"), F.regexp_replace("url", "^http://", "https://www.").alias("url"),
        (page + 1 + page * 7919 % 1000).alias("time"), F.lit("revisit").alias("kind"), asked.alias("etag"), dated.alias("last_modified"),
        F.create_map(F.lit("Content-Length"), F.lit("0"), F.lit("cache-control"), F.concat(F.lit("max-age="), (page % 90).cast("string"))).alias("headers"),
        F.lit(None).cast("string").alias("digest"),
    )
    return full.union(again)


def op8_warc_revisits(spark, sf_dir: str) -> DataFrame:
    found = resolve(crawl_records(read(spark, sf_dir, "pages").filter("page_id is not null")))
    at = lambda name: F.element_at("headers", name).alias(name.replace("-", "_"))
    return found.select("record_id", "target_id", "outcome", "digest", at("cache-control"), at("content-length"))


OP8_SQL = r"""
WITH base AS (
  SELECT page_id, url, html, '"' || md5(html) || '"' AS tag, 'day ' || CAST(page_id % 7 AS VARCHAR) AS dated FROM pages WHERE page_id IS NOT NULL
), records AS (
  SELECT page_id * 2 AS record_id, url, page_id AS time, 'response' AS kind, tag AS etag, dated, length(html) AS size, md5(html) AS digest
  FROM base WHERE page_id % 11 <> 0
  UNION ALL
  SELECT page_id * 2 + 1, regexp_replace(url, '^http://', 'https://www.'), page_id + 1 + page_id * 7919 % 1000, 'revisit',
    CASE WHEN page_id % 5 = 0 THEN 'W/' || tag WHEN page_id % 5 = 2 THEN '"stale"' WHEN page_id % 5 <> 1 THEN tag END, dated, 0, NULL
  FROM base
), bare AS (
  SELECT *, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS b FROM records
), clean AS (
  SELECT *, array_to_string(list_transform(regexp_extract_all(b, '%[0-9A-Fa-f]{2}|[^%]+|%'), lambda x:
    CASE WHEN NOT regexp_full_match(x, '%[0-9A-Fa-f]{2}') THEN x
      WHEN regexp_full_match(upper(x), '%(2D|2E|3[0-9]|4[1-9A-F]|5[0-9A]|5F|6[1-9A-F]|7[0-9A]|7E)') THEN chr(CAST('0x' || x[2:3] AS INTEGER))
      ELSE upper(x) END), '') AS c FROM bare
), parts AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(c, '^[^/?]*')), '^www\.', ''), ':(80|443)?$', '') AS host,
    regexp_replace(regexp_extract(c, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(c, '^[^?]*\?(.*)$', 1), '&'), lambda x: NOT regexp_full_match(x, 'utm_[^=]*=.*|ref=.*|'))) AS given FROM clean
), sites AS (
  SELECT *, host || path || CASE WHEN len(given) > 0 THEN '?' || array_to_string(given, '&') ELSE '' END AS site,
    time * 1000000000 + record_id AS at FROM parts
), met AS (
  SELECT v.*, r.record_id AS target_id, r.etag AS t_etag, r.dated AS t_dated, r.size AS t_size, r.digest AS t_digest
  FROM (SELECT * FROM sites WHERE kind = 'revisit') v
  ASOF LEFT JOIN (SELECT * FROM sites WHERE kind = 'response') r ON v.site = r.site AND v.at > r.at
), judged AS (
  SELECT *, CASE WHEN target_id IS NULL THEN 'missing'
    WHEN etag IS NOT NULL AND t_etag IS NOT NULL THEN
      CASE WHEN regexp_replace(etag, '^W/', '') = t_etag THEN 'resolved' ELSE 'mismatch' END
    WHEN dated = t_dated THEN 'resolved' ELSE 'mismatch' END AS outcome FROM met
)
SELECT record_id, target_id, outcome, CASE WHEN outcome = 'resolved' THEN t_digest END AS digest,
  CASE WHEN outcome = 'resolved' THEN 'max-age=' || CAST((record_id - 1) // 2 % 90 AS VARCHAR) END AS cache_control,
  CASE WHEN outcome = 'resolved' THEN CAST(t_size AS VARCHAR) END AS content_length
FROM judged
"""
