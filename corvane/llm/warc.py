"""Not-modified revisit resolution for web archive records, in DataFrame functions.

A revisit record holds headers only; its content is that of the latest
earlier full response of the same canonical URL, if their validators agree.
The as-of join works on buckets of time: each bucket's last response is
summed up first, carried into later buckets, and merged with what the bucket
itself holds.  So a URL that has very many records is split over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a time bucket.
BUCKET_SECONDS = 3600
#: Headers that a not-modified answer may replace in the stored response.
PERMITTED_HEADERS = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that don't change what a URL shows.
TRACKING = r"^(utm_[a-z]*|gclid|fbclid|msclkid|sessionid|phpsessid|jsessionid|ref)="
_URL = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?"


def canonical_url(url: Column) -> Column:
    """Host without www, port unless 80 or 443, path, sorted query without tracking; null for null and blank URLs.

    Scheme, user and fragment are left out; the host is lower-cased.
    """
    raw = F.btrim(url)
    part = lambda i: F.regexp_extract(raw, _URL, i)
    host = F.regexp_replace(F.lower(part(1)), r"^www\.", "")
    port = F.when(part(2).isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), part(2)))
    path = F.when(part(3) == "", "/").otherwise(part(3))
    query = F.array_join(F.array_sort(F.filter(F.split(part(4), "&"), lambda x: (x != "") & ~F.lower(x).rlike(TRACKING))), "&")
    whole = F.concat(host, port, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(raw == "", None).otherwise(whole)


def _weak(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def merge_headers(stored: Column, fresh: Column) -> Column:
    """The stored headers, with the permitted ones of the not-modified answer in place of their own. Names in lower case."""
    low = lambda m: F.transform_keys(F.coalesce(m, F.create_map().cast("map<string,string>")), lambda k, v: F.lower(k))
    new = F.map_filter(low(fresh), lambda k, v: k.isin(*PERMITTED_HEADERS))
    return F.map_concat(F.map_filter(low(stored), lambda k, v: ~F.array_contains(F.map_keys(new), k)), new)


def resolve_revisits(records: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """One row per revisit: record_id, canonical_url, response_id, status, headers, payload_digest.

    ``records``: record_id, kind ('response' or 'revisit'), url, at (seconds,
    long), etag, last_modified, headers (map of strings), payload_digest.
    Other columns and kinds are ignored.  The response is the latest one
    strictly earlier than the revisit (of several at one second that with the
    largest id).  status is 'resolved' when the entity tags agree (weakly), or,
    where one is missing, the modification dates; 'mismatch' when they differ;
    'unverified' when there is nothing to compare; 'no_response' without an
    earlier response, and when the URL or time is null.  Only resolved rows
    have headers and a digest; response_id is given wherever one was found.
    Repeated revisits give repeated rows; an empty table an empty result.
    """
    slim = records.where(F.col("kind").isin("response", "revisit")).select("record_id", "kind", canonical_url(F.col("url")).alias("canonical_url"), F.col("at").cast("long").alias("at"), "etag", "last_modified", "headers", "payload_digest")
    known = F.col("canonical_url").isNotNull() & F.col("at").isNotNull()
    placed = slim.where(known).withColumns({"_bucket": F.floor(F.col("at") / bucket_seconds), "_is": F.col("kind") == "response"})
    found = F.struct("record_id", "etag", "last_modified", "headers", "payload_digest")
    ends = placed.groupBy("canonical_url", "_bucket").agg(F.max_by(F.when(F.col("_is"), found), F.when(F.col("_is"), F.struct("at", "record_id"))).alias("_end"))
    earlier = Window.partitionBy("canonical_url").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("canonical_url", "_bucket", F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    inside = Window.partitionBy("canonical_url", "_bucket").orderBy("at", "_is", "record_id").rowsBetween(Window.unboundedPreceding, 0)
    own = placed.withColumn("_own", F.last(F.when(F.col("_is"), found), ignorenulls=True).over(inside)).where(~F.col("_is"))
    joined = own.join(carried, ["canonical_url", "_bucket"]).withColumn("_r", F.coalesce("_own", "_carried"))
    unknown = slim.where(~known & (F.col("kind") == "revisit")).withColumn("_r", F.lit(None).cast(joined.schema["_r"].dataType))
    columns = [*slim.columns, "_r"]
    every = joined.select(columns).unionByName(unknown.select(columns))
    tags = F.col("etag").isNotNull() & F.col("_r.etag").isNotNull()
    dates = F.col("last_modified").isNotNull() & F.col("_r.last_modified").isNotNull()
    agree = F.when(tags, _weak(F.col("etag")) == _weak(F.col("_r.etag"))).when(dates, F.col("last_modified") == F.col("_r.last_modified"))
    status = F.when(F.col("_r").isNull(), "no_response").when(agree.isNull(), "unverified").when(agree, "resolved").otherwise("mismatch")
    out = every.withColumn("status", status)
    good = F.col("status") == "resolved"
    return out.select("record_id", "canonical_url", F.col("_r.record_id").alias("response_id"), "status", F.when(good, merge_headers(F.col("_r.headers"), F.col("headers"))).alias("headers"), F.when(good, F.col("_r.payload_digest")).alias("payload_digest"))


def header_text(headers: Column) -> Column:
    """Headers as 'name: value' lines in the order of their names."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")


def page_records(pages: DataFrame) -> DataFrame:
    """Archive records made of crawled pages: a full response and a not-modified revisit of each.

    Responses are a minute apart.  A revisit follows its response after seven
    days, or (page_id mod 5 = 4) precedes it by one.  By page_id mod 4 it has
    the same entity tag, only a date, a weak tag, or a tag that has changed.
    """
    at = F.col("page_id") * 60
    digest = F.sha2(F.coalesce("html", F.lit("")), 256)
    tag = F.substring(digest, 1, 16)
    rest = F.pmod(F.col("page_id"), F.lit(4))
    day = lambda t: F.concat(F.lit("day "), F.floor(t / 86400).cast("string"))
    base = pages.select("page_id", "url", at.alias("at"), digest.alias("digest"), tag.alias("tag"), rest.alias("rest"))
    responses = base.select(
        F.col("page_id").alias("record_id"), F.lit("response").alias("kind"), "url", "at", F.col("tag").alias("etag"), day(F.col("at")).alias("last_modified"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), F.col("tag"), F.lit("Date"), day(F.col("at")), F.lit("Cache-Control"), F.lit("max-age=600")).alias("headers"), F.col("digest").alias("payload_digest"),
    )
    again = F.when(F.pmod(F.col("page_id"), F.lit(5)) == 4, F.col("at") - 86400).otherwise(F.col("at") + 7 * 86400 + 1)
    own = F.when(F.col("rest") == 0, F.col("tag")).when(F.col("rest") == 2, F.concat(F.lit("W/"), F.col("tag"))).when(F.col("rest") == 3, F.lit("changed"))
    revisits = base.select(
        F.col("page_id").alias("record_id"), F.lit("revisit").alias("kind"), "url", again.alias("at"), own.alias("etag"), day(F.col("at")).alias("last_modified"),
        F.create_map(F.lit("Date"), day(again), F.lit("Cache-Control"), F.lit("max-age=60"), F.lit("Content-Length"), F.lit("0")).alias("headers"), F.lit(None).cast("string").alias("payload_digest"),
    )
    return responses.unionByName(revisits)
