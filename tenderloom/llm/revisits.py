"""Not-modified revisits of a web archive, each resolved to the latest earlier full response of the same page.

Records are put in order of canonical URL and time and dealt out in ranges of that order, so a URL with any share of all
records spreads over many tasks. Within a range each revisit takes the last full response before it; the few that have
none there take the one that the ranges before left for their URL: one row for each range, not one for each record.
A revisit whose validators contradict the response is not merged with it. A merged record has the response's headers,
except where the revisit brings a newer value of a header that a not-modified answer may change.

Result status: `resolved`; `mismatch` (ETags, or else dates of last change, differ); `unverified` (the two have no
validator in common); `orphan` (no earlier response, or no URL or time). ETags are compared weakly. A response at the very
time of a revisit is not earlier; of several at one time the greatest record id counts. Repeated records give repeated
results. Responses without URL or time, and records of other kinds, take no part. Null header lists count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

# Headers that a 304 answer may update.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
HEADERS = "array<struct<name: string, value: string>>"


def canonical_url(url: Column) -> Column:
    """The URL without scheme, `www.`, default port, fragment, tracking parameters and final slashes; the host in lower
    case and the parameters in order."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), "^[A-Za-z][A-Za-z0-9+.-]*://", ""), "#.*$", "")
    host = F.lower(F.regexp_extract(rest, "^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, "^www[0-9]*[.]", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/+$", "")
    given = F.split(F.regexp_extract(rest, "[?](.*)$", 1), "&")
    kept = F.array_sort(F.filter(given, lambda p: (p != "") & ~p.rlike("^(utm_[a-z]+|fbclid|gclid)=")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def merged_headers(stored: Column, newer: Column) -> Column:
    """Stored headers, with those that the newer ones may replace taken from these."""
    allowed = F.filter(newer, lambda h: F.lower(h["name"]).isin(*PERMITTED))
    names = F.transform(allowed, lambda h: F.lower(h["name"]))
    kept = F.filter(stored, lambda h: ~F.coalesce(F.array_contains(names, F.lower(h["name"])), F.lit(False)))
    return F.concat(kept, allowed)


def _status(revisit_etag: Column, revisit_date: Column, found: Column) -> Column:
    weak = lambda tag: F.regexp_replace(F.trim(tag), "^W/", "")
    etags = revisit_etag.isNotNull() & found["etag"].isNotNull()
    dates = revisit_date.isNotNull() & found["last_modified"].isNotNull()
    return (
        F.when(found.isNull(), "orphan")
        .when(etags, F.when(weak(revisit_etag) == weak(found["etag"]), "resolved").otherwise("mismatch"))
        .when(dates, F.when(revisit_date == found["last_modified"], "resolved").otherwise("mismatch"))
        .otherwise("unverified")
    )


def resolve_revisits(records: DataFrame) -> DataFrame:
    """`records`: record_id, url, time, kind (`response` for full ones, `revisit`), etag, last_modified, headers (list of
    name and value) and digest. One row for each revisit: record_id, canonical_url, time, status, and where there is an
    earlier response its target_id and target_time; if resolved, also its digest and the merged headers."""
    rows = records.where(F.col("kind").isin("response", "revisit")).select(
        canonical_url(F.col("url")).alias("page"),
        "time",
        (F.col("kind") == "response").alias("full"),
        "record_id",
        "etag",
        "last_modified",
        F.coalesce(F.col("headers"), F.array().cast(HEADERS)).alias("headers"),
        "digest",
    )
    complete = F.col("page").isNotNull() & F.col("time").isNotNull()
    order = ["page", "time", "full", "record_id"]
    dealt = rows.where(complete).repartitionByRange(*order).withColumn("range", F.spark_partition_id())
    dealt = written(dealt, "revisits")

    response = F.struct("record_id", "time", "etag", "last_modified", "headers", "digest")
    taken = Window.partitionBy("range", "page").orderBy("time", "full", "record_id")
    before = taken.rowsBetween(Window.unboundedPreceding, -1)
    within = dealt.withColumn("found", F.last(F.when(F.col("full"), response), ignorenulls=True).over(before))

    # What each range leaves: its very last response. Only a range's last page goes on in the next one.
    left = dealt.where("full").groupBy("range").agg(F.max_by(F.struct("page", response.alias("left")), F.struct(*order)).alias("x"))
    left = left.select("range", "x.page", "x.left", F.lit(1).alias("turn"))
    heads = dealt.groupBy("range").agg(F.min("page").alias("page"))
    heads = heads.select("range", "page", F.lit(None).cast(left.schema["left"].dataType).alias("left"), F.lit(0).alias("turn"))
    earlier = Window.partitionBy("page").orderBy("range", "turn").rowsBetween(Window.unboundedPreceding, -1)
    carried = left.unionByName(heads).withColumn("carried", F.last("left", ignorenulls=True).over(earlier))
    carried = carried.where("turn = 0").select("range", "page", "carried")

    asked = within.where("NOT full").join(carried, ["range", "page"], "left")
    asked = asked.withColumn("found", F.coalesce("found", "carried")).drop("carried", "range")
    broken = rows.where("NOT full").where(~complete).withColumn("found", F.lit(None).cast(asked.schema["found"].dataType))
    asked = asked.unionByName(broken).withColumn("status", _status(F.col("etag"), F.col("last_modified"), F.col("found")))
    resolved = F.col("status") == "resolved"
    return asked.select(
        "record_id",
        F.col("page").alias("canonical_url"),
        "time",
        "status",
        F.col("found.record_id").alias("target_id"),
        F.col("found.time").alias("target_time"),
        F.when(resolved, F.col("found.digest")).alias("digest"),
        F.when(resolved, merged_headers(F.col("found.headers"), F.col("headers"))).alias("headers"),
    )
