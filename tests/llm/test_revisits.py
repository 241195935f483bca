from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tenderloom.llm import revisits

SCHEMA = (
    "record_id long, url string, time long, kind string, etag string, last_modified long, "
    f"headers {revisits.HEADERS}, digest string"
)


def plain(rows, page):
    found = {}
    for record, url, time, kind, etag, changed, _, _ in rows:
        if kind != "revisit":
            continue
        before = [r for r in rows if r[3] == "response" and page(r[1]) == page(url) and None not in (url, time, r[2]) and r[2] < time]
        best = max(before, key=lambda r: (r[2], r[0]), default=None)
        if best is None:
            status = "orphan"
        elif etag and best[4]:
            status = "resolved" if etag.removeprefix("W/") == best[4].removeprefix("W/") else "mismatch"
        elif changed is not None and best[5] is not None:
            status = "resolved" if changed == best[5] else "mismatch"
        else:
            status = "unverified"
        found[record] = (status, best and best[0])
    return found


@pytest.mark.parametrize("partitions", [1, 13])
def test_hot_urls_ties_and_nulls_equal_a_plain_version(spark, partitions):
    draw = random.Random(2)
    rows = []
    for k in range(600):
        url = "http://hot.example/" if k % 3 else draw.choice([None, "https://www.a.example/x#y", "http://a.example/x/", "b.example"])
        rows.append(
            (
                k,
                url,
                draw.choice([None, *range(60)]),
                draw.choice(["response", "revisit", "revisit", "revisit", "metadata", None]),
                draw.choice([None, '"1"', 'W/"1"', '"2"']),
                draw.choice([None, 1, 2]),
                draw.choice([None, [("ETag", '"1"')]]),
                "d",
            )
        )
    page = lambda u: u and u.replace("https://www.", "").replace("http://", "").removesuffix("#y").rstrip("/")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = spark.createDataFrame(rows, SCHEMA).withColumn("status", F.lit(1))
        found = revisits.resolve_revisits(frame).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert {r["record_id"]: (r["status"], r["target_id"]) for r in found} == plain(rows, page)
    assert revisits.resolve_revisits(spark.createDataFrame([], SCHEMA)).collect() == []


def test_only_permitted_headers_are_merged(spark):
    rows = [
        (1, "http://x/", 1, "response", '"a"', None, [("Content-Length", "9"), ("ETag", '"a"'), ("X-A", "1")], "d"),
        (2, "http://x/", 2, "revisit", 'W/"a"', None, [("content-length", "0"), ("etag", 'W/"a"'), ("Expires", "2")], None),
    ]
    found = revisits.resolve_revisits(spark.createDataFrame(rows, SCHEMA)).first()
    assert [tuple(h) for h in found["headers"]] == [("Content-Length", "9"), ("X-A", "1"), ("etag", 'W/"a"'), ("Expires", "2")]
    assert (found["status"], found["digest"], found["target_time"]) == ("resolved", "d", 1)


def test_canonical_urls(spark):
    urls = {
        "HTTP://WWW.Example.COM:80/A/?b=2&utm_source=x&a=1#f": "example.com/A?a=1&b=2",
        "https://example.com": "example.com",
        " https://www2.example.com/?fbclid=1 ": "example.com",
        "example.com/a//": "example.com/a",
        "": "",
    }
    frame = spark.createDataFrame([(u,) for u in urls], "url string")
    found = frame.select("url", revisits.canonical_url(F.col("url")).alias("c")).collect()
    assert {r["url"]: r["c"] for r in found} == urls
