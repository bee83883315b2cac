"""WARC archives: round trip, revisit resolution, records read by offset."""

import base64
import gzip
import hashlib

import pytest

from tillscope.llm import files, warc
from tillscope.llm.common import ship_package, stored

DATE = "2024-01-01T00:00:00Z"
NAMES = ["page_id", "url", "html", "URL", "path"]


def pages(spark, rows):
    ship_package(spark)
    return spark.createDataFrame([(*r, "clash", "p") for r in rows],
                                 "a long, b string, c string, d string, e string").toDF(*NAMES)


ROWS = [(1, "http://a/x", "same"), (2, "http://b/y?q=ü \r\nz: 1", "same"), (9, None, "same"), (9, "http://c", "same"),
        (3, "u", None), (4, "u", ""), (5, "u", "ünïcode é"), (None, "n", "same"), (None, "n", "only nulls"),
        (None, "m", "only nulls"), (6, "long", "abc" * 400_000), (7, "u", "HTTP/1.1 200\r\n\r\nbody\r\n\r\n")]


def brute(rows, least):
    out = []
    for p, _, h in rows:
        body = (h or "").encode()
        ids = [x for x, _, g in rows if (g or "") == (h or "") and x is not None]
        keep = max(ids) if ids and len(body) >= least else None
        kind = "response" if keep is None or p == keep else "revisit"
        out.append((p, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), kind,
                    keep if kind == "revisit" else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 5])
def test_deduplicate_equals_brute_force(spark, least):
    got = warc.deduplicate(pages(spark, ROWS), DATE, min_bytes=least)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(ROWS, least)


def test_empty_table(spark):
    assert warc.deduplicate(pages(spark, []).limit(0), DATE).count() == 0


def test_archives_hold_fresh_records(spark):
    raw = warc.write_archives(pages(spark, ROWS).coalesce(2), DATE)
    headers = warc.read_headers(raw)
    clean = warc.rewrite(warc.resolve(headers), "2025-02-03T04:05:06Z")
    assert sum(r.records for r in clean.collect()) == len(ROWS)
    size = lambda m: sum(files.opened(r.path)[0].get_file_info(files.opened(r.path)[1]).size for r in m.collect())
    assert size(clean) < size(raw) + 4000
    for r in warc.read_headers(clean).collect():
        with files.random_access(r.path) as f:
            f.seek(r.at)
            fields, block = warc.parsed(gzip.decompress(f.read(r.size)))
        assert fields["WARC-Date"] == "2025-02-03T04:05:06Z"
        if r.record_type == "revisit":
            assert warc.payload_of(block) == b"" and fields["WARC-Profile"] == warc.REVISIT_PROFILE
            assert fields["WARC-Refers-To"].startswith("<urn:uuid:")
        else:
            assert warc.payload_digest(warc.payload_of(block)) == r.payload_digest
    # a header cannot be forged through a url
    assert {r.uri for r in headers.collect()} >= {"http://b/y?q=%C3%BC%20%0D%0Az:%201", None}


def test_tasks_start_new_archives(spark, monkeypatch):
    rows = [(i, "u", "x" * 1000 + str(i)) for i in range(40)]
    old, warc.ARCHIVE_BYTES = warc.ARCHIVE_BYTES, 5000
    try:  # the writer's closure takes the module's value where the driver and the workers share code
        manifest = warc.write_archives(pages(spark, rows).coalesce(1), DATE)
        assert sum(r.records for r in manifest.collect()) == 40
    finally:
        warc.ARCHIVE_BYTES = old
    assert warc.read_headers(manifest).count() == 40


def test_a_damaged_record_is_found(tmp_path):
    record = warc.response_record("urn:x", 1, "u", DATE, b"payload")
    with pytest.raises(ValueError):
        warc.parsed(gzip.decompress(record)[:-6])
    (tmp_path / "a.warc.gz").write_bytes(record + record[:-9])
    with files.random_access(str(tmp_path / "a.warc.gz")) as f, pytest.raises(ValueError):
        list(warc.records(f))


def test_a_hot_digest_is_split(spark):
    """A third of the headers share a digest; their join with the responses that stay is dealt to several tasks."""
    ship_package(spark)
    rows = spark.range(30_000).selectExpr(
        "'p' AS path", "id AS at", "10L AS size", "'response' AS record_type", "concat('r', id) AS record_id", "id AS page_id",
        "repeat('u', 50) AS uri", "CASE WHEN id % 3 = 0 THEN 'HOT' ELSE concat('D', id) END AS payload_digest",
        "5L AS payload_bytes", "CAST(NULL AS STRING) AS refers_to_record")
    headers = stored(rows.repartition(8), "headers")
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB", "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        out = warc.resolve(headers)
        targets = {r.page_id: r.target and r.target.page_id for r in out.collect()}
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert "skew=true" in plan or "isSkewJoin=true" in plan
    assert targets == {i: 29_997 if i % 3 == 0 and i != 29_997 else None for i in range(30_000)}


def test_archives_of_empty_pages_close_too(spark, monkeypatch):
    ship_package(spark)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2_000)
    pages = spark.createDataFrame([(i, None, None) for i in range(60)], "page_id long, url string, html string").coalesce(1)
    manifest = warc.write_archives(pages, "2024-01-01T00:00:00Z")
    assert manifest.count() > 3 and sum(r.records for r in manifest.collect()) == 60
