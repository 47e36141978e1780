import base64
import gzip
import hashlib
import os
from collections import defaultdict

from pyspark.sql import functions as F

from lodestar.llm import warc
from lodestar.llm.catalog import op12_warc

SMALL = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, html string, payload string, record_id long, type string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "p", 3, "t") for i, u, h in rows], SCHEMA)


def brute(rows, min_bytes=0):
    """(page_id, payload_bytes, digest, type, refers_to) by plain loops."""
    groups = defaultdict(list)
    for i, _, h in rows:
        groups[(h or "").encode()].append(i)
    out = []
    for payload, ids in groups.items():
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        ids = sorted(ids, key=lambda x: (x is not None, x or 0))
        for place, i in enumerate(ids):
            last = place == len(ids) - 1 or len(payload) < min_bytes
            out.append((i, len(payload), digest, "response" if last else "revisit", None if last else ids[-1]))
    return sorted(out, key=repr)


def run(spark, rows, min_bytes=0):
    archive = warc.write(pages(spark, rows))
    found = warc.resolve(warc.read(spark, warc.deduplicate(spark, archive, min_bytes=min_bytes)))
    return sorted((tuple(r) for r in found.drop("uri").collect()), key=repr)


AWKWARD = [
    (1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (3, "http://a/3", "two"), (4, None, None),
    (5, "http://a/\r\nX: y", ""), (6, "http://a/6", "\r\n\r\n"), (7, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\nx"),
    (8, "u", "WARC/1.1\r\n" * 3), (9, "u", "WARC/1.1\r\n" * 3), (10, "u", "a\nb\r\nc\r"), (None, "u", "two"),
    (None, None, None), (11, "é", "日本語 \U0001F44D\x00\x85"), (3, "http://a/3", "two"), (12, "u", "x" * 300_000),
    (13, "u", "x" * 300_000), (-4, "u", "two"), (14, "u", "WWARC/1.1\r\nWARC/WARC/1.1\r\n"), (15, "u", "Content-Length: 1")]


def test_table(spark):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()]
    assert sorted((tuple(r) for r in op12_warc(spark, SMALL).collect()), key=repr) == brute(rows)


def test_awkward_rows(spark):
    assert run(spark, AWKWARD) == brute(AWKWARD)


def test_least_size(spark):
    assert run(spark, AWKWARD, min_bytes=11) == brute(AWKWARD, min_bytes=11)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_archive_round_trip(spark):
    archive = warc.write(pages(spark, AWKWARD).coalesce(2))
    back = warc.read(spark, archive, payloads=True).collect()
    assert sorted((r.page_id, bytes(r.payload)) for r in back if r.page_id is not None) == sorted(
        (i, (h or "").encode()) for i, _, h in AWKWARD if i is not None)
    assert all(r.intact and r.type == "response" for r in back)
    assert len({r.record_id for r in back}) == len(AWKWARD)
    assert {r.uri for r in back} >= {"http://a/%0D%0AX: y", None, "é"}


def test_files_are_plain_archives(spark):
    """Read by the format's own rules, without the library's reader."""
    rows = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (3, "http://a/3", "WARC/1.1\r\n other")]
    archive = warc.deduplicate(spark, warc.write(pages(spark, rows))).removeprefix("file://")
    found = []
    for name in os.listdir(archive):
        if not name.endswith(".gz"):
            continue
        data = gzip.open(os.path.join(archive, name)).read()
        while data:
            assert data.startswith(b"WARC/1.1\r\n")
            end = data.index(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in data[:end].decode().split("\r\n")[1:])
            size = int(fields["Content-Length"])
            found.append((fields, data[end + 4:end + 4 + size]))
            assert data[end + 4 + size:].startswith(b"\r\n\r\n")
            data = data[end + 8 + size:]
    by_page = {f["X-Page-Id"]: (f, b) for f, b in found}
    revisit, kept = by_page["1"], by_page["2"]
    assert revisit[0]["WARC-Type"] == "revisit" and revisit[0]["WARC-Profile"] == warc.PROFILE
    assert revisit[0]["WARC-Refers-To"] == kept[0]["WARC-Record-ID"]
    assert revisit[0]["WARC-Refers-To-Target-URI"] == "http://a/2" and b"same" not in revisit[1]
    assert kept[1].endswith(b"\r\n\r\nsame") and kept[0]["WARC-Type"] == "response"
    assert by_page["3"][1].endswith(b"WARC/1.1\r\n other")


def test_fresh_ids(spark):
    rows = [(i, "u", f"text {i % 4}") for i in range(40)]
    archive = warc.write(pages(spark, rows))
    old = {r.record_id for r in warc.read(spark, archive).collect()}
    new = {r.record_id for r in warc.read(spark, warc.deduplicate(spark, archive)).collect()}
    assert len(new) == 40 and not old & new


def test_hot_payload(spark, monkeypatch):
    """A payload of a third of the rows joins in place, others by key."""
    rows = [(i, "u", "hot" if i % 3 == 0 else f"t{i // 2}") for i in range(3000)]
    monkeypatch.setattr(warc, "HOT_SHARE", 10)
    assert run(spark, rows) == brute(rows)
    large = warc.read(spark, warc.write(pages(spark, rows)))
    copies = large.groupBy("payload_digest", "payload_bytes").agg(F.count(F.lit(1)).alias("n"))
    assert copies.where(F.col("n") * warc.HOT_SHARE > 3000).count() == 1
