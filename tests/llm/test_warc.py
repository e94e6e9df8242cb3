"""Round trips of archives: null and repeated ids, empty tables, oversized payloads, clashing columns, archives of other writers."""

import base64
import glob
import gzip
import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from canopy.llm import warc

R = random.Random(5)
BIG = "".join(R.choice("<p>é😀 abc\n") for _ in range(5000))
ROWS = [(1, "http://a/\r\nX: y", "<p>same</p>"), (2, None, "<p>same</p>"), (3, "http://c", None), (4, "http://d", ""), (5, "http://e", "é😀\r\n\r\nWARC/1.1\r\n" * 40), (6, "http://f", BIG), (7, "u", BIG), (7, "u", BIG), (8, "u", "twice"), (8, "u", "twice"), (None, "u", "no id"), (None, "u", "<p>same</p>"), (None, "u", "no id")]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumns({c: F.lit("own") for c in ("payload", "leader", "rid", "type")}).repartition(3)


def want(rows):
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(last.get(h or "", float("-inf")), float("-inf") if i is None else i)
    out = Counter()
    for i, _, h in rows:
        data, of = (h or "").encode(), last[h or ""]
        refers = None if i == of or of == float("-inf") else of
        out[(i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if refers is None else "revisit", refers)] += 1
    return out


def shown(r):
    number = lambda x: None if x is None or x[10:-1] == "null" else int(x[10:-1])
    return number(r["record_id"]), r["payload_bytes"], r["payload_digest"], r["type"], number(r["refers_to"])


@pytest.mark.parametrize("segment_chars", [100, 1 << 20])
@pytest.mark.parametrize("read", [warc.read_archives, warc.read_files])
def test_round_trip(spark, pages, tmp_path, read, segment_chars):
    at = f"file://{tmp_path}/w"
    records = warc.plan_records(pages)
    if segment_chars == 100 and read is warc.read_files:
        records = records.coalesce(1)
    warc.write_archives(records, at, segment_chars=segment_chars)
    closed = read(spark, at).collect()
    assert Counter(map(shown, closed)) == want(ROWS) and all(r["intact"] for r in closed)
    chunks = sorted((r["chunk"], bytes(r["data"])) for r in read(spark, at, True).collect() if r["record_id"] == "<urn:page:5>")
    assert b"".join(c for _, c in chunks).decode() == ROWS[4][2]


def test_each_record_is_a_member(spark, pages, tmp_path):
    at = f"{tmp_path}/w"
    warc.write_archives(warc.plan_records(pages), f"file://{at}", segment_chars=100)
    for f in glob.glob(f"{at}/part-*"):
        with open(f, "rb") as x:
            whole = x.read()
        members = [m for m in whole.split(warc.EMPTY_MEMBER) if m]
        assert all(gzip.decompress(m).startswith(b"WARC/1.1\r\n") and gzip.decompress(m).endswith(b"\r\n\r\n") for m in members)
        assert gzip.decompress(whole) == b"".join(map(gzip.decompress, members)) and b"WARC-Type: warcinfo" in gzip.decompress(members[0])


def test_empty_table_and_damage(spark, pages, tmp_path):
    warc.write_archives(warc.plan_records(pages.limit(0)), f"file://{tmp_path}/e")
    assert warc.read_archives(spark, f"file://{tmp_path}/e").count() == 0
    lie = warc.plan_records(pages).withColumn("payload", F.concat("payload", F.lit("x"))).withColumn("payload_bytes", F.col("payload_bytes") + 1)
    warc.write_archives(lie, f"file://{tmp_path}/d")
    out = warc.read_archives(spark, f"file://{tmp_path}/d").collect()
    assert {r["intact"] for r in out if r["type"] == "response"} == {False}


def test_least_bytes_of_a_revisit(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    got = {r["page_id"]: r["refers_to"] for r in warc.plan_records(pages, min_bytes=3).collect()}
    assert got == {1: None, 2: None, 3: 4, 4: None}


def test_plain_archives_of_other_writers(spark, tmp_path):
    body = b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nabc"
    digest = base64.b32encode(hashlib.sha1(b"abc").digest()).decode()
    record = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nWARC-Payload-Digest: sha1:{digest}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
    request = b"WARC/1.0\r\nWARC-Type: request\r\nWARC-Record-ID: <urn:y>\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "plain.warc").write_bytes(request + record)
    (tmp_path / "a" / "one.warc.gz").write_bytes(gzip.compress(request + record))
    (tmp_path / "a" / "many.warc.gz").write_bytes(gzip.compress(request) + gzip.compress(record))
    out = warc.read_files(spark, f"file://{tmp_path}/a").collect()
    assert [(r["record_id"], r["payload_bytes"], r["payload_digest"], r["intact"]) for r in out] == [("<urn:x>", 3, digest, True)] * 3
