"""WARC archives of pages, written and read back as a chunked record table.

Writing: a payload longer than `segment_chars` is cut, piece by piece, into rows of record id and chunk number, and each row becomes a
record of its own (first a response, then continuations), so no buffer holds more than a segment beside the input row. Every record is
a gzip member. Spark's text writer puts them into files of any store that Spark knows, and its commit protocol makes lost
tasks harmless; its line end is an empty gzip member, which readers of WARC files pass over.

Reading: the same empty member ends a line for Spark's text reader, so archives of any store are read in splits, a record at a time. The
segments of an oversized payload are dealt by record id and sorted by number; a running SHA-1 goes from chunk to chunk, and a record's
last chunk carries the digest of the full payload. `read_files` reads archives of other writers, each file as a stream.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import sys
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canopy.llm.common import stage, table, work_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

SEGMENT_CHARS = 1 << 20
PIECE = 1 << 20
CRLF = "\r\n"
# fixed values of the formats
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:page:"
EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00" + bytes(8)
LINES = {"lineSep": EMPTY_MEMBER.decode("latin-1"), "encoding": "ISO-8859-1"}
NAMES = ["record_id", "chunk", "n_bytes", "data", "type", "refers_to", "payload_bytes", "payload_digest", "intact"]
CHUNKS = "record_id string, chunk long, n_bytes long, data binary, type string, refers_to string, payload_bytes long, payload_digest string, intact boolean"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of SHA-1: each 5 hex digits are 4 digits of base 32. The argument of a lambda, so that the hash is computed once."""
    quads = lambda h: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.lpad(F.conv(h.substr(i * 5 + 1, F.lit(5)), 16, 32), 4, "0"))
    digits = F.get(F.transform(F.array(F.sha1(data)), lambda h: F.array_join(quads(h), "")), F.lit(0))
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def plan_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages with payload, payload_bytes, payload_digest, refers_to (the page that stores an equal payload; null: this one does).

    Of equal payloads of at least min_bytes bytes the largest page_id's is stored; rows that repeat this id are each
    stored. Payloads whose ids are all null are each stored. A null html is an empty payload.
    """
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), base32_sha1(F.encode(payload, "UTF-8")).alias("payload_digest"))
    leaders = rows.groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("leader"))
    leaders = stage(leaders, "leaders")  # a table on both sides lets a join split a hot digest
    joined = rows.join(leaders, ["payload_digest", "payload_bytes"])
    return joined.withColumn("refers_to", F.when((F.col("payload_bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("leader")), F.col("leader"))).drop("leader")


def record(kind: str, rid: str, block: bytes, *fields: tuple[str, str], date: str, content: str = "application/http; msgtype=response") -> bytes:
    """A record as a gzip member, with the two line ends after it."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", f"WARC-Date: {date}", *(f"{k}: {v}" for k, v in fields), f"Content-Type: {content}", f"Content-Length: {len(block)}"]
    return gzip.compress((CRLF.join(lines) + CRLF * 2).encode() + block + 2 * CRLF.encode(), 6, mtime=0)


def record_rows(page: str, url: str, payload: str, size: int, digest: str, refers_to: str | None, date: str, segment_chars: int) -> Iterator[bytes]:
    """A page's records: one, or for a payload of more than segment_chars characters one for each such piece."""
    rid = f"<{ID_PREFIX}{page}>"
    uri = re.sub(r"[\x00-\x20\x7f]", "%20", url)  # these would break a header line
    http = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: {size}{CRLF * 2}".encode()
    every = [("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to is not None:
        yield record("revisit", rid, http, *every, ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{ID_PREFIX}{refers_to}>"), date=date)
        return
    n = max(1, -(-len(payload) // segment_chars))
    for i in range(n):
        block = payload[i * segment_chars : (i + 1) * segment_chars].encode("utf-8", "replace")
        of = [("WARC-Segment-Number", str(i + 1))] if n > 1 else []
        last = [("WARC-Segment-Total-Length", str(size + len(http)))] if n > 1 and i == n - 1 else []
        if i == 0:
            yield record("response", rid, http + block, *every, *of, *last, date=date)
        else:
            yield record("continuation", f"{rid[:-1]}#{i + 1}>", block, *every, *of, ("WARC-Segment-Origin-ID", rid), *last, date=date)


def write_archives(records: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", segment_chars: int = SEGMENT_CHARS) -> None:
    """An archive for each partition of records (see plan_records), replacing what was at path. A null page_id is the id `null`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held, begun = [], 0, False
        for b in batches:
            for x in b.itertuples(index=False):
                if not begun:
                    rows, begun = [record("warcinfo", f"<{ID_PREFIX}info>", b"format: WARC File Format 1.1" + CRLF.encode(), date=date, content="application/warc-fields")], True
                for member in record_rows(x.page, x.url, x.payload, x.payload_bytes, x.payload_digest, None if pd.isna(x.other) else x.other, date, segment_chars):
                    rows.append(member)
                    held += len(member)
                    if held >= 4 * PIECE:
                        yield pd.DataFrame({"member": rows})
                        rows, held = [], 0
        if rows:
            yield pd.DataFrame({"member": rows})

    page = F.coalesce(F.col("page_id").cast("string"), F.lit("null")).alias("page")
    wanted = records.select(page, "url", F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise("").alias("payload"), "payload_bytes", "payload_digest", F.col("refers_to").cast("string").alias("other"))
    wanted.mapInPandas(run, "member binary").select(F.col("member").cast("string").alias("value")).write.mode("overwrite").options(**LINES).text(path)


def parsed(raw: bytes) -> tuple[dict[str, str], bytes, int]:
    """(fields, block, payload length as the HTTP head says it or -1) of a record, whose HTTP head is taken off. ValueError if it is none."""
    if not raw.startswith(b"WARC/"):
        raise ValueError(f"no record starts with {raw[:40]!r}")
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split(CRLF)[1:])}
    block, declared = rest[: int(fields["content-length"])], -1
    if len(block) < int(fields["content-length"]):
        raise ValueError("an archive ends within a record")
    if fields["warc-type"] in ("response", "revisit"):
        http, _, block = block.partition(b"\r\n\r\n")
        said = re.search(rb"(?mi)^content-length:\s*(\d+)", http)
        declared = int(said[1]) if said else -1
    return fields, block, declared


class Digest:
    """A record's chunk rows, one after the other, and the closing one with what the record says and what its bytes are."""

    def __init__(self, fields: dict[str, str], declared: int):
        self.id, self.kind, self.refers = fields["warc-record-id"], fields["warc-type"], fields.get("warc-refers-to")
        self.said, self.declared, self.sha, self.total, self.chunk = fields["warc-payload-digest"].removeprefix("sha1:"), declared, hashlib.sha1(), 0, 0

    def rows(self, data: bytes) -> Iterator[dict]:
        for k in range(0, len(data), PIECE):
            part = data[k : k + PIECE]
            self.sha.update(part)
            self.total += len(part)
            yield {"record_id": self.id, "chunk": self.chunk, "n_bytes": len(part), "data": part}
            self.chunk += 1

    def closed(self) -> dict:
        full, own = self.kind == "response", base64.b32encode(self.sha.digest()).decode()
        return {"record_id": self.id, "chunk": self.chunk, "n_bytes": 0, "data": b"", "type": self.kind, "refers_to": self.refers, "payload_bytes": self.declared, "payload_digest": own if full else self.said, "intact": not full or (own == self.said and self.total == self.declared)}


def batched(rows: Iterator[dict], with_data: bool) -> Iterator[pd.DataFrame]:
    """Rows as frames of bounded size; without data only closing rows."""
    out, held = [], 0
    for r in rows:
        if with_data or "type" in r:
            out.append([r.get(k) for k in NAMES])
            held += 1000 + (r["n_bytes"] if with_data else 0)
        if held >= 8 * PIECE:
            yield pd.DataFrame(out, columns=NAMES)
            out, held = [], 0
    if out:
        yield pd.DataFrame(out, columns=NAMES)


class Rest(io.RawIOBase):
    """A stream whose first bytes were read to tell its kind."""

    def __init__(self, start: bytes, file: object):
        self.start, self.file = start, file

    def readable(self) -> bool:
        return True

    def readinto(self, buffer: memoryview) -> int:
        got = self.start[: len(buffer)] or self.file.read(len(buffer))
        self.start = self.start[len(got) :] if self.start else b""
        buffer[: len(got)] = got
        return len(got)


class Stream:
    """Reads a file forward: lines, and bodies in pieces."""

    def __init__(self, uri: str):
        if uri.startswith("file:") or "://" not in uri:
            self.file = open("/" + uri.removeprefix("file:").lstrip("/"), "rb")  # noqa: SIM115
        else:
            import pyarrow.fs

            fs, path = pyarrow.fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))
            self.file = fs.open_input_stream(path, compression=None)
        start = self.file.read(2)
        self.file = io.BufferedReader(Rest(start, self.file))
        if start == b"\x1f\x8b":
            self.file = gzip.GzipFile(fileobj=self.file)
        self.kept, self.at = b"", 0

    def more(self) -> bool:
        got = self.file.read(PIECE)
        self.kept, self.at = self.kept[self.at :] + got, 0
        return bool(got)

    def line(self) -> bytes | None:
        while (end := self.kept.find(b"\n", self.at)) < 0:
            if not self.more():
                return None
        got, self.at = self.kept[self.at : end + 1], end + 1
        return got.rstrip(b"\r\n")

    def body(self, n: int) -> Iterator[bytes]:
        while n:
            if self.at == len(self.kept) and not self.more():
                raise ValueError("an archive ends within a record")
            got = self.kept[self.at : self.at + min(n, PIECE)]
            self.at += len(got)
            n -= len(got)
            yield got


def read_chunks(uri: str) -> Iterator[dict]:
    """Chunk rows of an archive, in pieces of bounded size; records that are no response or revisit are passed over."""
    s, d = Stream(uri), None
    while (first := s.line()) is not None:
        if not first:
            continue  # the two line ends after a record
        if not first.startswith(b"WARC/"):
            raise ValueError(f"{uri}: no record starts with {first[:40]!r}")
        fields: dict[str, str] = {}
        while x := s.line():
            k, _, v = x.decode().partition(":")
            fields[k.lower()] = v.strip()
        n, kind = int(fields["content-length"]), fields["warc-type"]
        if kind not in ("response", "revisit", "continuation"):
            for _ in s.body(n):
                pass
            continue
        if kind == "continuation":
            if d is None or fields["warc-segment-origin-id"] != d.id:
                raise ValueError(f"{uri}: a segment of {fields['warc-segment-origin-id']} stands alone")
        else:
            declared = -1
            while (x := s.line()) is not None:  # the HTTP head within the block
                n -= len(x) + 2
                if x.lower().startswith(b"content-length:"):
                    declared = int(x.split(b":")[1])
                if not x:
                    break
            d = Digest(fields, declared)
        for data in s.body(n):
            yield from d.rows(data)
        if "warc-segment-number" not in fields or "warc-segment-total-length" in fields:
            yield d.closed()


def read_archives(spark: SparkSession, path: str, with_data: bool = False) -> DataFrame:
    """The chunk rows of all archives of write_archives at path; a record's closing row (type not null) has its length and digest. Without data, only closing rows."""
    members = spark.read.options(**LINES).text(path).select(F.col("value").cast("binary").alias("member"))

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[dict]:
            for b in batches:
                for m in b["member"]:
                    if b"\r\nWARC-Segment-Number:" in (start := head(m)) or b"WARC-Type: warcinfo" in start:
                        continue
                    fields, block, declared = parsed(gzip.decompress(m))
                    d = Digest(fields, declared)
                    yield from d.rows(block)
                    yield d.closed()

        yield from batched(rows(), with_data)

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for m in b["member"]:
                if b"\r\nWARC-Segment-Number:" in head(m):
                    fields = parsed(gzip.decompress(m))[0]
                    yield pd.DataFrame([(fields.get("warc-segment-origin-id", fields["warc-record-id"]), int(fields["warc-segment-number"]), m)], columns=["id", "number", "member"])

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[dict]:
            open_record, expected = None, 0
            for b in batches:
                for number, m in zip(b["number"], b["member"], strict=True):
                    fields, block, declared = parsed(gzip.decompress(m))
                    if number == 1:
                        open_record, expected = Digest(fields, declared), 1
                    if open_record is None or number != expected or fields.get("warc-segment-origin-id", open_record.id) != open_record.id:
                        raise ValueError(f"segment {number} of {fields['warc-record-id']} stands alone")
                    yield from open_record.rows(block)
                    expected += 1
                    if "warc-segment-total-length" in fields:
                        yield open_record.closed()
                        open_record = None

        yield from batched(rows(), with_data)

    cut = members.mapInPandas(segments, "id string, number long, member binary").withColumn("copy", F.row_number().over(Window.partitionBy("id", "number").orderBy("member")))
    cut = cut.repartition("id").sortWithinPartitions("id", "copy", "number")
    return members.mapInPandas(whole, CHUNKS).unionByName(cut.mapInPandas(joined, CHUNKS))


def head(member: bytes) -> bytes:
    """The first bytes of a member's record, without decompressing the rest."""
    return zlib.decompressobj(31).decompress(member, 2048).partition(b"\r\n\r\n")[0]


def read_files(spark: SparkSession, path: str, with_data: bool = False) -> DataFrame:
    """read_archives for archives of any writer, plain or in one or many gzip members: each file is a stream that a task opens by its address (a local path, or a store that pyarrow knows)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for uri in b["path"]:
                yield from batched(read_chunks(uri), with_data)

    return spark.read.format("binaryFile").load(path).select("path").mapInPandas(read, CHUNKS)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, length, digest, type and reference of every page, as read back from the archives that were written."""
    path = work_path(spark, "warc")
    write_archives(plan_records(table(spark, sf_dir, "pages")), path)
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '{ID_PREFIX}([^>]*)', 1) AS bigint)")
    closed = read_archives(spark, path).filter(F.col("type").isNotNull())
    checked = F.when(F.col("intact"), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("a payload does not match its digest: "), "record_id")))
    return closed.select(number("record_id").alias("page_id"), "payload_bytes", checked.alias("payload_digest"), F.col("type").alias("record_type"), number("refers_to").alias("refers_to"))


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (
  SELECT page_id, octet_length(encode(h)) AS payload_bytes, max(page_id) OVER (PARTITION BY h) AS leader,
         list_transform(range(0, 8), lambda i: ('0x' || substr(sha1(h), i * 5 + 1, 5))::BIGINT) AS v
  FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(v, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', x // 32768 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', x // 1024 % 32 + 1, 1)
         || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', x // 32 % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', x % 32 + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = leader THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> leader THEN leader END AS refers_to
FROM d
"""
