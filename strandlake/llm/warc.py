"""WARC archives with a two-level capture index.

Writing: each page becomes a record, a gzip member of an archive file; a page whose payload an earlier page id has is a
revisit record. Index: captures sorted by URL key (host reversed) fill compressed blocks of index part files, each of
which ends in a sparse directory of its blocks' first keys. Reading: a key is routed to index parts by their key
ranges, a binary search in a part's directory finds its blocks, a second one in the block finds its captures, and
records come by range reads.

Defined cases: a null or empty payload has no bytes and takes part in revisits like others; rows that repeat the least
page id of a payload are responses too, and repeated rows are records each; a null page id is never referred to; a null URL
has the empty key; captures of one key follow each other by page id, file and offset; pages of any length are one record;
an empty table gives an empty result; only the id, URL and html columns are read, so further ones cannot clash. Files get a new name in every attempt; only those that a written manifest names are read.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_dir

BLOCK_LINES = 1000
DATE = "2026-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """The sort key of a URL: host parts reversed, then path and query, without scheme, user, fragment or default port.

    Tabs and newlines, which separate the index's fields and lines, are escaped.
    """
    raw = (url or "").strip().replace("\n", "%0A").replace("\t", "%09")
    try:
        parts = urlsplit((url or "").strip())
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return raw
    if not host:
        return raw
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "") + ")" + (parts.path or "/")
    return key + (f"?{parts.query}" if parts.query else "")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def _one_line(value: object) -> str:
    return " ".join(str(value).split())


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One uncompressed record; with ``refers_to`` a revisit, whose HTTP headers state the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_one_line(url or '')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"] if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """What a record says: page_id, url, record_type, refers_to, payload (None for revisits), digest, payload_bytes."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    lengths = [x.split(b":", 1)[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    page = lambda text: int(text[len("<urn:page:") : -1]) if text and text != "<urn:page:>" else None
    revisit = fields["warc-type"] == "revisit"
    return {
        "page_id": page(fields["warc-record-id"]), "url": fields["warc-target-uri"], "record_type": fields["warc-type"], "refers_to": page(fields.get("warc-refers-to", "")),
        "payload": None if revisit else payload, "digest": fields["warc-payload-digest"].removeprefix("sha1:") if revisit else payload_digest(payload), "payload_bytes": int(lengths[0]) if revisit else len(payload),
    }


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Adds payload, digest (hex) and refers_to: the least page id with an equal payload, null for that page itself."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha1("payload"))
    first = rows.filter((F.length("payload") >= least_bytes) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("first"))
    first = materialize(first, "payloads")  # one row per payload; a frequent payload's pages can then be dealt to several tasks
    return rows.join(first, "digest", "left").withColumn("refers_to", F.when((F.length("payload") >= least_bytes) & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))).drop("first")


_CAPTURE = "key string, page_id long, file string, offset long, length long"


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Writes the rows of ``with_revisits`` to archives, one per task; returns the captures."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        name, sink = f"{base}/{uuid.uuid4().hex}.warc.gz", None
        try:
            for batch in batches:
                out = []
                for page, url, payload, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                    if sink is None:
                        sink, at = fs.open_output_stream(name, compression=None), 0
                    member = gzip.compress(make_record(page, url, payload, payload_digest(payload), refers), 6, mtime=0)
                    sink.write(member)
                    out.append((url_key(url), page, name, at, len(member)))
                    at += len(member)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["key", "page_id", "file", "offset", "length"])
        finally:
            if sink is not None:
                sink.close()

    return rows.select("page_id", "url", "payload", "refers_to").mapInArrow(write, _CAPTURE)


def write_index(captures: DataFrame, folder: str, partitions: int, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Writes sorted index parts; returns one row (part, first_key, last_key, path, bytes) per part."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, base = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        path = f"{base}/{uuid.uuid4().hex}.idx"
        held: list[tuple[str, str]] = []
        directory: list[tuple[str, int, int]] = []
        at, last = 0, ""
        with fs.open_output_stream(path, compression=None) as sink:

            def flush() -> None:
                nonlocal at
                block = zlib.compress("\n".join(f"{k}\t{v}" for k, v in held).encode())
                sink.write(block)
                directory.append((held[0][0], at, len(block)))
                at += len(block)
                held.clear()

            for batch in batches:
                for row in batch.to_pylist():
                    last = row.pop("key")
                    held.append((last, json.dumps(row, separators=(",", ":"))))
                    if len(held) == block_lines:
                        flush()
            if held:
                flush()
            tail = zlib.compress(json.dumps(directory).encode())
            sink.write(tail + struct.pack("<q", at))
            size = at + len(tail) + 8
        if directory:
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "first_key": [directory[0][0]], "last_key": [last], "path": [path], "bytes": [size]})

    ordered = captures.withColumn("k", F.col("key").cast("binary")).repartitionByRange(partitions, "k", "page_id", "file", "offset").sortWithinPartitions("k", "page_id", "file", "offset")
    return ordered.drop("k").mapInArrow(write, "part long, first_key string, last_key string, path string, bytes long")


class IndexPart:
    """Binary search in one index part through ``read_at(offset, length)``."""

    def __init__(self, read_at, size: int):
        (start,) = struct.unpack("<q", read_at(size - 8, 8))
        self.directory = json.loads(zlib.decompress(read_at(start, size - 8 - start)))
        self.firsts = [d[0].encode() for d in self.directory]
        self.block = lru_cache(maxsize=4)(lambda i: [x.split("\t", 1) for x in zlib.decompress(read_at(*self.directory[i][1:])).decode().split("\n")])

    def find(self, key: str) -> Iterator[dict]:
        """All captures of a key; it may go over several blocks."""
        wanted = key.encode()
        i = max(0, bisect.bisect_left(self.firsts, wanted) - 1)
        while i < len(self.firsts) and self.firsts[i] <= wanted:
            lines = self.block(i)
            at = bisect.bisect_left(lines, wanted, key=lambda x: x[0].encode())
            while at < len(lines) and lines[at][0] == key:
                yield json.loads(lines[at][1])
                at += 1
            i += 1


def _reader(source):
    def read_at(at: int, n: int) -> bytes:
        source.seek(at)
        return source.read(n)

    return read_at


def look_up(keys: DataFrame, manifest: DataFrame, folder: str) -> DataFrame:
    """Captures (page_id, file, offset, length) of the distinct values of column ``key``.

    The driver holds the key range of each index part, of which there are as many as shuffle partitions.
    """
    parts = sorted((r["first_key"].encode(), r["last_key"].encode(), r["path"], r["bytes"]) for r in manifest.collect())
    firsts, lasts = [p[0] for p in parts], [p[1] for p in parts]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key in batch.column(0).to_pylist():
                key = key or ""
                for i in range(bisect.bisect_left(lasts, key.encode()), bisect.bisect_right(firsts, key.encode())):
                    out.append((i, key))
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.int32()), pa.array([k for _, k in out], pa.string())], names=["part", "key"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pa.fs.FileSystem.from_uri(folder)
        now, source, part = None, None, None
        for batch in batches:
            out = []
            for i, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if i != now:
                    if source is not None:
                        source.close()
                    now, source = i, fs.open_input_file(parts[i][2])
                    part = IndexPart(_reader(source), parts[i][3])
                for capture in part.find(key):
                    out.append(capture)
                    if len(out) == 4096:  # a key may have any number of captures
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                        out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if source is not None:
            source.close()

    schema = pa.schema([("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
    routed = keys.select("key").distinct().mapInArrow(route, "part int, key string")
    n = max(1, len(parts))
    return routed.repartition(n, "part").sortWithinPartitions("part", "key").mapInArrow(search, "page_id long, file string, offset long, length long")


def read_records(captures: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """Range-reads the captures' records: page_id, payload_bytes, payload_digest, record_type, refers_to (and url, payload)."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *["url", "payload"] * with_payload]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()][: len(names)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pa.fs.FileSystem.from_uri(folder)
        now, source = None, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("file", "offset", "length")]
            for a in range(0, batch.num_rows, 256):
                out = []
                for file, offset, length in zip(*(c[a : a + 256] for c in columns), strict=True):
                    if file != now:
                        if source is not None:
                            source.close()
                        now, source = file, fs.open_input_file(file)
                    r = parse_record(gzip.decompress(_reader(source)(offset, length)))
                    out.append((r["page_id"], r["payload_bytes"], r["digest"], r["record_type"], r["refers_to"], r["url"], r["payload"])[: len(names)])
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
        if source is not None:
            source.close()

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", url string, payload binary" * with_payload
    n = max(1, int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = captures.withColumn("stretch", F.shiftright("offset", 24)).repartition(n, "file", "stretch").sortWithinPartitions("file", "offset")
    return spread.select("file", "offset", "length").mapInArrow(read, schema)


def archive(spark: SparkSession, pages: DataFrame, least_bytes: int = 0) -> tuple[DataFrame, str]:
    """Writes archives and their index; returns the index manifest and the folder."""
    folder = shared_dir(spark, "warc")
    captures = materialize(write_archives(with_revisits(pages, least_bytes), folder), "captures")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return materialize(write_index(captures, folder, n), "parts"), folder


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Archives ``pages``, then looks all their URLs up in the index and reads the records found."""
    manifest, folder = archive(spark, pages)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in batch.column(0).to_pylist()], pa.string())], names=["key"])

    wanted = pages.select(F.col("url").cast("string")).mapInArrow(keys, "key string")
    return read_records(look_up(wanted, manifest, folder), folder)


ORACLE_SQL = """
with rows as (select page_id, coalesce(html, '') as body from pages),
hashed as (select page_id, strlen(body) as payload_bytes, sha1(body) as hex from rows),
numbered as (select *, min(page_id) over (partition by hex) as first_id,
  list_transform(range(8), lambda i: list_reduce(list_transform(range(5), lambda j: instr('0123456789abcdef', substr(hex, 5 * i + j + 1, 1)) - 1), lambda a, b: a * 16 + b)) as parts from hashed)
select page_id, cast(payload_bytes as bigint) as payload_bytes,
  array_to_string(list_transform(parts, lambda v: concat(
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v // 32768) % 32 + 1, 1), substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v // 1024) % 32 + 1, 1),
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v // 32) % 32 + 1, 1), substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v % 32 + 1, 1))), '') as payload_digest,
  case when page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id = first_id then null else first_id end as refers_to
from numbered
"""
