"""Chunked record table for web-archive records and other oversized payloads.

A record becomes rows (record_id, chunk_no, ...) of at most `chunk_bytes` payload bytes.  Every row carries the digest
of its own bytes and the running digest of the record up to its end, updated incrementally - so a consumer can verify
any prefix of a record, resume after the last good chunk, and never needs more than one chunk in memory; the row with
is_last has the digest of the whole payload.

`chunk_pages` cuts the payload column of a table inside the JVM, so that what crosses to Python is a stream of chunks and
never a record: the running digest is carried from batch to batch.  (The row itself is as large as its reader made it.)
`read_warc` streams archive files (plain, or gzip with one or many members): it holds one read block and one chunk at a
time, so a 100 GB record needs no more memory than a small one.  One task reads one file.  `broken_records` checks a
chunk table with built-in aggregates.

Defined cases: a null payload gives one row with null payload and digests, length 0; an empty one gives one row with
an empty payload and the digest of nothing; a null url or id counts as empty text in the record identifier; repeated
rows have the same record_id and give repeated rows; an empty table gives an empty result; other columns are ignored.
A damaged archive never ends the job: what can't be read gives a row with `error` and the rest of the file is read on -
from the next line that starts a record after a line that is none, a header without an end or a Content-Length that is
missing, no number or negative ('not a record', 'bad length'; several such lines together are one row), from the next member
after a damaged gzip member ('damaged gzip'); a record that ends too early has a last row that isn't is_last, with
'truncated'.  Header lines are cut at LINE bytes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 16 * 1024
FLUSH_BYTES = 4 << 20
SCHEMA = "record_id string, page_id bigint, chunk_no int, byte_start bigint, n_bytes int, is_last boolean, chunk_digest string, running_digest string, payload binary"
WARC_SCHEMA = "record_id string, warc_type string, target_uri string, chunk_no int, byte_start bigint, n_bytes int, is_last boolean, chunk_digest string, running_digest string, payload binary, error string"
LINE = 1 << 16


class _Rows:
    """Collects rows and releases them as Arrow batches of about FLUSH_BYTES payload."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.bytes = schema, [], 0

    def add(self, *row) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.bytes += len(row[9] or b"") + 300
        if self.bytes >= FLUSH_BYTES:
            yield self.batch()

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * len(self.schema)
        out = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, self.schema)], schema=self.schema)
        self.rows, self.bytes = [], 0
        return out


def _arrow(*fields: tuple[str, pa.DataType]) -> pa.Schema:
    return pa.schema([pa.field(*f) for f in fields])


_TAIL = (("chunk_no", pa.int32()), ("byte_start", pa.int64()), ("n_bytes", pa.int32()), ("is_last", pa.bool_()), ("chunk_digest", pa.string()), ("running_digest", pa.string()), ("payload", pa.binary()))


def chunk_pages(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """The chunk table of a payload column (text as UTF-8, or binary)."""
    name = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col(url_col).cast("string"), F.lit(""))))
    urn = F.concat(F.lit("urn:uuid:"), F.regexp_replace(name, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))
    slim = pages.select(urn.alias("record_id"), F.col(id_col).cast("long").alias("page_id"), F.col(payload_col).cast("binary").alias("payload")).withColumn("size", F.length("payload"))
    last = F.greatest(F.ceil(F.coalesce("size", F.lit(0)) / chunk_bytes) - 1, F.lit(0)).cast("int")
    parts = slim.select("record_id", "page_id", "size", "payload", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    parts = parts.select("record_id", "page_id", "size", "chunk_no", F.substr("payload", F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes)).alias("part"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running = hashlib.sha256()  # of the record whose chunks are passing
        for batch in batches:
            size, number, part = (batch.column(i).to_pylist() for i in (2, 3, 4))
            own, so_far, start = [], [], []
            for k, p in zip(number, part):
                if not k:
                    running = hashlib.sha256()
                if p is not None:
                    running.update(p)
                own.append(None if p is None else hashlib.sha256(p).hexdigest())
                so_far.append(None if p is None else running.hexdigest())
                start.append(k * chunk_bytes)
            last = [a + chunk_bytes >= (n or 0) for a, n in zip(start, size)]
            columns = [batch.column(0), batch.column(1), batch.column(3), pa.array(start, pa.int64()), pa.array([len(p or b"") for p in part], pa.int32()), pa.array(last, pa.bool_()), pa.array(own, pa.string()), pa.array(so_far, pa.string()), batch.column(4).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    schema = _arrow(("record_id", pa.string()), ("page_id", pa.int64()), *_TAIL)
    return parts.mapInArrow(digest, SCHEMA)  # rows of a partition keep their order, so a record's chunks pass one after the other


def chunk_pages_sql(chunk_bytes: int = CHUNK_BYTES) -> str:
    """The same over `pages` in DuckDB."""
    m = "md5(coalesce(CAST(page_id AS VARCHAR), '') || '|' || coalesce(url, ''))"
    urn = "'urn:uuid:' || " + " || '-' || ".join(f"substr(m, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"""
WITH bytes AS (SELECT page_id, {m} AS m, encode(html) AS b, octet_length(encode(html)) AS n FROM pages),
cut AS (SELECT *, unnest(range(0, greatest(1, (coalesce(n, 0) + {chunk_bytes - 1}) // {chunk_bytes}))) AS k FROM bytes)
SELECT {urn} AS record_id, page_id, CAST(k AS INTEGER) AS chunk_no, CAST(k * {chunk_bytes} AS BIGINT) AS byte_start,
    CAST(coalesce(least({chunk_bytes}, n - k * {chunk_bytes}), 0) AS INTEGER) AS n_bytes, (k + 1) * {chunk_bytes} >= coalesce(n, 0) AS is_last,
    sha256(b[k * {chunk_bytes} + 1 : (k + 1) * {chunk_bytes}]) AS chunk_digest, sha256(b[1 : (k + 1) * {chunk_bytes}]) AS running_digest,
    b[k * {chunk_bytes} + 1 : (k + 1) * {chunk_bytes}] AS payload
FROM cut"""


class ByteStream:
    """Sequential reader over read(n): exact spans and lines, gzip members unpacked as they come."""

    def __init__(self, read: Callable[[int], bytes], block: int = 1 << 18):
        self.read, self.block, self.held, self.end = read, block, bytearray(), False
        self.packed, self.unzip = b"", None
        self.damaged, self.seeking, self.tail = 0, False, b""
        first = read(block)
        self.gzip = first[:2] == b"\x1f\x8b"
        self._take(first)

    def _take(self, raw: bytes) -> None:
        if not raw:
            self.end = not self.packed
            return
        if not self.gzip:
            self.held += raw
            return
        raw = self.packed + raw
        self.packed = b""
        if self.seeking:
            at = raw.find(b"\x1f\x8b\x08")
            self.seeking, raw = at < 0, raw[at:] if at >= 0 else raw[-2:]
            if self.seeking:
                self.tail = raw
                return
        enough = len(self.held) + 4 * self.block  # whatever is held, a call gets on
        while raw and len(self.held) < enough:
            if self.unzip is None:
                self.unzip = zlib.decompressobj(31)
            try:
                self.held += self.unzip.decompress(raw, self.block)
            except zlib.error:  # on with the next member; what this one gave so far stays
                self.damaged += 1
                self.unzip = None
                at = raw.find(b"\x1f\x8b\x08", 1)
                raw = raw[at:] if at > 0 else b""
                self.seeking = at <= 0
                continue
            raw = self.unzip.unused_data if self.unzip.eof else self.unzip.unconsumed_tail
            if self.unzip.eof:
                self.unzip = None
        self.packed = raw

    def _more(self) -> bool:
        if self.end:
            return False
        if self.packed:
            packed, self.packed = self.packed, b""
            self._take(packed)
        else:
            raw, tail = self.read(self.block), self.tail
            self.tail = b""
            self._take(tail + raw if raw else b"")
        return True

    def line(self) -> bytes | None:
        """The next line; a longer one than LINE bytes comes in pieces."""
        at = 0
        while (stop := self.held.find(b"\n", at)) < 0:
            at = len(self.held)
            if at >= LINE:
                stop = LINE - 1
                break
            if not self._more():
                if not self.held:
                    return None
                stop = len(self.held) - 1
                break
        out = bytes(self.held[: stop + 1])
        del self.held[: stop + 1]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self._more():
            pass
        out = bytes(self.held[:n])
        del self.held[: len(out)]
        return out


def warc_chunks(stream: ByteStream, chunk_bytes: int) -> Iterator[tuple]:
    """Rows of WARC_SCHEMA."""
    damaged, line, lost = 0, None, False

    def bad(why: str) -> tuple:
        return "", None, None, 0, 0, 0, False, None, None, None, why

    while True:
        if line is None or lost:
            line = stream.line()
            while line is not None and (not line.strip() or lost and not line.startswith(b"WARC/")):
                line = stream.line()
        if stream.damaged > damaged:
            damaged = stream.damaged
            yield bad("damaged gzip")
        if line is None:
            return
        if not line.startswith(b"WARC/"):
            yield bad(f"not a record: {line[:40].decode('utf-8', 'replace').strip()}")
            lost = True
            continue
        lost, head = False, {}
        while (line := stream.line()) is not None and line.strip() and not line.startswith(b"WARC/"):
            key, _, value = line.decode("utf-8", "replace").partition(":")
            head[key.strip().lower()] = value.strip()
        if line is None:
            yield bad("truncated: a header at the end of the file")
            return
        size = head.get("content-length", "")
        if not size.isascii() or not size.isdigit():
            yield bad(f"bad length: {size[:40]}")
            lost = not line.startswith(b"WARC/")
            continue
        if line.startswith(b"WARC/"):
            yield bad("not a record: its header has no end")
            continue
        line = None
        left, running, number, start = int(size), hashlib.sha256(), 0, 0
        names = head.get("warc-record-id", "").strip("<>"), head.get("warc-type"), head.get("warc-target-uri")
        while True:
            part = stream.take(min(chunk_bytes, left))
            left -= len(part)
            running.update(part)
            cut_off = not part and left
            yield (*names, number, start, len(part), not left, hashlib.sha256(part).hexdigest(), running.hexdigest(), part, "truncated" if cut_off else None)
            if cut_off or not left:
                break
            number, start = number + 1, start + len(part)


def read_warc(spark: SparkSession, paths: list[str], chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Chunk table of archive files; any file system that pyarrow can name by URI. Files are the unit of parallelism."""
    schema = _arrow(("record_id", pa.string()), ("warc_type", pa.string()), ("target_uri", pa.string()), *_TAIL, ("error", pa.string()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        out = _Rows(schema)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
                with system.open_input_stream(at, compression=None) as source:
                    for row in warc_chunks(ByteStream(source.read), chunk_bytes):
                        yield from out.add(*row)
        yield out.batch()

    files = spark.createDataFrame([(p,) for p in paths], "path string")
    return files.repartition(max(1, len(paths)), "path").mapInArrow(read, WARC_SCHEMA)


def warc_record(record_id: str, url: str, payload: bytes, kind: str = "response") -> bytes:
    """One record in WARC/1.1 framing (for exports and tests)."""
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{record_id}>\r\nWARC-Target-URI: {url}\r\nContent-Length: {len(payload)}\r\n\r\n"
    return head.encode() + payload + b"\r\n\r\n"


def broken_records(chunks: DataFrame) -> DataFrame:
    """Records whose chunks aren't complete, contiguous and digested right (built-in functions only)."""
    good = (F.sha2("payload", 256) == F.col("chunk_digest")) & (F.length("payload") == F.col("n_bytes"))
    per = chunks.filter("payload IS NOT NULL").groupBy("record_id").agg(
        F.countDistinct("chunk_no").alias("n"), (F.max("chunk_no") + 1).alias("up"), F.bool_or("is_last").alias("ended"), F.bool_and(good).alias("good")
    )
    return per.filter("n <> up OR NOT ended OR NOT good").select("record_id")
