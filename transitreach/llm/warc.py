"""WARC archives: pages written as records, and records read back by reassembling segments.

Writing.  Every page becomes one logical record: an HTTP response with chunked transfer
framing, or a ``revisit`` where an earlier page has the same payload.  A message longer than
``SEGMENT_BYTES`` is cut into segments, as WARC does for records that do not fit a file: the
first is the record itself with ``WARC-Segment-Number: 1``, the others are ``continuation``
records that name the first one in ``WARC-Segment-Origin-ID``; the last one states the total
length.  Rows are written by Spark's text sink with the record separator (two line ends) as its
line separator, compressed, at most ``RECORDS_A_FILE`` records a file, so files have a bounded
size, no shuffle is needed, and a long record's segments may lie in several files.

Reading.  Spark's text source streams each file in pieces between record separators; a task
joins pieces until a record has the ``Content-Length`` it states, so a payload may hold
separators or whole records.  No file and no archive is held in memory, only the record at
hand.  Continuations are grouped by their origin, ordered by segment number, checked against
the stated total length and joined to the first segment; only segmented records are shuffled.
Chunked framing (with extensions and trailers) is decoded, and the payload is checked against
the stated digest.

A page's record is a response if its payload has fewer than ``least`` bytes or its page_id is
the smallest of those with that payload; else it is a revisit and refers to that smallest one.

Edge cases: a NULL html is an empty payload.  A NULL page_id counts as larger than every other
and is never referred to; pages without one are responses unless a page with one has their
payload.  Rows that repeat the smallest page_id with the same payload are all responses (one
capture, stored twice).  A NULL url has no target URI; control characters in it are
percent-encoded.  Records that are cut off, lack segments, miss their stated length or digest,
or break the chunk framing are returned with what could be read and a ``problem``; nothing is
raised for them.  An empty table gives an empty archive and an empty result.  Extra columns of
the pages, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_unique, materialise

SEGMENT_BYTES = 32 * 1024        # of a message in one record
CHUNK_BYTES = 8 * 1024           # of a payload in one transfer chunk
RECORDS_A_FILE = 4096            # so a file has at most 128 MB of blocks
LEAST_REVISIT = 100              # bytes from which equal payloads are stored once
MOST_BROADCAST = 500_000         # repeated payloads: a digest and an id each
EMIT_BYTES = 4_000_000           # of records in one Arrow batch

# ---- Fixed values: names and values of the WARC 1.1 and HTTP/1.1 formats ----
VERSION = b"WARC/1.1"
SEPARATOR = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"

_END = SEPARATOR.encode()
_RECORD = ("type string, record_id string, origin string, number bigint, total bigint, url string, page_id bigint, "
           "refers_to bigint, digest string, length bigint, block binary, problem string")
_MESSAGE = ("page_id bigint, url string, record_type string, record_id string, refers_to bigint, "
            "payload_bytes bigint, payload_digest string, n_segments bigint, payload binary, problem string")


# ---------------------------------------------------------------- writing
def record_id(page_id: int | None, digest: str) -> str:
    h = hashlib.sha256(f"{page_id}:{digest}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:32]}>"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """``payload`` in chunked transfer framing."""
    parts = []
    for at in range(0, len(payload), size):
        piece = payload[at:at + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [f"{name}: {value}".encode() for name, value in fields if value is not None]
    return b"\r\n".join([VERSION, *lines, b"Content-Length: %d" % len(block)]) + _END + block


def _address(url: str | None) -> str | None:
    return None if url is None else "".join(c if c > "\x1f" and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def page_records(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, date: str,
                 segment_bytes: int) -> Iterator[bytes]:
    """The records of one page; ``first`` is the page whose payload it repeats, or None."""
    own = record_id(page_id, digest)
    shared = [("WARC-Date", date), ("WARC-Target-URI", _address(url)), ("X-Page-ID", page_id),
              ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if first is not None:
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *shared, ("WARC-Profile", PROFILE),
                       ("WARC-Refers-To", record_id(first, digest)), ("X-Refers-To-Page", first),
                       ("X-Payload-Length", len(payload))], HTTP_HEAD)
        return
    message = HTTP_HEAD + chunked(payload)
    last = max(1, -(-len(message) // segment_bytes))
    yield _record([("WARC-Type", "response"), ("WARC-Record-ID", own), *shared,
                   ("WARC-Segment-Number", 1 if last > 1 else None)], message[:segment_bytes])
    for n in range(2, last + 1):
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(n, own)), ("WARC-Date", date),
                       ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", n),
                       ("WARC-Segment-Total-Length", len(message) if n == last else None)],
                      message[(n - 1) * segment_bytes:n * segment_bytes])


def repeated_payloads(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``digest, first, n``: payloads that several rows have, with the smallest page_id."""
    keyed = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("html").alias("html"))
    keyed = (keyed.where(F.octet_length("html") >= least)
             .select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("digest")))
    return keyed.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where(
        "n > 1 AND first IS NOT NULL")


def write_archive(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", least: int = LEAST_REVISIT,
                  segment_bytes: int = SEGMENT_BYTES, records_a_file: int = RECORDS_A_FILE) -> None:
    """Write the pages (``page_id, url, html``) as WARC files to the folder ``path``."""
    spark = pages.sparkSession
    repeated = materialise(spark, repeated_payloads(pages, least), "warc_repeated")
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b"").cast("binary"))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                        payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    rows = join_unique(rows, repeated, "digest", "n", pages.count(), MOST_BROADCAST)
    rows = rows.select("page_id", "url", "payload", "digest", F.when(
        ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("first"))

    def run(batches):
        for batch in batches:
            held, size = [], 0
            # the payload column stays in Arrow; one page's bytes are taken out at a time
            for i in range(batch.num_rows):
                page_id, url, payload, digest, first = (batch.column(k)[i].as_py() for k in range(5))
                for record in page_records(page_id, url, payload, digest, first, date, segment_bytes):
                    held.append(record)
                    size += len(record)
                    if size >= EMIT_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["record"])
                        held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["record"])

    (rows.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value")).write
     .option("lineSep", SEPARATOR).option("compression", "gzip").option("maxRecordsPerFile", records_a_file)
     .text(path))


# ---------------------------------------------------------------- reading
class _Records:
    """Records out of the pieces of one file between separators."""

    def __init__(self):
        self.fields: dict[str, str] | None = None
        self.parts: list[bytes] = []
        self.have = self.want = 0

    def add(self, piece: bytes) -> Iterator[tuple]:
        while piece is not None:
            if self.fields is None:
                piece = piece.lstrip(b"\r\n")
                if piece:
                    self._open(piece)
                return
            self.parts.append(piece)
            self.have += len(piece)
            if self.have < self.want:
                self.parts.append(_END)          # the separator belonged to the block
                self.have += len(_END)
                if self.have <= self.want:
                    return
            data = b"".join(self.parts)
            # what a block's own end and the separator share shows as the start of the next piece
            rest = data[self.want:]
            yield self._close(data[:self.want], "")
            piece = rest[len(_END):] if len(rest) > len(_END) else None

    def end(self) -> Iterator[tuple]:
        if self.fields is not None:
            data = b"".join(self.parts)
            yield self._close(data[:self.want], "" if len(data) >= self.want else "cut off")

    def _open(self, head: bytes) -> None:
        lines = head.decode("utf-8", "replace").split("\r\n")
        fields = {}
        for line in lines[1:]:
            name, colon, value = line.partition(":")
            if colon:
                fields[name.strip().lower()] = value.strip()
        length = fields.get("content-length", "")
        if not lines[0].startswith("WARC/") or not length.isdecimal():
            return                                # not a record: skipped up to the next piece that is
        self.fields, self.parts, self.have, self.want = fields, [], 0, int(length)

    def _close(self, block: bytes, problem: str) -> tuple:
        f, self.fields, self.parts, self.have = self.fields, None, [], 0

        def number(name):
            value = f.get(name, "")
            return int(value) if value.lstrip("-").isdecimal() else None

        digest = f.get("warc-payload-digest", "")
        return (f.get("warc-type"), f.get("warc-record-id"), f.get("warc-segment-origin-id"),
                number("warc-segment-number"), number("warc-segment-total-length"), f.get("warc-target-uri"),
                number("x-page-id"), number("x-refers-to-page"), digest.removeprefix("sha256:") or None,
                number("x-payload-length"), block, problem)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    columns = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(values), kinds[kind]) for values, (_, kind) in zip(
        zip(*rows), columns)], names=[name for name, _ in columns])


def _emitted(rows: Iterator[tuple], schema: str, heavy: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``EMIT_BYTES``; ``heavy`` is the place of the binary column."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[heavy] or b"") + 200
        if size >= EMIT_BYTES:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of the WARC files in ``path``, one row each; a file is read by one task, as a stream."""
    def records(batches):
        file, state = None, _Records()
        for batch in batches:
            pieces, files = batch.column(0), batch.column(1).to_pylist()
            for i, name in enumerate(files):
                if name != file:
                    yield from state.end()
                    file, state = name, _Records()
                yield from state.add(pieces[i].as_py())
        yield from state.end()

    def run(batches):
        yield from _emitted(records(batches), _RECORD, 10)

    # a compressed file is never split, so its pieces come in order
    pieces = spark.read.option("lineSep", SEPARATOR).text(path).select(
        F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"))
    return pieces.mapInArrow(run, _RECORD)


def dechunked(body: bytes) -> tuple[bytes, str]:
    """The payload of a chunked body, and what is wrong with its framing (or '')."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        try:
            n = int(size, 16) if size.isalnum() else -1
        except ValueError:
            n = -1
        if n < 0:
            return b"".join(parts), "chunk size"
        at = end + 2
        if n == 0:
            break
        parts.append(body[at:at + n])
        if len(parts[-1]) < n or body[at + n:at + n + 2] != b"\r\n":
            return b"".join(parts), "chunk length"
        at += n + 2
    while (end := body.find(b"\r\n", at)) > at:            # trailers
        at = end + 2
    return b"".join(parts), "" if end == at else "chunk end"


def payload_of(message: bytes) -> tuple[bytes, str]:
    """The payload of an HTTP message with its transfer framing taken off."""
    head, end, body = message.partition(_END)
    if not end:
        return b"", "no HTTP head"
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"transfer-encoding" and b"chunked" in value.lower():
            return dechunked(body)
    return body, ""


def reassemble(records: DataFrame) -> DataFrame:
    """Records with their continuations: ``tail`` (blocks in order) and the stated ``total``.

    Continuations are dealt by origin once; of segments that stand several times (the
    same capture stored twice) one is taken.
    """
    parts = (records.where("type = 'continuation'").select("origin", "number", "total", "block", "problem")
             .repartition("origin")
             .groupBy("origin", "number").agg(F.min(F.struct("problem", "total", "block")).alias("s"))
             .groupBy("origin").agg(F.sort_array(F.collect_list(F.struct("number", "s"))).alias("tail"))
             .select(F.col("origin").alias("record_id"), F.col("tail.number").alias("numbers"),
                     F.col("tail.s.block").alias("tail"), F.array_max("tail.s.total").alias("tail_total"),
                     F.array_max("tail.s.problem").alias("tail_problem")))
    first = records.where("type IS NULL OR type <> 'continuation'")
    nothing = [F.lit(None).cast(kind).alias(name) for name, kind in (
        ("numbers", "array<bigint>"), ("tail", "array<binary>"), ("tail_total", "bigint"), ("tail_problem", "string"))]
    whole = first.where("number IS NULL").select("*", *nothing)
    cut = first.where("number IS NOT NULL").join(parts, "record_id", "left").select(*whole.columns)
    return whole.unionByName(cut)


def read_archive(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The logical records of an archive, one row each.

    ``payload_bytes`` and ``payload_digest`` come from the reassembled, decoded payload; a
    revisit has those it states.  ``problem`` is empty for a record that is whole.
    """
    columns = ["type", "record_id", "url", "page_id", "refers_to", "digest", "length", "block", "problem",
               "number", "numbers", "tail", "tail_total", "tail_problem"]
    # records are written once: the archive is parsed once, and both kinds read from that
    records = materialise(spark, read_records(spark, path), "warc_records")
    # a record that is read whole can have a long tail: few rows at a time
    rows = reassemble(records).select(*columns)

    def messages(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                (kind, own, url, page_id, refers_to, digest, length, block, problem, number, numbers, tail, total,
                 tail_problem) = (batch.column(k)[i].as_py() for k in range(len(columns)))
                if kind == "revisit":
                    yield page_id, url, kind, own, refers_to, length, digest, 1, None, problem
                    continue
                message = block if not tail else b"".join([block, *tail])
                if number is not None and not problem:
                    problem = tail_problem or ""
                    if numbers != list(range(2, 2 + len(numbers or []))) or total is None:
                        problem = problem or "segments missing"
                    elif total != len(message):
                        problem = problem or "total length"
                payload, wrong = payload_of(message)
                found = hashlib.sha256(payload).hexdigest()
                problem = problem or wrong or ("" if digest in (None, found) else "digest")
                yield (page_id, url, kind, own, None, len(payload), found, 1 + len(tail or []),
                       payload if with_payload else None, problem)

    def run(batches):
        yield from _emitted(messages(batches), _MESSAGE, 8)

    return rows.mapInArrow(run, _MESSAGE)


def page_captures(pages: DataFrame, path: str, **settings) -> DataFrame:
    """Write ``pages`` to ``path`` and read them back: ``page_id, payload_bytes, payload_digest, record_type, refers_to``."""
    write_archive(pages, path, **settings)
    return read_archive(pages.sparkSession, path, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# The contract's query in DuckDB SQL.
ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(COALESCE(html, ''))) AS payload_bytes, sha256(COALESCE(html, '')) AS payload_digest
  FROM pages
), f AS (
  SELECT *, MIN(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
), r AS (
  SELECT *, payload_bytes >= 100 AND first IS NOT NULL AND page_id IS DISTINCT FROM first AS again FROM f
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first END AS refers_to
FROM r
"""
