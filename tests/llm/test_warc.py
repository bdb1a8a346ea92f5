"""WARC round trips: segments, framing, separators in payloads, broken archives."""

import gzip
import hashlib
import random

import pytest

from transitreach.llm import warc

SCHEMA = "page_id bigint, url string, html string, digest string, type string, block int, record string"


def rows():
    rng = random.Random(9)
    long = "".join(rng.choice("abc é日\r\n") for _ in range(9000))
    sep = "x\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    pages = [(1, "http://a/1", long), (2, "http://a/2", long), (3, None, None), (4, "u", ""), (5, "u\r\nX: 1", "a" * 99),
             (6, "u", "a" * 99), (7, "u", "a" * 100), (0, "u", "a" * 100), (8, "u", sep * 40), (9, "u", sep * 40 + "\r\n"),
             (10, "u", "\r\n\r\n"), (11, "u", "é\r\n\r"), (12, "u", "\r\n" * 500), (None, "n", long), (None, "n", "q" * 300),
             (None, "m", "q" * 300), (13, "u", "r" * 5000), (13, "u", "r" * 5000), (14, "u", "r" * 5000), (15, "u", "0\r\n\r\n" * 90),
             (16, "u", "s" * 4000), (17, "u", "s" * 4001), (18, "u", "<p>ŝ\x00\x1f</p>" * 30)]
    return [(i, u, h, "d", "t", 1, "r") for i, u, h in pages]


def expected(pages):
    first = {}
    for i, _, h, *_ in pages:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h, *_ in pages:
        p = (h or "").encode()
        again = len(p) >= 100 and first.get(h or "") not in (None, i)
        out.append((str(i), len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response",
                    first[h or ""] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("segment, files", [(300, 3), (warc.SEGMENT_BYTES, warc.RECORDS_A_FILE)])
def test_round_trip(spark, tmp_path, segment, files):
    pages = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    path = str(tmp_path / "warc")
    got = warc.page_captures(pages, path, segment_bytes=segment, records_a_file=files).collect()
    assert sorted(((str(r["page_id"]), *r[1:]) for r in got), key=str) == expected(rows())
    whole = warc.read_archive(spark, path).collect()
    assert {r["problem"] for r in whole} == {""}
    texts = {(r["page_id"], (r["payload"] or b"").decode()) for r in whole if r["record_type"] == "response"}
    assert texts == {(i, h or "") for i, _, h, *_ in rows() if (i, h) not in [
        (2, rows()[0][2]), (7, "a" * 100), (None, rows()[0][2]), (14, "r" * 5000)]}
    if segment == 300:
        assert max(r["n_segments"] for r in whole) > 30
        assert len(list((tmp_path / "warc").glob("part-*"))) > 10      # segments of a record in several files


def test_join_beyond_the_broadcast_bound(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "MOST_BROADCAST", 0)
    pages = [(i, "u", f"{'ab' if i % 3 else i % 8}" * 80, "d", "t", 1, "r") for i in range(60)]
    got = warc.page_captures(spark.createDataFrame(pages, SCHEMA), str(tmp_path / "w")).collect()
    assert sorted(((str(r["page_id"]), *r[1:]) for r in got), key=str) == expected(pages)


def test_foreign_and_broken_archives(spark, tmp_path):
    """Chunk extensions and trailers, no framing, lost segments, wrong lengths, cut-off files: defined rows."""
    def record(fields, block):
        return "\r\n".join(["WARC/1.0", *fields, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    def response(i, body, *fields, chunked=True):
        head = b"HTTP/1.1 200 OK\r\n" + (b"transfer-encoding: Chunked\r\n" if chunked else b"Server: x\r\n") + b"\r\n"
        return record(["WARC-Type: response", f"WARC-Record-ID: <r{i}>", f"X-Page-ID: {i}", *fields], head + body)

    good = b"4;name=v\r\nWiki\r\nA\r\n0123456789\r\n0\r\nExpires: never\r\n\r\n"
    files = [record(["WARC-Type: warcinfo"], b"") + response(1, good) + response(2, b"plain\r\n\r\nbody", chunked=False),
             b"noise\r\n\r\n" + response(3, b"9\r\nab\r\n0\r\n\r\n") + response(4, b"zz\r\nab\r\n0\r\n\r\n") + response(5, b"2\r\nab\r\n0\r\n"),
             response(6, b"4\r\nab", "WARC-Segment-Number: 1") + record(
                 ["WARC-Type: continuation", "WARC-Segment-Origin-ID: <r6>", "WARC-Segment-Number: 3",
                  "WARC-Segment-Total-Length: 10"], b"cd\r\n0\r\n\r\n"),
             response(7, b"4\r\nab", "WARC-Segment-Number: 1") + record(
                 ["WARC-Type: continuation", "WARC-Segment-Origin-ID: <r7>", "WARC-Segment-Number: 2",
                  "WARC-Segment-Total-Length: 999"], b"cd\r\n0\r\n\r\n"),
             response(8, good, "WARC-Payload-Digest: sha256:00") + response(9, b"2\r\nab\r\n0\r\n\r\n")[:-12]]
    (tmp_path / "in").mkdir()
    for k, data in enumerate(files):
        (tmp_path / "in" / f"{k}.warc.gz").write_bytes(gzip.compress(data[:40]) + gzip.compress(data[40:]))   # two members
    got = {r["page_id"]: r for r in warc.read_archive(spark, str(tmp_path / "in")).collect()}
    assert got[1]["payload"] == b"Wiki0123456789" and got[2]["payload"] == b"plain\r\n\r\nbody"
    assert {i: got[i]["problem"] for i in range(1, 10)} == {
        1: "", 2: "", 3: "chunk length", 4: "chunk size", 5: "chunk end", 6: "segments missing", 7: "total length",
        8: "digest", 9: "cut off"}


def test_empty_table(spark, tmp_path):
    assert warc.page_captures(spark.createDataFrame([], SCHEMA), str(tmp_path / "w")).count() == 0
