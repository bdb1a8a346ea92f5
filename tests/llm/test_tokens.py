"""Token files and packing: exact round trips through the tokenizer."""

import os
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from transitreach.llm import packing, tokenfiles
from transitreach.llm.wordcodec import WordCodec

from .conftest import odd_rows

PATH = public_tokenizers.path("word_bpe_49k.json")


def encoded(texts, end):
    tokenizer = Tokenizer.from_file(PATH)
    return [e.ids + [end] for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_codec_equals_the_tokenizer():
    texts = [t or "" for _, t, *_ in odd_rows()] + [
        "A", "don't WON'T 'tis !'re o'clock's", "x<|endoftext|>y <|startoftext|>", "É́ H̱ ẖ İstanbul ΣΑΣ", "a b",
        "naïve²³¼ 12,345.67", "...---!!! a.b.c,d", "\x1c\x1d\x85 x", "日本語", "é ́x", "word̸= ≠", "a" * 500, "ÀÖØÞß÷×"]
    codec = WordCodec(PATH)
    for _ in range(2):                       # new words, then known ones
        flat, lens = codec.encode(texts)
        assert [list(x) for x in np.split(flat, np.cumsum(lens)[:-1])] == [x[:-1] for x in encoded(texts, 0)]
    assert list(codec.encode_long(texts[0] * 3)) == encoded([texts[0] * 3], 0)[0][:-1]


def test_codec_equals_the_tokenizer_on_every_latin_1_character():
    places = ["{}", "a{}", "{}a", "a{}b", "É{}é", "{}1", "1{}", "1{}2", "{}.", ".{}", ".{}!", "a {} b", "{0}{0}", "A{0}{0}1",
              "µ{}º", "ª{}1", "a'{}", "{}'s", "don't{}a", "'{}x", "5 {}m", "n{} 3", "1{}lugar"]
    texts = [p.format(chr(c)) for c in range(256) for p in places]
    flat, lens = WordCodec(PATH).encode(texts)
    got = [list(x) for x in np.split(flat, np.cumsum(lens)[:-1])]
    assert [t for t, g, w in zip(texts, got, encoded(texts, 0)) if g != w[:-1]] == []


def test_token_files_round_trip(spark, odd, none, tmp_path):
    path = str(tmp_path / "tokens")
    tokenfiles.write_tokens(odd, path, PATH)
    got = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"], r["start"])
                  for r in tokenfiles.token_digests(spark, path).collect()), key=lambda r: r[4])
    rows = odd_rows()
    ids = encoded([t or "" for _, t, *_ in rows], 1)
    want = sorted((i is not None, i or 0, len(x), zlib.crc32(np.array(x, dtype="<u4"))) for (i, *_), x in zip(rows, ids))
    assert sorted(g[:4] for g in got) == want
    assert [g[:2] for g in got] == sorted(g[:2] for g in got)                # ascending, NULL first
    assert [g[4] for g in got] == list(np.cumsum([0] + [g[2] for g in got[:-1]]))
    files = [f for f in sorted(os.listdir(path)) if f.endswith(".parquet")]
    meta = [pq.ParquetFile(f"{path}/{f}").metadata for f in files]
    columns = {m.row_group(0).column(c).path_in_schema: m.row_group(0).column(c)
               for m in meta if m.num_row_groups for c in range(m.num_columns)}
    assert "RLE_DICTIONARY" in columns["token_ids.list.element"].encodings
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and columns["doc_id"].has_column_index
    some = tokenfiles.read_tokens(spark, path, 8, 11, ids=False)
    assert sorted(r["doc_id"] for r in some.collect()) == [8, 9, 10, 11]
    assert "GreaterThanOrEqual(doc_id,8)" in some._jdf.queryExecution().toString()
    tokenfiles.write_tokens(none, path + "0", PATH)
    assert tokenfiles.token_digests(spark, path + "0").count() == 0


def test_ties_of_doc_id_have_an_order_and_a_hot_doc_id_is_spread(spark, tmp_path):
    rows = [(i % 5 if i % 3 else None, f"text {i % 97} " * (i % 7)) for i in range(2000)] + [(3, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = []
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")     # small ranges are joined otherwise
    for k, seen in enumerate((docs.repartition(7), docs.orderBy(F.rand(5)))):
        path = str(tmp_path / f"tokens{k}")
        tokenfiles.write_tokens(seen, path, PATH)
        out.append(sorted(map(tuple, tokenfiles.token_digests(spark, path).select("start", "n_tokens", "ids_crc32").collect())))
        assert tokenfiles.read_tokens(spark, path).where("doc_id IS NULL").select("part").distinct().count() > 1
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert out[0] == out[1] and len(out[0]) == len(rows)


def check_packing(rows, ids, tiers=packing.TIERS):
    pieces, sequences, steps = defaultdict(list), defaultdict(list), defaultdict(dict)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        steps[r["step_id"]][r["sequence_id"]] = r["tier"]
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= 4096 and at & (at - 1) == 0              # a power of two: no padding
    assert all(sum(s.values()) <= packing.STEP_TOKENS for s in steps.values())
    assert sum(r["length"] for r in rows) == sum(map(len, ids))


def test_packing_covers_every_id_once(odd, none):
    rows = packing.pack(odd.repartition(2), PATH).collect()
    table = odd_rows()
    ids = encoded([t or "" for _, t, *_ in table], 2)
    check_packing(rows, ids)
    single = {i: x for (i, *_), x in zip(table, ids) if i not in (None, 2)}
    by_doc = defaultdict(list)
    for r in rows:
        if r["doc_id"] in single:
            by_doc[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    assert set(by_doc) == set(single)
    for i, x in single.items():
        at = 0
        for start, length, crc, total in sorted(by_doc[i]):
            assert start == at and total == len(x)
            assert crc == zlib.crc32(np.array(x[start:start + length], dtype="<u4"))
            at += length
        assert at == len(x)
    assert packing.pack(none, PATH).count() == 0


def test_packer_balances_steps():
    packer = packing.Packer(3)
    rng = np.random.default_rng(0)
    total = 0
    for i in range(3000):
        ids = rng.integers(0, 49000, int(rng.integers(1, 6000) if i % 50 else 20000), dtype=np.int32)
        total += len(ids)
        packer.add(i, ids)
    packer.close()
    names = [f.split()[0] for f in packing.SCHEMA.split(", ")]
    rows = [dict(zip(names, r)) for r in packer.rows]
    steps = defaultdict(dict)
    for r in rows:
        steps[r["step_id"]][r["sequence_id"]] = r["tier"]
    assert sum(r["length"] for r in rows) == total
    assert sum(sum(s.values()) != packing.STEP_TOKENS for s in steps.values()) <= 1
    check_packing(rows, [range(total)])
