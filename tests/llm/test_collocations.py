"""Counting quotient filters and collocations against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from transitreach.llm import collocations, quotient


@pytest.mark.parametrize("n, bits", [(2, 1), (2, 9), (3, 5), (4, 16), (4, 21), (4, 31), (3, 31)])
def test_filters_are_lossless(n, bits):
    rng = np.random.default_rng(n * bits)
    wide, low = quotient.halves(n, bits)
    hi, lo = (rng.integers(0, 1 << w, 3000, dtype=np.uint64) for w in (wide, low))
    a, b = quotient.permute(hi, lo, wide, low)
    assert [x.tolist() for x in quotient.restore(a, b, wide, low)] == [hi.tolist(), lo.tolist()]
    assert len(set(zip(a.tolist(), b.tolist()))) == len(set(zip(hi.tolist(), lo.tolist())))
    counts = rng.integers(1, 700, len(hi)) ** rng.integers(1, 6, len(hi))
    want = Counter()
    for x, y, c in zip(a.tolist(), b.tolist(), counts.tolist()):
        want[x, y] += c
    for prefix in (0, 3):
        found = quotient.counted(a, b, wide, low, counts)
        blocks = dict(quotient.filters(*found, wide, low, prefix))
        got = {}
        for data in blocks.values():
            got |= {(x, y): c for x, y, c in zip(*(v.tolist() for v in quotient.decode(data)))}
        assert got == dict(want)
        twice = quotient.merged(list(blocks.values()) * 2, wide, low)
        assert {(x, y): c for x, y, c in zip(*(v.tolist() for v in twice))} == {k: 2 * c for k, c in want.items()}
    assert quotient.decode(quotient.encode(hi[:0], lo[:0], counts[:0], wide, low, 0, 0))[0].tolist() == []


def brute(rows, least=30, top=2000):
    grams, total = {}, Counter()
    for text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            grams.setdefault(lang or "und", Counter()).update(
                tuple(w[i:i + m]) for m in (1, 2, 3, 4) for i in range(len(w) - m + 1))
    out = []
    for lang, f in grams.items():
        cand = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        gone = {g[s:s + m] for g, a in cand.items() for m in range(2, len(g)) for s in range(len(g) - m + 1)
                if 100 * a >= 80 * f[g[s:s + m]]}
        rows_ = []
        for g, a in cand.items():
            if g not in gone:
                score, _, l, r = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
                rows_.append((-score, -a, " ".join(g).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows_)[:top])]
    return sorted(out)


def texts(seed, n=300):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(40)] + ["É", "ß日", "New", "york", "ÿ\x00z", "a\x1cb", "x\x85"]
    weights = [1 / (k + 1) for k in range(len(vocab))]
    out = []
    for i in range(n):
        words = rng.choices(vocab, weights, k=rng.randrange(0, 60))
        if i % 3 == 0:
            words += ["New", "York", "city", "hall"] * rng.randrange(1, 3)
        text = "".join(w + rng.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "\x0b", " ! "]) for w in words)
        out.append((text, rng.choice(["en", "en", "en", None, "und", "fr"])))
    return out + [(None, "en"), ("", None), ("the " * 500, "en"), ("rare pair " * 3, "xx")]


SCHEMA = "text string, lang string, id bigint, word string, ids string, n int, f int, chunk int"


def frame(spark, rows):
    return spark.createDataFrame([(t, g, 1, "w", "i", 2, 3, 4) for t, g in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("top", [2000, 7])
def test_collocations(spark, top):
    rows = texts(1)
    got = collocations.collocations(frame(spark, rows), least=8, top=top).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 8, top)
    assert len(got) > (60 if top == 2000 else 10)


def test_small_chunks_slices_and_merge_rounds(spark, monkeypatch):
    """Many chunks and filters, merged in several rounds of narrower blocks, joins without broadcast."""
    for name, value in (("CHUNK_BYTES", 300), ("SLICE_BYTES", 40), ("FLUSH", 50), ("BLOCK", 1 << 20), ("GROUP", 200), ("STEP", 2),
                        ("MOST_BROADCAST", 0)):
        monkeypatch.setattr(collocations, name, value)
    monkeypatch.setattr(collocations.frequent, "__defaults__", (200, 2))
    rows = texts(2, 120)
    got = collocations.collocations(frame(spark, rows), least=6).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 6)


def test_empty_tables(spark):
    assert collocations.collocations(frame(spark, [])).count() == 0
    assert collocations.collocations(frame(spark, [(None, None), ("one two", "en")])).count() == 0
