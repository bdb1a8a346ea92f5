"""Balanced parentheses and the conversation trie against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from transitreach.llm import dialogue_trie
from transitreach.llm.parentheses import Parentheses


@pytest.mark.parametrize("n, wide", [(1, 1), (5, 2), (700, 1), (900, 3), (3000, 40)])
def test_find_close(n, wide):
    rng = random.Random(n)
    bits, open_, left = [1], 1, n - 1
    while open_:
        if left and (open_ == 1 or rng.randrange(wide + 1)):
            bits.append(1)
            open_, left = open_ + 1, left - 1
        elif open_ > 1 or not left:
            bits.append(0)
            open_ -= 1
    tree, stack, want = Parentheses(np.array(bits)), [], {}
    for i, b in enumerate(bits):
        if b:
            stack.append(i)
        else:
            want[stack.pop()] = i
    assert {i: tree.find_close(i) for i in want} == want
    for i, j in want.items():
        inside = bits[i:j + 1]
        first, after, leaves = tree.subtree(i)
        assert after - first == sum(inside) and first == sum(bits[:i])
        assert leaves == sum(a == 1 and b == 0 for a, b in zip(inside, inside[1:]))


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, digest, (role, text)))
    own = {c: [t[3] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    children, saved, leaves = defaultdict(int), defaultdict(int), defaultdict(int)
    for k in members:
        if k:
            children[k[:-1]] += 1
    for k, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * words
            leaves[k[:d]] += not children[k]
    out = []
    for k, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(k))))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def talk(seed, n, words, most):
    rng = random.Random(seed)
    rows = []
    for c in range(-30, n):
        if c % 7 == 3:
            continue
        for t in range(rng.randrange(1, most)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", " ".join(rng.choices(words, k=rng.randrange(0, 3)))))
    return rows


def odd():
    copies = [(c, t, "user", f"hello {t} there") for c in range(200, 240) for t in range(6)]
    long = [(c, t, "user", f"line {t}") for c in (301, 302) for t in range(300)]
    return copies + long + [(400, None, None, None), (400, 0, "user", ""), (400, 0, "a", "x"), (400, 0, "a", "x"), (None, 1, "u", "t"),
                            (401, 1, None, " \n"), (402, 1, "é", "日 本\x85z"), (403, 5, "a:b", "c"), (404, 5, "a", ":bc")]


SCHEMA = "conv_id bigint, turn bigint, role string, text string, c bigint, d int, path string, part int, x1 string"


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(*r, 1, 2, "p", 3, "x") for r in rows], SCHEMA).repartition(parts)


@pytest.mark.parametrize("shard", [dialogue_trie.SHARD_NODES, 12])
@pytest.mark.parametrize("rows", [talk(1, 90, ["a", "b c"], 7), talk(2, 150, ["yes"], 4) + odd()], ids=["mixed", "odd"])
def test_trie(spark, rows, shard):
    got = dialogue_trie.trie(frame(spark, rows), shard_nodes=shard).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_joins_and_lists_beyond_their_bounds(spark, monkeypatch):
    monkeypatch.setattr(dialogue_trie, "MOST_BROADCAST", 0)
    monkeypatch.setattr(dialogue_trie, "PIECE_IDS", 3)
    rows = talk(3, 60, ["a", "b"], 5) + odd()
    got = dialogue_trie.trie(frame(spark, rows), shard_nodes=30).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_several_shards_share_spines(spark):
    rows = talk(5, 400, ["a", "b"], 8)
    _, turns = dialogue_trie.rebuilt(frame(spark, rows))
    everyone = turns.select("c").distinct()
    found = dialogue_trie.nodes(everyone, turns)
    shards = dialogue_trie.shard_paths(turns, found, 20).collect()
    assert len({r["part"] for r in shards}) > 3 and sum(r["spine"] for r in shards) == len({r["part"] for r in shards}) - 1


def test_empty_tables(spark):
    assert dialogue_trie.trie(frame(spark, [])).count() == 0
    assert dialogue_trie.trie(frame(spark, [(None, 1, "u", "t")])).count() == 0
