"""Exact and near deduplication against brute force."""

import hashlib
import re
from collections import defaultdict

import pytest

from transitreach.llm import exact_dedup, near_dedup, shingles
from transitreach.llm.components import components

from .conftest import odd_rows


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


@pytest.mark.parametrize("support", [0.001, 0.08])      # all shuffled; the large groups map-side
def test_exact_groups(odd, support):
    groups = defaultdict(list)
    for i, t, *_ in odd_rows():
        groups[norm(t)].append((-len(t or ""), i is None, i or 0, i))
    want = sorted(((str(i), str(min(g)[3]), len(g), i == min(g)[3], hashlib.sha256(n.encode()).hexdigest())
                   for n, g in groups.items() for *_, i in g))
    got = sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"], r["text_sha256"])
                 for r in exact_dedup.exact_groups(odd, support).collect())
    assert got == want


@pytest.mark.parametrize("support", [0.001, 0.08])
def test_exact_dedup_keeps_one_row_of_each_text_with_all_columns(odd, support):
    out = exact_dedup.exact_dedup(odd, support)
    assert out.columns == odd.columns
    rows = out.collect()
    assert len(rows) == len({norm(t) for _, t, *_ in odd_rows()}) == len({norm(r["text"]) for r in rows})
    assert {r["doc_id"] for r in rows} >= {12, 4, 7, 8, 11}


def brute_components(rows, width, threshold):
    sets = []
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= threshold * len(sets[a] | sets[b]) and label[a] != label[b]:
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    least = {}
    for (i, *_), x in zip(rows, label):
        if i is not None:
            least[x] = min(least.get(x, i), i)
    return [(str(i), len(s), str(least.get(x) if s else i)) for (i, *_), s, x in zip(rows, sets, label)]


@pytest.mark.parametrize("width", [2, 5])
def test_near_groups(odd, width):
    got = near_dedup.near_groups(odd, width=width).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == sorted(
        brute_components(odd_rows(), width, 80))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_dedup_keeps_one_document_of_each_component(odd):
    out = near_dedup.near_dedup(odd)
    assert out.columns == odd.columns
    ids = sorted(r["doc_id"] for r in out.collect() if r["doc_id"] is not None)
    want = {int(c) for i, n, c in brute_components(odd_rows(), 5, 80) if i != "None"}
    assert ids == sorted(want)


def test_large_family_is_compared_completely(spark):
    """A family whose links run in chains, larger than a block, with members that link to few others."""
    import random
    rng = random.Random(3)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(300):
        own = list(base)
        for k in rng.sample(range(60), rng.randrange(0, 9)):
            own[k] = f"x{i}_{k}"
        rows.append((i, " ".join(own)))
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), width=2)
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got.collect()) == sorted(
        brute_components(rows, 2, 80))


def unlike(seed, n=60):
    import random
    rng = random.Random(seed)
    return [f"t{seed}w{rng.randrange(10**6)}" for _ in range(n)]


def test_repeated_ids_stand_for_their_texts(spark):
    a, b, c = (unlike(k) for k in range(3))
    rows = [(1, a), (2, a + ["x"]), (2, b), (3, c), (3, b + ["y"]), (4, c + ["z"]), (4, c + ["z"]), (5, []), (5, []), (5, a[::-1]),
            (None, b), (7, unlike(9)), (7, unlike(9) + ["q"])]
    docs = spark.createDataFrame([(i, " ".join(w), "x", 1) for i, w in rows], "doc_id bigint, text string, label string, s1 int")
    got = near_dedup.near_groups(docs, width=2).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == sorted(
        brute_components([(i, " ".join(w)) for i, w in rows], 2, 80))
    out = near_dedup.near_dedup(docs)
    assert out.columns == docs.columns
    kept = sorted((str(r["doc_id"]), r["text"].split()[:1]) for r in out.collect())
    assert kept == sorted([("1", a[:1]), ("2", b[:1]), ("3", c[:1]), ("5", []), ("5", []), ("5", a[-1:]), ("None", b[:1]),
                           ("7", unlike(9)[:1])])


def test_open_buckets_are_settled_in_linear_rows(spark):
    """Many texts of one passage that do not link, and a group around a base that does: no text meets all others."""
    import random
    rng = random.Random(4)
    passage, base = unlike(1, 50), unlike(2, 80)
    rows = [(i, passage + [f"p{i}x{k}" for k in range(rng.randrange(14, 60))]) for i in range(400)]
    for i in range(400, 800):
        own = list(base)
        for k in rng.sample(range(80), rng.randrange(1, 8)):
            own[k] = f"b{i}x{k}"
        rows.append((i, own))
    rows = [(i, " ".join(w)) for i, w in rows]
    links = near_dedup._Links(spark.createDataFrame(rows, "doc_id bigint, text string"), 2, 80)
    links.leader_round(0)
    before = links._open(links.labels).select("rep").distinct().count()
    gone, apart = links.settle()
    assert gone > 350 and apart.count() == before - gone
    links.leader_round(1, apart)
    links.close_families()
    dealt = [x for side in links._dealt(links._open(links.labels).join(
        links.planes.select("id", "n_shingles"), links.buckets["rep"] == links.planes["id"]), near_dedup.BLOCK) for x in side.collect()]
    assert len(dealt) <= 4 * links.buckets.count()
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), width=2).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == sorted(brute_components(rows, 2, 80))


def test_rows_of_buckets_pass_one_join_by_class(spark, monkeypatch):
    """Shares and sizes come with the labels, and rows are dealt from a written table, not made anew for each use."""
    import random
    rng = random.Random(6)
    passage = unlike(3, 50)
    rows = [(i, " ".join(passage + [f"p{i}x{k}" for k in range(rng.randrange(4, 30))])) for i in range(60)]
    links = near_dedup._Links(spark.createDataFrame(rows, "doc_id bigint, text string"), 2, 80)
    opened, dealt, write, deal = [], [], near_dedup.materialise, near_dedup._Links._dealt

    def written(session, df, name, files=None):
        if name.startswith("near_open"):
            opened.append(df)
        return write(session, df, name, files)

    def spied(self, table, block):
        dealt.append(table)
        return deal(self, table, block)

    monkeypatch.setattr(near_dedup, "materialise", written)
    monkeypatch.setattr(near_dedup._Links, "_dealt", spied)
    links.leader_round(0)
    _, apart = links.settle()
    links.leader_round(1, apart)
    links.close_families()
    assert len(opened) >= 3 and {"share"} == {c for x in opened[:2] for c in x.columns} - {"key", "rep", "label", "size"}
    assert dealt and all("Join" not in x._jdf.queryExecution().optimizedPlan().toString() for x in dealt)
    assert all("n_shingles" in x.columns for x in opened[2:])


def test_estimate_is_collision_corrected():
    import numpy as np
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 63, 4000, dtype=np.uint64))
    b = np.concatenate((a[:2000], np.unique(rng.integers(0, 1 << 63, 2000, dtype=np.uint64))))
    planes = shingles.bit_planes(shingles.minima([a, np.unique(b)], near_dedup.HASHES), near_dedup.BITS).view("u8")
    words = near_dedup.HASHES // 64
    differ = sum(int(np.bitwise_count(np.bitwise_or.reduce((planes[0] ^ planes[1])[w::words]))) for w in range(words))
    c = 2.0 ** -near_dedup.BITS
    assert abs(((near_dedup.HASHES - differ) / near_dedup.HASHES - c) / (1 - c) - 1 / 3) < 0.15
    assert 60 < near_dedup.least_agreeing(0.8) < 100


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 100 + k) for k in range(1, 50)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{100 + k: 100 for k in range(50)}}


def test_empty_tables(none):
    assert exact_dedup.exact_groups(none).count() == 0 and exact_dedup.exact_dedup(none).count() == 0
    assert near_dedup.near_groups(none).count() == 0 and near_dedup.near_dedup(none).count() == 0
