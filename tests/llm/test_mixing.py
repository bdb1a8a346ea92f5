"""Poisson replication against a plain computation of the same draws."""

import hashlib
import math
from collections import Counter

from transitreach.llm import mixing

from .conftest import odd_rows


def poisson(rate, u):
    k, log, cdf = 0, -rate, math.exp(-rate)
    while cdf <= u:
        k += 1
        log += math.log(rate) - math.log(k)
        cdf += math.exp(log)
    return k


def draw(doc_id):
    h = hashlib.md5(f"{mixing.SEED}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    return (int(h[:13], 16) + 0.5) / 2 ** 52


def brute(rows, weights, total):
    size = Counter()
    for _, t, _, s, *_ in rows:
        size[s] += len(t or "") + 1
    weight = {s: (size[s] ** mixing.TEMPERATURE if weights is None else weights.get(s, 0.0)) for s in size}
    rate = {s: weight[s] / sum(weight.values()) * total * sum(size.values()) / size[s] for s in size}
    return Counter({(i, s): n for (i, s), n in Counter(
        x for i, _, _, s, *_ in rows for x in [(i, s)] * (poisson(rate[s], draw(i)) if rate[s] else 0)).items()})


def test_counts_equal_the_inverted_distribution(odd):
    for weights, total in ((None, 1.0), (None, 900.0), ({"hot": 1.0, "s1": 3.0}, 2.0)):
        out = mixing.mix(odd, weights, total=total)
        assert out.columns == odd.columns
        assert Counter((r["doc_id"], r["source"]) for r in out.select("doc_id", "source").collect()) == brute(
            odd_rows(), weights, total)


def test_order_is_by_place_and_does_not_depend_on_partitions(odd):
    a, b = (sorted(r["shuffle_key"] for r in mixing.mixture_table(odd.repartition(n)).collect()) for n in (1, 5))
    assert a == b
    parts = mixing.mixture_table(odd).select("shuffle_key").rdd.glom().collect()
    assert all([r[0] for r in p] == sorted(r[0] for r in p) for p in parts)


def test_empty_table(none):
    assert mixing.mix(none).count() == 0 and mixing.mixture_table(none).count() == 0
