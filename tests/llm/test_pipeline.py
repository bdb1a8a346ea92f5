"""The pipeline on odd rows and on the smallest table."""

import random
import re
from collections import Counter

import corpus_pipeline
from transitreach.llm import packing, toxicity
from transitreach.llm.queries import QUERIES

from .conftest import SCHEMA, odd_rows, words
from .test_dedup import brute_components, norm
from .test_mixing import brute
from .test_tokens import encoded


def test_every_dealt_operator_is_registered():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES if n.startswith("op")} == set(range(1, 14))
    assert "pipeline" in QUERIES and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_stages_on_odd_rows(spark, odd, sf_small):
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf_small)
        assert docs.columns == odd.columns, name
        docs = spark.createDataFrame(docs.collect(), odd.schema)
        if name == "exact_dedup":
            assert docs.count() == len({norm(r["text"]) for r in before.collect()})
    assert docs.count() and len(odd_rows())


def test_run_on_the_smallest_table(spark, sf_small):
    rows = corpus_pipeline.run(spark, sf_small).collect()
    assert rows and all(r["length"] > 0 for r in rows)


def test_run_equals_brute_force_stage_by_stage(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    rest = ("en", "hot", None, "r", "s", "k", "c", 0.5, 7, "z")
    rows = odd_rows() + [(200 + i, f"{words(rng, 12)} you {rng.choice(['idiot clown', 'stupid moron'])} {words(rng, 9)}", *rest)
                         for i in range(40)] + [(300 + i, words(rng, 25), *rest) for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    marks = spark.createDataFrame([(i, 1, int(i < 300)) for x in (200, 300) for i in range(x, x + 30)],
                                  "doc_id bigint, quality int, toxic int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    marks.write.parquet(str(tmp_path / "labels.parquet"))
    stages, written = [], corpus_pipeline.materialise

    def kept(spark, df, name, *args):
        stages.append((name, written(spark, df, name, *args)))
        return stages[-1][1]

    monkeypatch.setattr(corpus_pipeline, "materialise", kept)
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert [n for n, _ in stages] == [f"pipeline_{n}" for n, _ in corpus_pipeline.STAGES]
    clean, exact, near, mixed, packed = [[tuple(r) for r in df.collect()] for _, df in stages]

    chain = toxicity.fit(docs, marks)
    want = [r for r in rows if chain.probabilities(chain.matrix([r[1] or ""]))[0, -1] < toxicity.REJECT]
    assert Counter(clean) == Counter(want)
    gone = {r[0] for r in rows} - {r[0] for r in want}
    assert gone >= set(range(200, 240)) and not gone & set(range(300, 340))

    groups = {}
    for r in clean:
        groups.setdefault(norm(r[1]), []).append((-len(r[1] or ""), r[0] is None, r[0] or 0, r))
    assert Counter(exact) == Counter(min(g, key=lambda x: x[:3])[3] for g in groups.values())
    assert len(exact) < len(clean)

    component = brute_components(exact, 5, 80)
    assert Counter(near) == Counter(r for r, (i, _, c) in zip(exact, component) if r[0] is None or i == c)
    assert len(near) < len(exact)

    copies = brute(near, None, 1.0)
    assert Counter((r[0], r[3]) for r in mixed) == copies
    assert {r[:2] for r in mixed} <= {r[:2] for r in near}

    tokens, total = Counter(), Counter()
    for r, ids in zip(mixed, encoded([r[1] or "" for r in mixed], 2)):
        tokens[r[0]] += len(ids)
    for r in packed:
        total[r[0]] += r[2]
    assert total == tokens and len(final.columns) == len(packing.SCHEMA.split(", "))
