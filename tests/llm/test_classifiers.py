"""Quality and toxicity: held-out accuracy, parts against brute force, odd rows."""

import re

import numpy as np
from pyspark.sql import functions as F

from transitreach.llm import quality, toxicity
from transitreach.llm.common import documents, labels

LABELS = "doc_id bigint, quality int, toxic int"


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    scored = quality.quality_scores(documents(spark, d), labels(spark, d)).join(labels(spark, d), "doc_id")
    rows = scored.where("held_out").select("score", "predicted", "quality").toPandas()
    good, bad = rows[rows["quality"] == 1]["score"], rows[rows["quality"] == 0]["score"]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.95 and (rows["predicted"] == rows["quality"]).mean() > 0.9
    assert rows["score"].between(0, 1).all()


def test_normal_equations_are_the_whole_sum(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(700, quality.N_STATISTICS)), rng.integers(0, 2, 700).astype(float)
    model = quality.Model(np.zeros(quality.N_STATISTICS), np.ones(quality.N_STATISTICS),
                          rng.normal(size=(quality.N_STATISTICS, 8)), rng.normal(size=8), np.zeros(1), np.zeros(1),
                          np.zeros(1))
    rows = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y)], "x array<double>, y double")
    gram, moment = quality.normal_equations(rows.repartition(5), model)
    z = model.fourier(x)
    assert np.allclose(gram, z.T @ z) and np.allclose(moment, z.T @ y)


def test_isotonic_is_monotone_and_keeps_the_mean():
    at, s, n = np.arange(6.0), np.array([1.0, 0, 2, 1, 3, 4]), np.array([2.0, 2, 3, 4, 3, 4])
    x, p = quality.isotonic(at, s, n)
    assert (np.diff(p) > 0).all() and (np.diff(x) > 0).all()


def test_odd_rows_get_a_score(spark, odd, none):
    marks = spark.createDataFrame([(i, i % 2, int(i == 16)) for i in range(1, 20)] + [(None, 1, 1), (3, None, None), (999, 1, 1)],
                                  LABELS)
    empty = spark.createDataFrame([], LABELS)
    for m in (marks, empty):
        assert quality.quality_scores(odd, m).where("score BETWEEN 0 AND 1").count() == odd.count()
        assert toxicity.toxicity_scores(odd, m).where("p_toxic BETWEEN 0 AND 1").count() == odd.count()
    assert toxicity.reject_toxic(odd, empty).count() == odd.count()
    assert toxicity.reject_toxic(odd, marks).columns == odd.columns
    assert quality.quality_scores(none, marks).count() == 0 and toxicity.toxicity_scores(none, marks).count() == 0


def test_chain_on_rows_it_has_not_seen(spark):
    d = "/root/testdata/sf0.1"
    docs, marks = documents(spark, d), labels(spark, d)
    half = toxicity.toxicity_scores(docs.join(marks.select("doc_id"), "doc_id", "left_semi"), marks.where("doc_id % 2 = 0"))
    rows = half.join(marks, "doc_id").where("doc_id % 2 = 1").select("toxic", F.col("rejected").cast("int").alias("r")).toPandas()
    assert rows[rows["toxic"] == 1]["r"].mean() > 0.85          # some labelled toxic hold no telling word
    assert rows[rows["toxic"] == 0]["r"].mean() < 0.01


def test_later_links_are_trained_on_out_of_fold_probabilities(monkeypatch):
    seen = []
    rng = np.random.default_rng(0)
    x = np.column_stack((np.ones(200), rng.normal(size=200)))
    y = (x[:, 1] + rng.normal(size=200) > 0).astype(float)
    original = toxicity._fit_link
    monkeypatch.setattr(toxicity, "_fit_link", lambda a, b: seen.append(a) or original(a, b))
    fold = np.arange(200) % toxicity.FOLDS
    toxicity.fit_chain((), x, np.column_stack((y, y, y)), fold)
    second = next(a for a in seen if a.shape == (200, 3))
    beta = original(x[fold != 0], y[fold != 0])
    assert np.allclose(second[fold == 0, 2], toxicity._sigmoid(x[fold == 0] @ beta))


def test_a_link_cannot_read_its_category_off_an_input(spark):
    """No weight on the category's own words or their stems; the last link has them."""
    rows = [(i, " ".join(["you", "idiot", "idiotic"] if i % 4 == 0 else ["pathetic", "scum"] if i % 4 == 1 else ["fine", "day"])
             + f" bile{'' if i % 2 else 's'} w{i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    chain = toxicity.fit(docs, docs.selectExpr("doc_id", "IF(doc_id % 4 < 2, 1, 0) AS toxic"))
    for name, seeds in toxicity.SEEDS.items():
        own = toxicity.own_words(chain.words, name)
        assert not chain.betas[name][:len(own)][own].any()
        assert {w for w, o in zip(("", *chain.words), own) if o} >= set(seeds)
        assert chain.betas["toxic"][:len(own)][own].any()
    assert [len(chain.betas[n]) for n in toxicity.CHAIN] == [len(chain.words) + 1 + len(toxicity.SEEDS) + c for c in range(3)]


def test_terms_of_a_fold_come_from_the_other_folds(spark):
    rows = [(i, "common words", int(i % 8 < 4), i % 4) for i in range(160)]
    lists = toxicity.telling_terms(spark.createDataFrame(
        [(i, t + (" venom" if y else " calm") + (" leak" + "abcd"[f] if y else ""), y, f) for i, t, y, f in rows],
        "doc_id bigint, text string, toxic int, fold int"))
    assert len(lists) == toxicity.FOLDS + 1
    for f in range(toxicity.FOLDS):
        assert "venom" in lists[f] and "leak" + "abcd"[f] not in lists[f] and "leak" + "bcda"[f] in lists[f]
    assert all("leak" + c in lists[-1] for c in "abcd")


def test_a_repeated_doc_id_trains_once(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (1, None), (2, "c")] + [(3, "same")] * 50, "doc_id bigint, text string")
    marks = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1)], "doc_id bigint, toxic int")
    got = toxicity.training_rows(docs, marks).collect()
    assert sorted((r["doc_id"], r["toxic"]) for r in got) == [(1, 1), (2, 0), (3, 1)]
    again = toxicity.training_rows(docs.repartition(7), marks).collect()
    assert {(r["doc_id"], r["text"]) for r in got} == {(r["doc_id"], r["text"]) for r in again}


def test_scores_equal_plain_python(spark):
    d = "/root/testdata/sf0.001"
    docs, marks = documents(spark, d), labels(spark, d)
    chain = toxicity.fit(docs, marks)
    got = {r["doc_id"]: r for r in toxicity.toxicity_scores(docs, marks).collect()}
    for r in docs.collect():
        words = [w for w in re.findall(r"[^\W\d_]+", (r["text"] or "").lower())]
        terms = words + [w[:toxicity.STEM] + "*" for w in words if len(w) > toxicity.STEM]
        x = [1.0, *(np.log1p(terms.count(w)) for w in chain.words),
             *(np.log1p(sum(words.count(s) for s in seeds)) for seeds in toxicity.SEEDS.values())]
        for name in toxicity.CHAIN:
            p = 1 / (1 + np.exp(-np.clip(np.dot(x, chain.betas[name]), -30, 30))) if name in chain.betas else chain.base
            assert abs(got[r["doc_id"]][f"p_{name}"] - p) < 1e-9
            x.append(p)
        assert got[r["doc_id"]]["rejected"] == (x[-1] >= toxicity.REJECT)
