"""Toxicity by a classifier chain.

Categories are predicted one after the other: ``contempt``, ``insult``, then
``toxic`` itself.  Each link is a linear (logistic) model over word features, and
every later link also sees the probabilities of the earlier ones.  For training
those are out-of-fold predictions, from models that have not seen the row, so
that a later link learns how far an earlier one can be trusted on new rows; for
scoring they come from the models fitted on all training rows.

The labels say only whether a document is toxic.  A document has a finer category
when it is labelled toxic and holds one of the category's seed words.  The category's
own link sees none of those words, neither themselves nor stems that begin them: it
predicts the category from the rest of the text, and cannot read its target off an
input.  The other links see them.

The features are logarithmic counts of the seed words and of the ``TERMS`` terms that
set toxic training documents apart most: words, and beginnings of words (``STEM``
letters and a star), by the signed likelihood ratio of their document frequencies.
For out-of-fold predictions the terms are chosen anew without the fold's documents.
The models are fitted on a bounded sample: the ``MOST_TRAINING`` labelled documents
with the smallest hashes of doc_id, one row each.  Every document is scored on its
whole text.

Edge cases: a NULL or empty text has no words and gets the score of such a
row.  Labels that are NULL, or of documents that are not there, are ignored; a
labelled doc_id that repeats trains with the text of the smallest hash.  If
all labels are alike, or there are none, every probability is the share of
toxic ones (0 without labels).  Repeated rows get equal scores.  An empty
table gives an empty result.  Extra columns, whatever their names, are ignored by
``toxicity_scores`` and returned unchanged by ``reject_toxic``.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if, materialise, text_of
from .pii import fit_logistic
from .wordcodec import text_chunks

# ---- Fixed values: the chain's categories with their seed words; the last is the label itself ----
SEEDS = {"contempt": ("disgusting", "pathetic", "stupid", "trash", "worthless"),
         "insult": ("clown", "idiot", "loser", "moron", "scum")}
CHAIN = (*SEEDS, "toxic")
TERMS = 250
STEM = 5
MOST_TRAINING = 10_000         # labelled documents that the models are fitted on
FOLDS = 4
RIDGE = 0.5
REJECT = 0.5

_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Chain:
    words: tuple[str, ...]
    betas: dict[str, np.ndarray] = field(default_factory=dict)
    base: float = 0.0            # the probability where nothing could be fitted

    def features(self, text: str, places: dict[str, int]) -> np.ndarray:
        """A one, the logarithmic count of each term, and of the seed words by category."""
        n, words = len(self.words), _WORD.findall(text.lower())
        own = Counter(map(places.get, words))
        own.update(places.get(w[:STEM] + "*") for w in words if len(w) > STEM)
        own.pop(None, None)
        x = np.zeros(1 + n + len(SEEDS))
        x[0] = 1
        for place, count in own.items():
            x[1 + place] = np.log1p(count)
        for i, seeds in enumerate(SEEDS.values()):
            x[1 + n + i] = np.log1p(sum(own.get(places[s], 0) for s in seeds))
        return x

    def matrix(self, texts: list[str]) -> np.ndarray:
        places = {w: i for i, w in enumerate(self.words)}
        return np.array([self.features(t, places) for t in texts]).reshape(-1, len(self.words) + 1 + len(SEEDS))

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(rows, categories), each link fed with the links before."""
        out = np.zeros((len(x), 0))
        for name in CHAIN:
            if name in self.betas:
                p = _sigmoid(np.hstack((x, out)) @ self.betas[name])
            else:
                p = np.full(len(x), self.base)
            out = np.column_stack((out, p))
        return out


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


def _fit_link(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return fit_logistic(x, y, np.ones(len(y)), ridge=RIDGE, steps=8)


def _fit_open(x: np.ndarray, earlier: np.ndarray, y: np.ndarray, rows: np.ndarray, open_: np.ndarray) -> np.ndarray:
    """A link on some rows, the open columns of ``x`` and the links before; the weights of other columns are 0."""
    beta = np.zeros(x.shape[1] + earlier.shape[1])
    used = np.r_[np.flatnonzero(open_), x.shape[1]:len(beta)]
    beta[used] = _fit_link(np.hstack((x[np.ix_(rows, open_)], earlier[rows])), y[rows])
    return beta


def own_words(words: tuple[str, ...], name: str) -> np.ndarray:
    """Which columns of the features tell a category's own seed words."""
    seeds = SEEDS.get(name, ())
    stems = {s[:STEM] + "*" for s in seeds if len(s) > STEM}
    return np.array([False, *(w in seeds or w in stems for w in words), *(category == name for category in SEEDS)])


def fit_chain(words: tuple[str, ...], x: np.ndarray, targets: np.ndarray, fold: np.ndarray,
              chosen: np.ndarray | None = None, hidden: dict[str, np.ndarray] | None = None) -> Chain:
    """Fit the links in order; ``targets`` has a column per category.

    ``chosen`` says which columns the models without fold 0, 1, .. may use, its last row
    which the final ones may; ``hidden`` which a category's own link may not.
    """
    toxic = targets[:, -1]
    chain = Chain(words, base=float(toxic.mean()) if len(toxic) else 0.0)
    if not len(toxic) or toxic.min() == toxic.max():
        return chain
    if chosen is None:
        chosen = np.ones((FOLDS + 1, x.shape[1]), dtype=bool)
    n, earlier = x.shape[1], np.zeros((len(x), 0))
    for c, name in enumerate(CHAIN):
        y = targets[:, c]
        open_ = chosen if hidden is None or name not in hidden else chosen & ~hidden[name]
        unseen = np.zeros(len(y))
        for f in range(FOLDS):
            out = fold == f
            if out.any() and not out.all():
                beta = _fit_open(x, earlier, y, ~out, open_[f])
                unseen[out] = _sigmoid(x[out] @ beta[:n] + earlier[out] @ beta[n:])
        chain.betas[name] = _fit_open(x, earlier, y, np.ones(len(y), dtype=bool), open_[-1])
        earlier = np.column_stack((earlier, unseen))
    return chain


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, text, toxic, fold`` of the bounded training sample."""
    marked = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
    hashed = F.xxhash64("doc_id", F.lit("train"))
    chosen = (marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).join(ids, "doc_id")
              .orderBy(hashed, "doc_id").limit(MOST_TRAINING))
    chosen = materialise(docs.sparkSession, chosen, "toxicity_sample")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    one = rows.join(broadcast_if(chosen.select("doc_id"), chosen.count(), MOST_TRAINING), "doc_id").groupBy("doc_id").agg(
        F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))
    return one.join(chosen, "doc_id").withColumn(
        "fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int"))


def telling_terms(rows: DataFrame) -> list[tuple[str, ...]]:
    """The seed words, then the terms whose presence speaks most for a toxic document.

    One list per fold, from the documents outside it, and last the list from all.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), F.lit(0)))
    stems = F.array_distinct(F.transform(F.filter(F.col("words"), lambda w: F.length(w) > STEM),
                                         lambda w: F.concat(F.left(w, F.lit(STEM)), F.lit("*"))))
    found = rows.select("toxic", "fold", words.alias("words")).select(
        "toxic", "fold", F.explode(F.concat("words", stems)).alias("term"))
    sums = []
    for f in range(FOLDS + 1):
        inside = F.when(F.col("fold") != f, F.lit(1)).otherwise(F.lit(0)) if f < FOLDS else F.lit(1)
        sums += [F.sum(inside * F.col("toxic")).cast("double").alias(f"t{f}"),
                 F.sum(inside * (1 - F.col("toxic"))).cast("double").alias(f"c{f}")]
    sizes = rows.agg(*sums).first()
    counts = materialise(rows.sparkSession, found.groupBy("term").agg(*sums).where(f"t{FOLDS} >= 2"), "toxicity_terms")
    tops = []
    for f in range(FOLDS + 1):
        nt, nc = sizes[f"t{f}"] or 0.0, sizes[f"c{f}"] or 0.0
        t, c = F.col(f"t{f}"), F.col(f"c{f}")
        pt, pc, both = t / F.lit(nt), (c + 0.5) / F.lit(nc + 1), (t + c) / F.lit(nt + nc)
        ratio = t * F.log(pt / both) + F.when(c > 0, c * F.log(pc / both)).otherwise(0.0)
        if nt:
            tops.append(counts.where(t >= 2).where(pt > pc).select(F.lit(f).alias("list"), "term", ratio.alias("ratio"))
                        .orderBy(F.desc("ratio"), "term").limit(TERMS))
    # at most TERMS rows a list
    top = sorted(reduce(DataFrame.unionAll, tops).collect(), key=lambda r: (-r["ratio"], r["term"])) if tops else []
    seeds = [w for s in SEEDS.values() for w in s]
    return [tuple(dict.fromkeys([*seeds, *(r["term"] for r in top if r["list"] == f)])) for f in range(FOLDS + 1)]


def fit(docs: DataFrame, labels: DataFrame) -> Chain:
    rows = materialise(docs.sparkSession, training_rows(docs, labels), "toxicity_training")
    lists = telling_terms(rows)
    final = lists[-1]
    words = tuple(dict.fromkeys([*final, *(w for ws in lists for w in ws)]))     # the final terms first
    blank = Chain(words)

    def run(batches):
        for part, texts in text_chunks(batches):
            x = blank.matrix(texts)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), part.column(3), pa.ListArray.from_arrays(
                    pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]),
                    pa.array(x.astype(np.float32).ravel()))], names=["doc_id", "toxic", "fold", "x"])

    # bounded by MOST_TRAINING documents, one row each; as Arrow, and one flat array of features
    table = rows.select("doc_id", "text", "toxic", "fold").mapInArrow(
        run, "doc_id bigint, toxic int, fold int, x array<float>").toArrow()
    order = np.argsort(table["doc_id"].to_numpy(), kind="stable")
    toxic, fold = (table[c].to_numpy()[order] for c in ("toxic", "fold"))
    x = np.zeros((len(order), len(words) + 1 + len(SEEDS)), dtype=np.float32)
    places, at = np.argsort(order), 0
    for part in table["x"].chunks:
        x[places[at:at + len(part)]] = part.flatten().to_numpy().reshape(len(part), x.shape[1])
        at += len(part)
    del table
    toxic = toxic.astype(float)
    seeded = x[:, -len(SEEDS):] > 0
    targets = np.column_stack([*[toxic * seeded[:, i] for i in range(len(SEEDS))], toxic])
    chosen = np.array([[True, *map(set(ws).__contains__, words), *[True] * len(SEEDS)] for ws in lists])
    chain = fit_chain(words, x, targets, fold, chosen, {name: own_words(words, name) for name in SEEDS})
    # the final links use the final terms only: leave the columns of the others out
    kept = np.r_[:len(final) + 1, len(words) + 1:len(words) + 1 + len(SEEDS) + len(CHAIN)]
    return Chain(final, {name: beta[kept[kept < len(beta)]] for name, beta in chain.betas.items()}, chain.base)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, p_contempt, p_insult, p_toxic, rejected`` of every row."""
    chain = fit(docs, labels)

    def run(batches):
        for part, texts in text_chunks(batches):
            p = chain.probabilities(chain.matrix(texts))
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(p[:, i]) for i in range(len(CHAIN))]],
                                             names=["doc_id", *[f"p_{c}" for c in CHAIN]])

    scored = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, " + ", ".join(f"p_{c} double" for c in CHAIN))
    return scored.withColumn("rejected", F.col("p_toxic") >= REJECT)


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected, all columns as they were."""
    chain = fit(docs, labels)

    def run(batches):
        for part, texts in text_chunks(batches):
            p = chain.probabilities(chain.matrix(texts))[:, -1]
            yield part.filter(pa.array(p < REJECT))

    return docs.mapInArrow(run, docs.schema)
