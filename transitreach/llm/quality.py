"""Quality classifier: random Fourier features, ridge by normal equations, isotonic calibration.

1. One pass over the whole texts computes document statistics (shares of
   characters, words, lines, repetition).  Nothing else about a document goes into its
   score: no label, language, source or id.
2. The standardised statistics go through random Fourier features,
   sqrt(2 / D) cos(W x + b), whose inner products approximate a Gaussian kernel, and
   a ridge regression of the label is fitted on them.  Each partition sums its
   part of the normal equations; the parts are summed by matrix row, first within
   ``LANES`` lanes, then over them, and the D x D system is solved.
3. An isotonic regression (pool adjacent violators) on counts and label sums per
   score bin, over labelled rows that the ridge has not seen, turns raw scores
   into probabilities.

All labelled rows take part: those whose crc32(doc_id as text) mod 4 is 0 or 1
fit the ridge, 3 the calibration, and 2 is held out.

Edge cases: a NULL or empty text has statistics 0 and gets the score of such a
row.  Repeated rows get equal scores.  A NULL doc_id is not held out, and is scored
like any other.  Labels that are NULL, or of documents that are not there, are
ignored; a doc_id labelled twice counts twice.  Without labels every score is 0.5.  An empty table gives
an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .wordcodec import text_chunks

FEATURES = 256            # random Fourier features
RIDGE = 1e-3              # share of the labelled rows
BANDWIDTH = 4.0           # of the Gaussian kernel over standardised statistics
LANES = 32
BINS = 400                # of raw scores, from -0.5 to 1.5
PREDICT = 0.7
SEED = 11

_MARKS = [b"|", b"#$%&*", b"!", b".", b",", b";:", b"?", b"\"'()[]", b"-_/\\", b"<>{}=~^`+@"]
_CLASSES = np.zeros((256, 7 + len(_MARKS)))
_CLASSES[ord("a"):ord("z") + 1, 0] = 1
_CLASSES[ord("A"):ord("Z") + 1, 1] = 1
_CLASSES[ord("0"):ord("9") + 1, 2] = 1
_CLASSES[[0x20, 0x09], 3] = 1
_CLASSES[[0x0A, 0x0D], 4] = 1
_CLASSES[128:, 5] = 1
_CLASSES[[*range(9), 0x0B, 0x0C, *range(14, 32), 127], 6] = 1
for _i, _m in enumerate(_MARKS):
    _CLASSES[list(_m), 7 + _i] = 1
N_STATISTICS = _CLASSES.shape[1] + 11


def statistics(text: str) -> np.ndarray:
    """Document statistics of a whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    if not raw:
        return np.zeros(N_STATISTICS)
    shares = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256) @ _CLASSES / len(raw)
    words, lines = raw.split(), raw.split(b"\n")
    n = max(1, len(words))
    pairs = set(zip(words, words[1:]))
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1, dtype=np.int64)
    return np.concatenate((np.sqrt(shares), [
        np.log1p(len(raw)), np.log1p(len(words)), sizes.mean(), sizes.std(), np.log1p(sizes.max()),
        len(set(words)) / n, (len(pairs) + 1) / n, len(set(lines)) / len(lines), np.log1p(len(lines)),
        np.log1p(len(raw) / len(lines)), len(zlib.compress(raw, 1)) / (len(raw) + 20)]))


def document_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, x``: the statistics of each row."""
    def run(batches):
        for part, texts in text_chunks(batches):
            x = np.array([statistics(t) for t in texts]).reshape(-1, N_STATISTICS)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.ListArray.from_arrays(
                    pa.array(np.arange(len(x) + 1, dtype=np.int32) * N_STATISTICS), pa.array(x.ravel()))],
                names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, x array<double>")


def remainder() -> Column:
    """crc32(doc_id as text) mod 4."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4


@dataclass
class Model:
    mean: np.ndarray
    deviation: np.ndarray
    w: np.ndarray
    b: np.ndarray
    beta: np.ndarray
    knots: np.ndarray            # raw scores
    values: np.ndarray           # and their calibrated probabilities, ascending

    def fourier(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features of statistics (rows), the constant and the linear terms last."""
        z = (x - self.mean) / self.deviation
        return np.hstack((np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), np.ones((len(x), 1)), z / 10))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.fourier(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.values)


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    lists = batch.column(batch.schema.get_field_index(name))
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATISTICS)


def _summed(parts: DataFrame) -> pd.DataFrame:
    """Sums of ``v`` by ``i``: within lanes of partitions, then over the lanes."""
    def add(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": group["i"].iloc[:1], "lane": [0], "v": [np.sum(np.stack(group["v"]), axis=0)]})

    schema = "i int, lane int, v array<double>"
    return parts.groupBy("i", "lane").applyInPandas(add, schema).groupBy("i").applyInPandas(add, schema).toPandas()


def normal_equations(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Z'Z and Z'y over ``rows`` (``x, y``), summed by partition."""
    size = len(model.b) + 1 + N_STATISTICS

    def run(batches):
        from pyspark import TaskContext

        total = np.zeros((size, size + 1))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                z = model.fourier(_matrix(part, "x"))
                y = part.column(part.schema.get_field_index("y")).to_numpy(zero_copy_only=False)
                total += z.T @ np.column_stack((z, y))
        lane = TaskContext.get().partitionId() % LANES
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(size, dtype=np.int32)), pa.array(np.full(size, lane, dtype=np.int32)),
             pa.ListArray.from_arrays(pa.array(np.arange(size + 1, dtype=np.int32) * (size + 1)),
                                      pa.array(total.ravel()))], names=["i", "lane", "v"])

    sums = _summed(rows.select("x", "y").mapInArrow(run, "i int, lane int, v array<double>"))
    both = np.stack(sums.sort_values("i")["v"])
    return both[:, :-1], both[:, -1]


def isotonic(at: np.ndarray, labels: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: block centres and ascending block means."""
    blocks: list[list[float]] = []
    for x, s, n in zip(at, labels, counts):
        blocks.append([x * n, s, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            top = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], top)]
    return (np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks]))


def fit(labelled: DataFrame) -> Model:
    """The model of ``labelled`` rows ``doc_id, x, y``."""
    rows = labelled.withColumn("r", remainder()).where("r <> 2")
    moments = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(
        F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("i").toPandas()     # one row per statistic
    rng = np.random.default_rng(SEED)
    w, b = rng.normal(size=(N_STATISTICS, FEATURES)) / BANDWIDTH, rng.uniform(0, 2 * np.pi, FEATURES)
    size = FEATURES + 1 + N_STATISTICS
    flat = Model(np.zeros(N_STATISTICS), np.ones(N_STATISTICS), w, b, np.zeros(size), np.zeros(1), np.full(1, 0.5))
    if len(moments) < N_STATISTICS:
        return flat
    model = Model(moments["m"].to_numpy(), np.maximum(moments["s"].to_numpy(), 1e-6), w, b, np.zeros(size),
                  np.zeros(1), np.full(1, 0.5))
    gram, moment = normal_equations(rows.where("r <> 3"), model)
    n = gram[FEATURES, FEATURES]
    model.beta = np.linalg.solve(gram + np.eye(size) * (RIDGE * n + 1e-9), moment)

    def binned(batches):
        for batch in batches:
            raw = np.clip(model.raw(_matrix(batch, "x")), -0.5, 1.5 - 1e-9)
            yield pa.RecordBatch.from_arrays(
                [pa.array(((raw + 0.5) / 2 * BINS).astype(np.int32)), pa.array(raw),
                 batch.column(batch.schema.get_field_index("y"))], names=["bin", "raw", "y"])

    bins = (rows.where("r = 3").select("x", "y").mapInArrow(binned, "bin int, raw double, y double")
            .groupBy("bin").agg(F.avg("raw").alias("at"), F.sum("y").alias("s"), F.count(F.lit(1)).alias("n"))
            .orderBy("bin").toPandas())                                           # at most BINS rows
    if len(bins):
        model.knots, model.values = isotonic(bins["at"].to_numpy(), bins["s"].to_numpy(), bins["n"].to_numpy())
    return model


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    spark = docs.sparkSession
    rows = materialise(spark, document_statistics(docs), "quality_statistics")
    marked = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("double").alias("y"))
    model = fit(materialise(spark, rows.join(marked, "doc_id"), "quality_labelled"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.clip(model.score(_matrix(batch, "x")), 0.0, 1.0))],
                names=["doc_id", "held_out", "score"])

    held = F.coalesce(remainder() == 2, F.lit(False))
    scored = rows.select("doc_id", held.alias("held_out"), "x").mapInArrow(
        run, "doc_id bigint, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= PREDICT).cast("int"))
