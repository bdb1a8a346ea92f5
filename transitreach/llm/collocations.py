"""Phrase collocations by counting quotient filters.

1. One pass over the whole texts writes them as word codes: chunks of some megabytes of one
   language, each with its own list of distinct words and their counts.
2. The lists sum up to the word counts.  Words frequent enough to be part of a candidate get
   dense ids (an n-gram is never more frequent than any of its words, so nothing is lost),
   and each chunk gets the ids of its own words by a join.  No dictionary is broadcast.
3. Each task packs the n-grams of its chunks into ids, permutes them, and sends counting
   quotient filters (``quotient``), one for each prefix of the quotient.  The permutation
   spreads n-grams evenly, however frequent some are, and each task has summed its own, so no
   block is hot.
4. Filters of the same block are merged across tasks.  Where one merge would be too large,
   a round merges some tasks' filters and cuts the result into narrower blocks first.
   Values that stay frequent are turned back into ids.
5. Scores, the removal of phrases that live in a longer one, and the ranking are joins and
   aggregates over the frequent n-grams.

Texts are lower-cased (A-Z), cut at ``[.,;:!?\\x0A-\\x0D]`` and split into words at blanks and
tabs; counts are contiguous occurrences within pieces, per language.

Edge cases: a NULL text is empty and a NULL lang counts as ``und``.  Rows that repeat count as
often as they stand.  A text of any length is read whole, a part at a time.  A language without
candidates has no rows; an empty table gives an empty result.  Ties in score and count are
ordered by the phrase's bytes.  Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.acquire import dense_index
from . import quotient
from .common import broadcast_if, materialise

LEAST = 30                   # occurrences of a candidate
WORDS = 4                    # of the longest candidate
CONTAINED = 80               # a phrase goes if a longer one has this share (in hundredths) of its occurrences
SCALE = 2_000_000            # of the score
TOP = 2000
CHUNK_BYTES = 8_000_000      # of text in a chunk; several languages' open chunks share twice that
SLICE_BYTES = 1_000_000      # of a text split into words at a time
FLUSH = 2_000_000            # n-grams of one length that a task holds
BLOCK = 1 << 18              # n-grams (counted with repeats) for one block
GROUP = 1 << 21              # n-grams that one merge may read
STEP = 10                    # quotient bits by which one round may cut
MOST_BROADCAST = 500_000     # rows of up to four ids and a count

_BREAK = b"\xff"             # never a byte of UTF-8
_TABLE = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\n\x0b\x0c\r\t", bytes(range(97, 123)) + _BREAK * 10 + b" ")
_CHUNK = "chunk bigint, lang string, n_words bigint, words array<binary>, counts array<bigint>, codes binary"


# ---------------------------------------------------------------- texts as codes
class _Chunk:
    """Word codes of texts in order; code 0 separates pieces."""

    def __init__(self):
        self.places: dict[bytes, int] = defaultdict()
        self.places.default_factory = self.places.__len__
        self.places[_BREAK]
        self.codes: list[np.ndarray] = []
        self.bytes = 0

    def add(self, text: bytes) -> None:
        data, at = text.translate(_TABLE), 0
        self.bytes += len(data)
        while at < len(data):
            end = at + SLICE_BYTES
            if end < len(data):                  # at the end of a word: codes go on without a separator
                found = [x for x in (data.find(b" ", end), data.find(_BREAK, end)) if x >= 0]
                end = min(found, default=len(data))
            words = data[at:end].replace(_BREAK, b" \xff ").split()
            self.codes.append(np.fromiter(map(self.places.__getitem__, words), np.int32, len(words)))
            at = end
        self.codes.append(np.zeros(1, dtype=np.int32))

    def row(self, number: int, lang: str) -> pa.RecordBatch:
        codes = np.concatenate(self.codes)
        counts = np.bincount(codes, minlength=len(self.places))[1:]
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), pa.array([lang]), pa.array([int(counts.sum())]),
             pa.array([list(self.places)[1:]], pa.list_(pa.binary())), pa.array([counts], pa.list_(pa.int64())),
             pa.array([codes.astype("<i4").tobytes()], pa.binary())],
            names=["chunk", "lang", "n_words", "words", "counts", "codes"])


def chunks(docs: DataFrame) -> DataFrame:
    """The texts as word codes, in chunks of one language each."""
    def run(batches):
        task, number, open_chunks = TaskContext.get().partitionId(), 0, {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for i, lang in enumerate(langs):
                text = batch.column(0)[i].as_py()
                if not text:
                    continue
                chunk = open_chunks.setdefault(lang, _Chunk())
                chunk.add(text)
                full = [lang] if chunk.bytes >= CHUNK_BYTES else []
                if sum(c.bytes for c in open_chunks.values()) >= 2 * CHUNK_BYTES:
                    full = list(open_chunks)
                for done in full:
                    yield open_chunks.pop(done).row(task << 32 | number, done)
                    number += 1
        for lang, chunk in open_chunks.items():
            yield chunk.row(task << 32 | number, lang)
            number += 1

    return docs.select(F.col("text").cast("binary").alias("text"),
                       F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")).mapInArrow(run, _CHUNK)


def vocabulary(coded: DataFrame, least: int) -> DataFrame:
    """``id, lang, word, f``: the words of at least ``least`` occurrences, with dense ids."""
    counts = (coded.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w"))
              .groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("f"))
              .where(F.col("f") >= F.lit(least)))
    return materialise(coded.sparkSession, dense_index(counts.withColumn("key", F.struct("lang", "word")), "key", "id")
                       .select("id", "lang", "word", "f"), "phrase_words")


# ---------------------------------------------------------------- counting
def _grams(ids: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The packed n-grams of a sequence of ids; a negative id is never part of one."""
    ok = ids >= 0
    whole = ok[:len(ids) - n + 1].copy()
    for k in range(1, n):
        whole &= ok[k:len(ids) - n + 1 + k]
    at = np.flatnonzero(whole)
    words = [ids[at + k].astype(np.uint64) for k in range(n)]
    shift, left = np.uint64(bits), (n + 1) // 2
    hi = words[0] if left == 1 else (words[0] << shift) | words[1]
    lo = words[left] if n - left == 1 else (words[left] << shift) | words[left + 1]
    return hi, lo


def _filter_rows(rows: list[tuple]) -> pa.RecordBatch:
    n, block, part, data = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(n, pa.int32()), pa.array(block, pa.int64()), pa.array(part, pa.int64()),
                                       pa.array(data, pa.binary())], names=["n", "block", "part", "filter"])


_FILTER = "n int, block bigint, part bigint, filter binary"


def shard_filters(coded: DataFrame, words: DataFrame, bits: int, prefix_bits: int) -> DataFrame:
    """Each task's counting quotient filters, one per n-gram length and block."""
    listed = (coded.select("chunk", "lang", F.posexplode("words").alias("place", "word"))
              .join(words.select("id", "lang", "word"), ["lang", "word"])
              .groupBy("chunk").agg(F.collect_list(F.struct("place", "id")).alias("ids")))
    rows = coded.select("chunk", "codes").join(listed, "chunk").select("codes", "ids")

    def run(batches):
        task, number = TaskContext.get().partitionId() << 32, 0
        held: dict[int, list] = {n: [] for n in range(2, WORDS + 1)}

        def flushed(n):
            nonlocal number
            wide, low = quotient.halves(n, bits)
            hi, lo = (np.concatenate([h[i] for h in held[n]]) for i in (0, 1))
            held[n] = []
            found = quotient.counted(*quotient.permute(hi, lo, wide, low), wide, low)
            rows = [(n, block, task | number, data) for block, data in quotient.filters(*found, wide, low, prefix_bits)]
            number += 1
            if rows:
                yield _filter_rows(rows)

        for batch in batches:
            for i in range(batch.num_rows):
                codes = np.frombuffer(batch.column(0)[i].as_py(), dtype="<i4")
                named = batch.column(1)[i].values
                ids = np.full(int(codes.max(initial=0)) + 1, -1, dtype=np.int64)
                ids[named.field(0).to_numpy() + 1] = named.field(1).to_numpy()
                sequence = ids[codes]
                # a long sequence in stretches that overlap by one word less than an n-gram has
                for n in held:
                    for at in range(0, len(sequence), FLUSH):
                        held[n].append(_grams(sequence[at:at + FLUSH + n - 1], n, bits))
                        if sum(len(h[0]) for h in held[n]) >= FLUSH:
                            yield from flushed(n)
        for n in held:
            if held[n]:
                yield from flushed(n)

    return rows.mapInArrow(run, _FILTER)


def frequent(filters: DataFrame, occurrences: int, bits: int, prefix_bits: int, least: int, group: int = GROUP,
             step: int = STEP) -> DataFrame:
    """``ids, a``: the n-grams that the merged filters count at least ``least`` times."""
    spark, widths = filters.sparkSession, {n: quotient.halves(n, bits) for n in range(2, WORDS + 1)}

    def narrower(to):
        def run(key, table):
            n, _, part = (k.as_py() for k in key)
            found = quotient.merged(table.column("filter").to_pylist(), *widths[n])
            return pa.Table.from_batches([_filter_rows([(n, block, part, data) for block, data in quotient.filters(
                *found, *widths[n], to)])])
        return run

    while (rows := -(-occurrences // (1 << prefix_bits))) > group and prefix_bits < bits:
        prefix_bits = min(bits, prefix_bits + step)
        dealt = filters.withColumn("part", F.pmod(F.xxhash64("part"), F.lit(-(-rows // group))))
        filters = materialise(spark, dealt.groupBy("n", "block", "part").applyInArrow(narrower(prefix_bits), _FILTER),
                              "phrase_filters")

    def final(key, table):
        n = key[0].as_py()
        wide, low = widths[n]
        hi, lo, counts = quotient.merged(table.column("filter").to_pylist(), wide, low)
        often = counts >= least
        hi, lo = quotient.restore(hi[often], lo[often], wide, low)
        mask, shift, left = np.uint64((1 << bits) - 1), np.uint64(bits), (n + 1) // 2
        ids = ([hi] if left == 1 else [hi >> shift, hi & mask]) + ([lo] if n - left == 1 else [lo >> shift, lo & mask])
        ids = np.stack(ids, axis=1).astype(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * n), pa.array(ids.ravel()))
        return pa.table({"ids": lists, "a": pa.array(counts[often])})

    return filters.groupBy("n", "block").applyInArrow(final, "ids array<bigint>, a bigint")


# ---------------------------------------------------------------- phrases
def _scored(grams: DataFrame, words: DataFrame, size: int) -> DataFrame:
    """``ids, a, score, l, r`` by the lowest-scoring cut (the first of equals)."""
    parts = words.select(F.array("id").alias("ids"), "f").unionByName(grams.select("ids", F.col("a").alias("f")))
    parts = broadcast_if(parts, size, MOST_BROADCAST)
    n = F.size("ids")
    cuts = grams.select("ids", "a", F.explode(F.sequence(F.lit(1), n - 1)).alias("k")).withColumns({
        "left": F.slice("ids", 1, F.col("k")), "right": F.slice("ids", F.col("k") + 1, n - F.col("k"))})
    cuts = (cuts.join(parts.select(F.col("ids").alias("left"), F.col("f").alias("l")), "left")
            .join(parts.select(F.col("ids").alias("right"), F.col("f").alias("r")), "right"))
    score = F.expr(f"CAST(a AS DECIMAL(20, 0)) * {SCALE} DIV (CAST(l AS DECIMAL(20, 0)) + r)")
    best = cuts.groupBy("ids").agg(F.min("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b"))
    return best.select("ids", "a", "b.score", "b.l", "b.r")


def _contained(grams: DataFrame) -> DataFrame:
    """``ids, most``: each phrase within a longer candidate, and the most occurrences of such a one."""
    n = F.size("ids")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), n - 1), lambda m: F.transform(
        F.sequence(F.lit(1), n - m + 1), lambda s: F.slice("ids", s, m))))
    return (grams.where(n > 2).select(F.explode(inner).alias("ids"), "a")
            .groupBy("ids").agg(F.max("a").alias("most")))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """Each language's ``top`` phrases: ``lang, rank, phrase, a, l, r, n, score``."""
    spark = docs.sparkSession
    coded = materialise(spark, chunks(docs), "phrase_chunks")
    words = vocabulary(coded, least)
    totals = materialise(spark, coded.groupBy("lang").agg(F.sum("n_words").alias("n")), "phrase_totals")
    size, occurrences = words.count(), totals.agg(F.sum("n")).first()[0] or 0
    bits = max(1, (size - 1).bit_length()) if size else 1
    if bits > 31:
        raise ValueError("more than 2^31 frequent words")
    prefix_bits = min(STEP, bits, max(0, -(-occurrences // BLOCK) - 1).bit_length())
    filters = shard_filters(coded, words, bits, prefix_bits)
    grams = materialise(spark, frequent(filters, occurrences, bits, prefix_bits, least), "phrase_grams")
    size += grams.count()

    kept = (_scored(grams, words, size).join(broadcast_if(_contained(grams), size, MOST_BROADCAST), "ids", "left")
            .where(f"most IS NULL OR 100 * most < {CONTAINED} * a"))
    named = words.select("id", "lang", F.col("word").cast("string").alias("word"))
    named = broadcast_if(named, size, MOST_BROADCAST)
    kept = kept.join(named.select(F.col("id").alias("first"), "lang"), F.get("ids", F.lit(0)) == F.col("first"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    # ties of the last place stay until the phrases are spelt
    kept = kept.withColumn("place", F.rank().over(order)).where(F.col("place") <= top).drop("place", "first")
    spelt = (kept.select("ids", "lang", "a", "l", "r", "score", F.posexplode("ids").alias("at", "id"))
             .join(named.drop("lang"), "id")
             .groupBy("ids").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("w"),
                                 *[F.min(c).alias(c) for c in ("lang", "a", "l", "r", "score")])
             .withColumn("phrase", F.array_join("w.word", " ")))
    last = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = spelt.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= top)
    return (ranked.join(totals, "lang")
            .select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n",
                    F.col("score").cast("bigint").alias("score")))


# The contract's query in DuckDB SQL.
ORACLE_SQL = r"""
WITH p AS (
  SELECT COALESCE(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(COALESCE(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p
), t AS (SELECT lang, CAST(SUM(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang
), g AS (
  SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase
  FROM w, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(ws) >= m
), f AS (
  SELECT lang, m, phrase, COUNT(*) AS a, string_split(phrase, ' ') AS ws FROM g GROUP BY ALL HAVING COUNT(*) >= 30
), c AS (
  SELECT lang, m, phrase, a, ws, unnest(range(1, m)) AS k FROM f WHERE m > 1
), s AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.a AS l, y.a AS r,
         CAST((CAST(2000000 AS HUGEINT) * c.a) // (CAST(x.a AS HUGEINT) + y.a) AS BIGINT) AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.m = c.k AND x.phrase = array_to_string(c.ws[1:c.k], ' ')
         JOIN f y ON y.lang = c.lang AND y.m = c.m - c.k AND y.phrase = array_to_string(c.ws[c.k + 1:], ' ')
), b AS (
  SELECT * FROM s QUALIFY ROW_NUMBER() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), i AS (
  SELECT lang, array_to_string(ws[j:j + v - 1], ' ') AS phrase, MAX(a) AS most
  FROM f, (SELECT unnest([2, 3]) AS v), (SELECT unnest([1, 2, 3]) AS j) WHERE v < m AND j + v - 1 <= m GROUP BY 1, 2
), d AS (
  SELECT b.* FROM b LEFT JOIN i USING (lang, phrase) WHERE i.most IS NULL OR 100 * i.most < 80 * b.a
)
SELECT d.lang, ROW_NUMBER() OVER (PARTITION BY d.lang ORDER BY score DESC, a DESC, phrase) AS rank,
       phrase, a, l, r, t.n, score
FROM d JOIN t ON t.lang = d.lang
QUALIFY rank <= 2000
"""
