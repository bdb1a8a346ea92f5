"""Near-duplicate detection with b-bit MinHash.

1. One pass over the whole texts hashes each document's word shingles and takes
   128 minima.  Their lowest 4 bits are packed as bit planes (512 bits a
   document); 32 bands of 4 whole minima give the candidate keys.
2. Documents of equal shingle sets are one class; only its smallest doc_id goes
   on.  Classes that share a band key are candidates.
3. A candidate pair's similarity is estimated from its bit planes: minima agree
   where no plane differs (a bit count), and chance agreement, 2^-4 a minimum, is
   taken off.  Pairs clearly below the threshold are dropped.
4. What remains is confirmed on the full shingle sets, and confirmed links are
   joined to components.

Within a band bucket pairs are not enumerated.  In each round every bucket offers
its members one leader, another one each round; a member is confirmed against the
most similar of the leaders that pass the bit-count test, and members that a
round has brought together are not compared again.

What is then still in buckets of several components is settled by counting: a
shingle that no other class in an open bucket has cannot be shared, so a class
with more than a fifth of such shingles (at a threshold of 0.8) links with nothing
and leaves.  The count takes one pass over the open classes' shingles, whatever
their number, and also names each bucket's most central member, the one with the
smallest such share, which leads the next round.  Counting and round are done up to
``SETTLINGS`` times.

Every pair that passes the bit-count test also joins the two in one family, and
bucket members of different families are compared by bit counts until no pair
passes.  So any pair that could be a link lies within a family, and families that
still hold several components are compared completely.  In both, only what stands
outside the largest family (component) is compared with all, and only with sizes
that can reach the threshold: rows stand in their size class and the next one.
Such groups are dealt in blocks of about ``BLOCK`` rows a side.  Only links that
join two components leave a block.

What may be lost is set by the signature: a pair of exactly 0.8 shares no band
with probability (1 - 0.8^4)^32 < 5e-8, and fails the bit-count test with a
probability below ``LOSS``.

Edge cases: a NULL or empty text has an empty set and links with nothing.  A
row without a doc_id takes the component of its equals that have one; it links
nothing itself, and if it has no such equals its component is NULL.  Links are between
texts: rows that repeat a doc_id are in one component only if their texts link, and
``near_dedup`` keeps one row of each component.  An empty table gives an empty result.  Extra columns, whatever
their names, are ignored by ``near_groups`` and returned unchanged by
``near_dedup``.
"""

from __future__ import annotations

from functools import reduce
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shingles
from .common import broadcast_if, materialise, packed
from .components import components
from .wordcodec import text_chunks

HASHES, BITS, BAND_ROWS = 128, 4, 4
LOSS = 1e-6              # chance that the bit-count test drops a pair at the threshold
ROUNDS = 1               # leader rounds before counting
SETTLINGS = 1            # rounds of counting and central leaders at most
BLOCK = 1024             # rows a side of a block of a bucket, by bit counts
FAMILY_BLOCK = 128       # rows a side of a block of a family, with their full sets
MOST_BROADCAST_IDS = 1_000_000     # one or two longs each
ROWS_A_FILE = 200_000              # of small tables of ids

PLANES = [f"p{i}" for i in range(BITS * HASHES // 64)]
_SIGNATURE = "doc_id bigint, n_shingles bigint, s1 bigint, s2 bigint, bands array<bigint>, " + ", ".join(
    f"{p} bigint" for p in PLANES)


def least_agreeing(threshold: float, loss: float = LOSS) -> int:
    """The smallest count of agreeing minima that still passes: a pair of the
    threshold's similarity has fewer with a probability of at most ``loss``.

    A minimum agrees with probability C + (1 - C) * J, C = 2^-b being the chance
    agreement; so the test is the corrected estimate (m / k - C) / (1 - C)
    against a bound below the threshold.
    """
    c = 2.0 ** -BITS
    p, total, m = c + (1 - c) * threshold, 0.0, 0
    while (total := total + comb(HASHES, m) * p ** m * (1 - p) ** (HASHES - m)) <= loss:
        m += 1
    return m


def agreeing(a: str, b: str) -> Column:
    """The number of minima in which the signatures ``a`` and ``b`` (table aliases) agree."""
    words = HASHES // 64
    differ = F.lit(0)
    for w in range(words):
        word = None
        for bit in range(BITS):
            x = F.col(f"{a}.{PLANES[bit * words + w]}").bitwiseXOR(F.col(f"{b}.{PLANES[bit * words + w]}"))
            word = x if word is None else word.bitwiseOR(x)
        differ = differ + F.bit_count(word)
    return F.lit(HASHES) - differ


def similarity(a: str, b: str) -> Column:
    """The collision-corrected estimate of the Jaccard similarity."""
    c = 2.0 ** -BITS
    return F.greatest(F.lit(0.0), (agreeing(a, b) / F.lit(float(HASHES)) - F.lit(c)) / F.lit(1 - c))


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """One row per document: set size, set digest, band keys and packed bit planes."""
    def run(batches):
        for part, texts in text_chunks(batches, most=shingles.CHUNK_BYTES):
            sets = shingles.shingle_sets(texts, width)
            full = [i for i, s in enumerate(sets) if len(s)]
            low = shingles.minima([sets[i] for i in full], HASHES)
            bands = np.zeros((len(sets), HASHES // BAND_ROWS), dtype=np.int64)
            planes = np.zeros((len(sets), len(PLANES)), dtype=np.int64)
            bands[full] = shingles.band_keys(low, BAND_ROWS)
            planes[full] = shingles.bit_planes(low, BITS)
            digests = np.array([shingles.set_digest(s) for s in sets], dtype=np.int64).reshape(-1, 2)
            offsets = np.arange(len(sets) + 1, dtype=np.int32) * bands.shape[1]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(s) for s in sets], type=pa.int64()),
                 pa.array(digests[:, 0]), pa.array(digests[:, 1]),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands.ravel())),
                 *[pa.array(np.ascontiguousarray(planes[:, i])) for i in range(len(PLANES))]],
                names=["doc_id", "n_shingles", "s1", "s2", "bands", *PLANES])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, _SIGNATURE)


def _digested(texts: list[str], width: int) -> tuple[list[np.ndarray], np.ndarray]:
    sets = shingles.shingle_sets(texts, width)
    return sets, np.array([shingles.set_digest(x) for x in sets], dtype=np.int64).reshape(-1, 2)


def full_sets(docs: DataFrame, classes: DataFrame, size: int, width: int) -> DataFrame:
    """``id, values``: the shingle sets of the classes ``rep, least, s1, s2``, from rows of their smallest doc_id.

    A doc_id that repeats may stand for several texts, so a row counts for a class only
    if its set has the class's digest; a row that repeats gives its set again.
    """
    def run(batches):
        for part, texts in text_chunks(batches, most=shingles.CHUNK_BYTES):
            sets, digests = _digested(texts, width)
            own = np.column_stack([part.column(i).to_numpy() for i in (2, 3)]) if part.num_rows else digests
            at = np.flatnonzero((own == digests).all(axis=1))
            sets = [sets[i] for i in at]
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            values = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(at)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))],
                names=["id", "values"])

    wanted = broadcast_if(classes.select(F.col("least").alias("doc_id"), F.col("rep").alias("id"), "s1", "s2"), size,
                          MOST_BROADCAST_IDS // 2)
    named = (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(wanted, "doc_id")
             .select("id", "text", "s1", "s2"))
    return named.mapInArrow(run, "id bigint, values array<bigint>")


class _Links:
    """The linking of class representatives: buckets, signatures, sets, confirmed links."""

    def __init__(self, docs: DataFrame, width: int, threshold: int):
        self.spark, self.threshold = docs.sparkSession, threshold
        self.least = least_agreeing(threshold / 100)
        self.rows = materialise(self.spark, signatures(docs, width), "near_signatures")
        shingled = self.rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
        # a class is known by a number of its own; doc_ids may repeat
        self.classes = materialise(self.spark, shingled.groupBy("s1", "s2").agg(F.min("doc_id").alias("least"))
                                   .withColumn("rep", F.monotonically_increasing_id()), "near_classes")
        reps = (shingled.join(self.classes, ["s1", "s2"]).where("doc_id = least").dropDuplicates(["s1", "s2"]))
        banded = reps.select("rep", F.explode("bands").alias("key"))
        shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        # only buckets of two classes and more, with the signatures of those in them
        buckets = materialise(self.spark, banded.join(shared, "key").select("key", "rep"), "near_shared")
        self.bucket_files = buckets.count() // ROWS_A_FILE + 1
        self.buckets = materialise(self.spark, buckets, "near_buckets", self.bucket_files)
        members = materialise(self.spark, self.buckets.select("rep").distinct(), "near_members", self.bucket_files)
        self.members = members.count()
        self.files = self.members // ROWS_A_FILE + 1
        self.planes = materialise(self.spark, reps.join(members, "rep").select(
            F.col("rep").alias("id"), "n_shingles", *PLANES), "near_planes", 4 * self.files)
        self.sets = materialise(self.spark, full_sets(docs, self.classes.join(members, "rep"), self.members, width),
                                "near_sets")
        if self.sets.count() > self.members:
            self.sets = materialise(self.spark, self.sets.dropDuplicates(["id"]), "near_sets")
        self.nodes = members.select(F.col("rep").alias("node"))
        self.links = self.near = self._none()        # confirmed, and those that pass the bit-count test
        self.labels = self.families = self.nodes.withColumn("component", F.col("node"))

    def _none(self) -> DataFrame:
        return self.spark.createDataFrame([], "a bigint, b bigint")

    def _labelled(self, edges: DataFrame, name: str) -> DataFrame:
        found = broadcast_if(components(edges, self.files), self.members, MOST_BROADCAST_IDS)
        return materialise(self.spark, self.nodes.join(found, "node", "left").select(
            "node", F.coalesce("component", "node").alias("component")), name, self.files)

    def _confirm(self, pairs: DataFrame, step: str) -> int:
        """Confirm on the full sets; the new links' number."""
        x = self.sets.select(F.col("id").alias("a"), F.col("values").alias("va"))
        y = self.sets.select(F.col("id").alias("b"), F.col("values").alias("vb"))
        both = F.size(F.array_intersect("va", "vb"))
        union = F.size("va") + F.size("vb") - both
        found = materialise(self.spark, pairs.join(x, "a").join(y, "b").where(
            both * 100 >= union * self.threshold).select("a", "b"), f"near_links_{step}", self.files)
        return self._linked(found)

    def _linked(self, found: DataFrame) -> int:
        new = found.count()
        if new:
            self.links = self.links.unionByName(found)
            self.labels = self._labelled(self.links, "near_labels")
        return new

    def _open(self, labels: DataFrame, *more: str) -> DataFrame:
        """``key, rep, label, size`` in buckets of several labels, with the columns ``more`` of ``labels``.

        A class lies in up to 32 buckets, so what is known of a class is joined to its one
        row in ``labels``, and the rows of buckets pass this one join only.
        """
        labels = broadcast_if(labels, self.members, MOST_BROADCAST_IDS)
        labelled = self.buckets.join(labels, F.col("rep") == F.col("node")).select(
            "key", "rep", F.col("component").alias("label"), *more)
        several = (labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"),
                                               F.count(F.lit(1)).alias("size")).where("lo <> hi"))
        return labelled.join(several, "key").select("key", "rep", "label", "size", *more)

    def leader_round(self, number: int, apart: DataFrame | None = None) -> int:
        """Compare each bucket's members with one leader of another component.

        The leader is the one whose share of shingles of its own (``rep, share`` in
        ``apart``) is smallest, or without that one by a hash that changes from round to round.
        """
        salt = F.lit((0x9E3779B97F4A7C1 * number) & 0x7FFFFFFFFFFFFFFF)      # round 0: the smallest
        ranked = self.labels.withColumn("share", F.lit(0.0)) if apart is None else self.labels.join(
            broadcast_if(apart.select(F.col("rep").alias("node"), "share"), self.members, MOST_BROADCAST_IDS), "node")
        opened = materialise(self.spark, self._open(ranked, "share"), f"near_open_{number}", self.bucket_files)
        leaders = (opened.groupBy("key").agg(F.min(F.struct("share", F.col("rep").bitwiseXOR(salt).alias("r"))).alias("least"))
                   .select("key", F.col("least.r").bitwiseXOR(salt).alias("leader"))
                   .join(self.labels.select(F.col("node").alias("leader"), F.col("component").alias("own")), "leader"))
        pairs = opened.join(leaders, "key").where("label <> own").select("rep", "leader").distinct()
        passing = materialise(self.spark, (
            pairs.join(self.planes.alias("x"), F.col("rep") == F.col("x.id"))
            .join(self.planes.alias("y"), F.col("leader") == F.col("y.id"))
            .withColumn("agree", agreeing("x", "y")).where(F.col("agree") >= self.least)
            .select("rep", "leader", "agree")), f"near_passing_{number}", self.files)
        self.near = self.near.unionByName(passing.select(F.col("rep").alias("a"), F.col("leader").alias("b")))
        best = passing.groupBy("rep").agg(F.max(F.struct("agree", (-F.col("leader")).alias("leader"))).alias("best"))
        return self._confirm(best.select(F.col("rep").alias("a"), (-F.col("best.leader")).alias("b")), str(number))

    def settle(self) -> tuple[int, DataFrame]:
        """Take the classes out of the buckets that no class of an open bucket can link with.

        Returns how many went, and of those that stay (``rep, share``) the share of shingles
        that no other open class has.
        """
        opened = materialise(self.spark, self._open(self.labels).select("rep").distinct(), "near_unsettled", self.files)
        size = opened.count()
        wanted = broadcast_if(opened.withColumnRenamed("rep", "id"), size, MOST_BROADCAST_IDS)
        sets = self.sets.join(wanted, "id", "left_semi")
        alone = (sets.select("id", F.explode("values").alias("v"))
                 .groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("rep")).where("n = 1")
                 .groupBy("rep").agg(F.count(F.lit(1)).alias("alone")))
        apart = materialise(self.spark, (
            self.planes.select(F.col("id").alias("rep"), "n_shingles").join(
                broadcast_if(opened, size, MOST_BROADCAST_IDS), "rep")
            .join(alone, "rep", "left").withColumn("alone", F.coalesce("alone", F.lit(0)))
            .where((F.col("n_shingles") - F.col("alone")) * 100 >= F.col("n_shingles") * self.threshold)
            .select("rep", (F.col("alone") / F.col("n_shingles")).alias("share"))), "near_apart", self.files)
        stay = apart.count()
        self.buckets = materialise(self.spark, self.buckets.join(
            broadcast_if(apart.select("rep"), stay, MOST_BROADCAST_IDS), "rep", "left_semi").select("key", "rep"),
            "near_buckets", self.bucket_files)
        return size - stay, apart

    def _dealt(self, rows: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
        """Rows ``key, rep, label, n_shingles`` of groups (``key``) dealt to blocks ``key, s, i, j``.

        ``s`` is a size class; a row stands at home in its own and as a visitor in the next, which
        is where all sizes meet it that can reach the threshold.  In each (key, s) with several
        labels the rows outside the most frequent one are the first result, all rows the second;
        every row of the one meets every row of the other in exactly one block.
        """
        # a class is a little wider than the ratio of sizes that can link, so rounding does no harm
        own = F.floor(F.log(F.col("n_shingles").cast("double")) / F.log(F.lit(100.0 / (self.threshold - 1)))).cast("int")
        rows = rows.withColumn("at", F.explode(F.array(F.struct(own.alias("s"), F.lit(True).alias("home")),
                                                       F.struct((own + 1).alias("s"), F.lit(False).alias("home")))))
        rows = rows.select("key", "rep", "label", "at.s", "at.home")
        sizes = rows.groupBy("key", "s", "label").agg(F.count(F.lit(1)).alias("n"))
        several = (sizes.groupBy("key", "s").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("size"),
                                                 F.count(F.lit(1)).alias("labels")).where("labels > 1")
                   .select("key", "s", F.col("top.label").alias("main"),
                           F.ceil(F.col("size") / block).cast("int").alias("na"),
                           F.ceil((F.col("size") - F.col("top.n")) / block).cast("int").alias("ns")))
        rows = materialise(self.spark, rows.join(several, ["key", "s"]), "near_dealt", 2 * self.bucket_files)

        def hashed(n, salt):
            return F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(n)).cast("int")

        outside = rows.where("label <> main").withColumns({
            "i": hashed("ns", 2), "j": F.explode(F.sequence(F.lit(0), F.col("na") - 1))})
        every = rows.withColumns({"j": hashed("na", 1), "i": F.explode(F.sequence(F.lit(0), F.col("ns") - 1))})
        return outside, every

    def close_families(self) -> None:
        """Join families until no bucket holds a pair of two families that passes the bit-count test."""
        while True:
            self.families = self._labelled(self.near.unionByName(self.links), "near_families")
            sizes = self.planes.select(F.col("id").alias("node"), "n_shingles")
            sized = self.families.join(broadcast_if(sizes, self.members, MOST_BROADCAST_IDS), "node")
            rest = materialise(self.spark, self._open(sized, "n_shingles"), "near_open_families", self.bucket_files)
            outside, every = (side.join(self.planes.drop("n_shingles"), F.col("rep") == F.col("id")).drop("id")
                              for side in self._dealt(rest, BLOCK))
            x, y = outside.alias("x"), every.alias("y")
            same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("key", "s", "i", "j")]
            pairs = x.join(y, reduce(Column.__and__, same) & (F.col("x.label") != F.col("y.label"))
                           & (F.col("x.home") | F.col("y.home")) & (agreeing("x", "y") >= self.least))
            # one pair of each two families is enough to join them
            found = materialise(self.spark, pairs.groupBy(
                F.least("x.label", "y.label").alias("a"), F.greatest("x.label", "y.label").alias("b"))
                .count().select("a", "b"), "near_families_joined", self.files)
            if not found.count():
                break
            self.near = self.near.unionByName(found)

    def compare_families(self) -> None:
        """Compare all members of different components within a family, in blocks.

        What ``settle`` took out of the buckets has no link left to find.
        """
        unsettled = self._open(self.labels).select(F.col("rep").alias("node")).distinct()
        rows = self.labels.join(self.families.select("node", F.col("component").alias("family")), "node").join(
            broadcast_if(unsettled, self.members, MOST_BROADCAST_IDS), "node", "left_semi")
        sizes = self.planes.select(F.col("id").alias("node"), "n_shingles")
        rows = rows.join(broadcast_if(sizes, self.members, MOST_BROADCAST_IDS), "node").select(
            F.col("family").alias("key"), F.col("node").alias("rep"), F.col("component").alias("label"), "n_shingles")
        outside, every = self._dealt(rows, FAMILY_BLOCK)
        tasks = rows.count() // FAMILY_BLOCK + 1
        # groups of one block share tasks
        task = F.when(F.col("na") > 1, F.col("key")).otherwise(F.pmod(F.xxhash64("key", "s"), F.lit(tasks)))
        placed = outside.withColumn("side", F.lit(True)).unionByName(every.withColumn("side", F.lit(False))).select(
            task.alias("task"), F.when(F.col("na") > 1, F.col("s")).otherwise(-1).alias("large"), "i", "j", "side",
            F.col("key").alias("family"), "s", "home", F.col("label").alias("component"), F.col("rep").alias("node"))
        placed = (placed.join(self.planes.withColumnRenamed("id", "node"), "node")
                  .join(self.sets.withColumnRenamed("id", "node"), "node"))
        self._linked(materialise(self.spark, placed.groupBy("task", "large", "i", "j").applyInPandas(
            _block_links(self.least, self.threshold), "a bigint, b bigint"), "near_links_rest"))


def _block_links(least: int, threshold: int):
    """For ``applyInPandas``: links between rows of ``side`` and the others, one for two components."""
    def run(block: pd.DataFrame) -> pd.DataFrame:
        s, a = block[block["side"]], block[~block["side"]]
        out = []
        planes_s, planes_a = (x[PLANES].to_numpy(dtype=np.int64).view(np.uint64) for x in (s, a))
        values = [np.asarray(v, dtype=np.int64) for v in a["values"]]
        sizes = np.array([len(v) for v in values], dtype=np.int64)
        words = HASHES // 64
        family, level, home, component, node = (a[c].to_numpy() for c in ("family", "s", "home", "component", "node"))
        for row, own, f, p, h, c, v in zip(planes_s, *(s[x] for x in ("node", "family", "s", "home", "component", "values"))):
            differ = np.zeros(len(a), dtype=np.int64)
            for w in range(words):
                x = planes_a[:, w::words] ^ row[w::words]
                differ += np.bitwise_count(np.bitwise_or.reduce(x, axis=1))
            at = np.flatnonzero((HASHES - differ >= least) & (family == f) & (level == p) & (home | h) & (component != c))
            if not len(at):
                continue
            mine = np.sort(np.asarray(v, dtype=np.int64))
            theirs = np.concatenate([values[k] for k in at])
            place = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
            starts = np.concatenate(([0], np.cumsum(sizes[at])[:-1]))
            both = np.add.reduceat((mine[place] == theirs).astype(np.int64), starts)
            linked = at[both * 100 >= (len(mine) + sizes[at] - both) * threshold]
            _, first = np.unique(component[linked], return_index=True)
            out += [(own, node[k]) for k in linked[first]]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def near_links(docs: DataFrame, width: int = 5, threshold: int = 80) -> _Links:
    """Link the classes of ``docs``; ``threshold`` is the similarity in hundredths."""
    links = _Links(docs, width, threshold)
    for number in range(ROUNDS):
        if not links.leader_round(number):
            break
    for number in range(ROUNDS, ROUNDS + SETTLINGS):
        gone, apart = links.settle()
        if not links.leader_round(number, apart) and not gone:
            break
    links.close_families()
    links.compare_families()
    return links


def _grouped(links: _Links) -> DataFrame:
    """Each row's ``doc_id, n_shingles, s1, s2, label, component_id`` (label: of the component, by number)."""
    named = links.classes.join(broadcast_if(links.labels, links.members, MOST_BROADCAST_IDS),
                               F.col("rep") == F.col("node"), "left").drop("node")
    low = named.where("component IS NOT NULL").groupBy("component").agg(F.min("least").alias("low"))
    named = named.join(broadcast_if(low, links.members, MOST_BROADCAST_IDS), "component", "left").select(
        "s1", "s2", F.coalesce("component", "rep").alias("label"), F.coalesce("low", "least").alias("_component"))
    own = F.when(F.col("n_shingles") > 0, F.col("_component")).otherwise(F.col("doc_id"))
    return (links.rows.select("doc_id", "n_shingles", "s1", "s2").join(named, ["s1", "s2"], "left")
            .withColumn("component_id", own).drop("_component"))


def near_groups(docs: DataFrame, width: int = 5, threshold: int = 80) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``."""
    return _grouped(near_links(docs, width, threshold)).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def near_dedup(docs: DataFrame, width: int = 5, threshold: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they were: one of each component, with its smallest doc_id.

    Rows without a doc_id and rows without a shingle all stay.
    """
    spark = docs.sparkSession
    groups = materialise(spark, _grouped(near_links(docs, width, threshold)).where("doc_id IS NOT NULL").select(
        F.col("doc_id").alias("_id"), "s1", "s2", "label", "n_shingles",
        (F.col("doc_id") == F.col("component_id")).alias("kept")), "near_decided")
    decided = groups.groupBy("_id").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    decided = materialise(spark, decided.where("NOT kept OR n > 1"), "near_decided")
    dropped = decided.select("_id")
    rows = packed(docs).withColumn("_id", F.col("_row.doc_id").cast("bigint"))
    stay = rows.join(broadcast_if(dropped, dropped.count(), MOST_BROADCAST_IDS), "_id", "left_anti")
    repeated = decided.where("kept AND n > 1").select("_id")
    if times := repeated.count():
        # a doc_id that repeats may stand for several texts: its rows are decided by their sets
        again = broadcast_if(repeated, times, MOST_BROADCAST_IDS)
        decisions = groups.where("kept").join(again, "_id", "left_semi").select("_id", "s1", "s2", "label", "n_shingles").distinct()
        found = _with_digests(rows.join(again, "_id", "left_semi"), width).join(decisions, ["_id", "s1", "s2"])
        stay = stay.unionByName(found.where("n_shingles > 0").dropDuplicates(["label"]).select(*stay.columns)).unionByName(
            found.where("n_shingles = 0").select(*stay.columns))
    return stay.select("_row.*")


def _with_digests(rows: DataFrame, width: int) -> DataFrame:
    """``rows`` with ``s1, s2``, the digest of the shingles of ``_row.text``."""
    columns = rows.columns

    def run(batches):
        for part, texts in text_chunks(batches, "_text", shingles.CHUNK_BYTES):
            _, digests = _digested(texts, width)
            yield pa.RecordBatch.from_arrays(
                [part.column(i + 1) for i in range(len(columns))] + [pa.array(digests[:, i]) for i in (0, 1)],
                names=[*columns, "s1", "s2"])

    schema = T.StructType([*rows.schema.fields, T.StructField("s1", T.LongType()), T.StructField("s2", T.LongType())])
    return rows.select(F.col("_row.text").alias("_text"), *columns).mapInArrow(run, schema)


# The contract's query (two words, 0.8) in DuckDB SQL.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) >= 2 THEN
           list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) ELSE ws END AS ss
  FROM w
), n AS (SELECT doc_id, CAST(len(ss) AS BIGINT) AS n FROM s
), u AS (SELECT doc_id, unnest(ss) AS x FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS c FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * c >= 80 * (na.n + nb.n - c)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT doc_id AS d, doc_id AS c FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.d
), m AS (SELECT d, MIN(c) AS c FROM r GROUP BY d)
SELECT n.doc_id, n.n AS n_shingles, m.c AS component_id, n.doc_id = m.c AS kept
FROM n JOIN m ON m.d = n.doc_id
"""
