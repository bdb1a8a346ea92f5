"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text's units are its words (what stands between white space); a run of more than
``LONG`` code points without white space counts as that many units of one code
point.  The text is cut into paragraphs after every unit at which the hash of it and
the unit before falls in a fixed share, one in ``SPACING``, and every ``MOST`` units
where no such cut comes sooner, so that repeated words are cut as well.  The rule
is the same for texts of any length and looks at what stands beside a cut only, so
equal stretches have equal paragraphs wherever they stand, and a change moves only
the cuts beside it.  The 64-bit digests of the paragraphs go into a sketch of
``CELLS`` cells, which is the fingerprint; a paragraph that stands several times has
a digest for each time.  The kind and amount of white space between words makes no
difference.

Two versions are compared by subtracting their fingerprints; peeling the rest
recovers the digests that only one of them has.  Where the sketch is too small
for the difference, larger ones are taken: ``ROOM`` cells in two parts for each
paragraph of both versions (nearly every key is alone in a cell, so nearly all are
peeled at once; only cells in use are listed), then twice and four times that,
each with other cell hashes.  (Should
all fail, which takes several keys with the same cells in each, the digest
sets are compared themselves.)  The likeness is the share of paragraphs in common,
1 - |difference| / (|A| + |B|); two texts without paragraphs have likeness 1.

Edge cases: a NULL text counts as empty.  Rows that repeat a doc_id stand in
the order as one document; a predecessor sees the one with the smallest lent
beginning (by digests where those are equal).  A NULL doc_id stands after the smallest doc_id.  A single document is its
own successor.  An empty table gives an empty result.  Extra columns are
ignored.

Only DataFrame functions are used; there is no Python on the executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, text_of
from .iblt import encoded, let, peeled, peeled_difference, sketch, subtracted

WHITE = r"[\x20\x09-\x0D]+"
LONG = 24                    # code points of a word; longer runs count by code points
SPACING = 8                  # units a paragraph, on average
MOST = 32                    # units a paragraph, at most
CELLS = 24
ROOM = 24                    # cells for each paragraph in a larger sketch
NO_ID = -(1 << 63)           # stands for a NULL doc_id: after all others in descending order


def _units(text: Column) -> Column:
    words = F.array_remove(F.split(text, WHITE, -1), "")
    return F.when(text.rlike(rf"[^\x20\x09-\x0D]{{{LONG + 1}}}"), F.flatten(F.transform(
        words, lambda w: F.when(F.length(w) > LONG, F.array_remove(F.split(w, ""), "")).otherwise(F.array(w))))
    ).otherwise(words)


def _slices(values: Column, starts: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of the slices of ``values`` that begin at ``starts``."""
    return let(starts, lambda at: F.transform(at, lambda i, j: body(
        F.slice(values, i + 1, F.coalesce(F.get(at, j + 1), F.size(values)) - i))))


def _starts(units: Column) -> Column:
    """Where paragraphs start: the first unit, those after a cut, and every ``MOST`` units from there."""
    cuts = F.filter(F.sequence(F.lit(0), F.size(units) - 1), lambda i: (i == 0) | (F.pmod(
        F.xxhash64(F.get(units, i - 2), F.get(units, i - 1)), F.lit(SPACING)) == 0))
    return let(cuts, lambda at: F.flatten(F.transform(at, lambda i, j: F.sequence(
        i, F.coalesce(F.get(at, j + 1), F.size(units)) - 1, F.lit(MOST)))))


def _numbered(found: Column) -> Column:
    """Digests made distinct: the second and later ones of equal digests by their occurrence number."""
    def groups(ordered):
        firsts = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda i: (i == 0) | (
            F.get(ordered, i) != F.get(ordered, i - 1)))
        return F.flatten(_slices(ordered, firsts, lambda same: F.transform(
            same, lambda k, n: F.when(n == 0, k).otherwise(F.xxhash64(k, n)))))

    return let(found, lambda every: F.when(F.size(F.array_distinct(every)) == F.size(every), every).otherwise(
        let(F.sort_array(every), groups)))


def digests(text: Column) -> Column:
    """The 64-bit digests of a text's paragraphs, each a different number."""
    return let(_units(text), lambda units: F.when(F.size(units) > 0, _numbered(
        _slices(units, _starts(units), F.xxhash64))).otherwise(F.array().cast("array<bigint>")))


def fingerprint(keys: Column) -> Column:
    return encoded(sketch(keys, CELLS), CELLS)


def differing(a: Column, b: Column, sketch_a: Column, sketch_b: Column) -> Column:
    """The digests (``k``) that only one version has; ``n`` is 1 for the first's, -1 for the second's."""
    def larger(times: int, salt: int) -> Column:
        size = F.greatest(F.lit(3 * CELLS), (F.size(a) + F.size(b)) * F.lit(times))
        return let(size, lambda s: peeled_difference(a, b, s, salt, 2))

    only = lambda x, y, n: F.transform(F.array_except(x, y), lambda k: F.struct(
        k.alias("k"), F.lit(n).alias("n")))
    return F.coalesce(peeled(subtracted(sketch_a, sketch_b), CELLS), larger(ROOM, 1), larger(2 * ROOM, 2), larger(4 * ROOM, 3),
                      F.concat(only(a, b, 1), only(b, a, -1)))


def likeness(a: Column, b: Column, found: Column) -> Column:
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(F.lit(1.0) - F.size(found) / total)


def successors(docs: DataFrame) -> DataFrame:
    """``key, next``: each doc_id and the next one in descending order, the last one's the first.

    The ids are range-partitioned and written with their range's number; within a
    range the next id is the next row, and a range's last id has the first of the
    following range.  Only one row per range crosses the ranges.
    """
    ids = docs.select(_key().alias("key")).distinct()
    ranged = materialise(docs.sparkSession, ids.repartitionByRange(F.desc("key"))
                         .withColumn("part", F.spark_partition_id()), "fingerprint_ids")
    heads = ranged.groupBy("part").agg(F.max("key").alias("head"))
    onward = Window.orderBy("part")                                # one row per range
    heads = heads.select("part", F.coalesce(F.lead("head").over(onward), F.max("head").over(
        onward.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("following"))
    within = Window.partitionBy("part").orderBy(F.desc("key"))
    return (ranged.withColumn("next", F.lead("key").over(within))
            .join(F.broadcast(heads), "part")                      # one row per range
            .select("key", F.coalesce("next", "following").alias("next")))


def _key() -> Column:
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID))


def versions(docs: DataFrame) -> DataFrame:
    """``doc_id, text, keys, edited, next_keys``: each row's digests and edited text, its successor's digests.

    The edited text has the last third replaced by as much of the successor's
    beginning.  Only that beginning and the digests travel to the row.
    """
    # digests are made once, before the shuffle that all joins read
    rows = (docs.select(_key().alias("key"), "doc_id", text_of().alias("text"))
            .withColumn("keys", digests(F.col("text"))))
    # the longest row of a doc_id sets how much its successor must lend
    wanted = rows.groupBy("key").agg(F.max(F.floor(F.length("text") / 3)).cast("int").alias("most"))
    lend = (successors(docs).join(wanted, "key")
            .select(F.col("key").alias("borrower"), F.col("next").alias("key"), "most"))
    # only the beginning and the digests go on to the borrower; taking doc_id along lets this
    # join and the last one read one and the same shuffle of the rows
    lent = (rows.join(lend, "key")
            .select("borrower", F.struct(F.expr("substring(text, 1, most)").alias("front"),
                                         "keys", "doc_id").alias("lent"))
            .groupBy("borrower").agg(F.min("lent").alias("low"))
            .select(F.col("borrower").alias("key"), F.col("low.front").alias("front"),
                    F.col("low.keys").alias("next_keys")))
    cut = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cut)"), F.expr("substring(front, 1, cut)"))
    return (rows.join(lent, "key").withColumn("cut", cut)
            .select("doc_id", "text", "keys", edited.alias("edited"), "next_keys"))


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    n_paragraphs, n_differing`` (digests in one of text and edited text only)."""
    rows = versions(docs).select(
        "doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        "keys", digests(F.col("edited")).alias("edited_keys"), "next_keys")
    for name in ("keys", "edited_keys", "next_keys"):
        rows = rows.withColumn(f"{name}_sketch", sketch(F.col(name), CELLS))
    own, edited, following = F.col("keys"), F.col("edited_keys"), F.col("next_keys")
    rows = rows.withColumns({
        "from_edited": differing(own, edited, F.col("keys_sketch"), F.col("edited_keys_sketch")),
        "from_next": differing(own, following, F.col("keys_sketch"), F.col("next_keys_sketch"))})
    return rows.select(
        "doc_id", "n_chars", "edited_sha256",
        encoded(F.col("keys_sketch"), CELLS).alias("fingerprint"),
        encoded(F.col("edited_keys_sketch"), CELLS).alias("edited_fingerprint"),
        likeness(own, edited, F.col("from_edited")).alias("near_edited"),
        likeness(own, following, F.col("from_next")).alias("near_next"),
        F.size(own).cast("bigint").alias("n_paragraphs"), F.size("from_edited").cast("bigint").alias("n_differing"))
