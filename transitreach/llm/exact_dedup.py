"""Exact deduplication with a heavy-hitter split.

Texts are equal when they are identical after deleting all white space
(``[\\x20\\x09-\\x0D]``).  Of equal texts, the row with the most code points in
the original text stays, then the one with the smallest doc_id.

A digest that a large share of the rows carries would land in one task if all
digests were shuffled.  So a Misra-Gries pass (``freqItems``: a bounded counter
table per task, merged) first names every digest that may reach ``support`` of
the rows; one exact count over the named ones verifies them and finds their
winners, with partial sums per task.  The at most ``1 / support`` winners are
broadcast, and their rows are settled map-side.  The remaining digests use an
ordinary shuffle, in which no group can exceed ``support`` of the rows.

Edge cases: a NULL text counts as the empty text, and all empty texts are
equal.  A NULL doc_id sorts after every other; the row that stays may have it
only if all its equals do.  Rows that repeat the winner's doc_id all count as
kept in ``exact_groups``; ``exact_dedup`` returns one of them.  An empty table
gives an empty result.  Extra columns, whatever their names, are ignored by
``exact_groups`` and returned unchanged by ``exact_dedup``.

Only DataFrame functions are used; there is no Python on the executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE_SPACE, materialise, packed, text_of

SUPPORT = 0.001          # share of the rows from which on a digest is settled map-side


def normalised(text: Column) -> Column:
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), WHITE_SPACE, text)


def digest(text: str | Column = "text") -> Column:
    """Lower-case hex SHA-256 of the text without white space."""
    return F.sha2(normalised(text_of(text)), 256)


def _rank() -> Column:
    """The smallest of a group stays: most code points, then a doc_id, then the smallest."""
    return F.struct((-F.col("_len")).alias("l"), F.col("_id").isNull().alias("n"), F.col("_id").alias("i"))


def heavy_digests(keyed: DataFrame, support: float) -> DataFrame:
    """Verified heavy digests: ``_sha, _best, _n``, at most ``1 / support`` rows.

    ``freqItems`` misses no digest of at least ``support`` of the rows, but may
    name others; the exact count drops those.
    """
    named = keyed.stat.freqItems(["_sha"], support)
    named = named.select(F.explode("_sha_freqItems").alias("_sha"))
    counted = (keyed.join(F.broadcast(named), "_sha", "left_semi")
               .groupBy("_sha").agg(F.min(_rank()).alias("_best"), F.count(F.lit(1)).alias("_n")))
    rows = keyed.agg((F.count(F.lit(1)) * F.lit(support)).alias("least"))
    return counted.where(F.col("_n") >= rows.scalar())


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("_id"), F.length(text_of()).cast("bigint").alias("_len"),
                       digest().alias("_sha"))


def exact_groups(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    spark = docs.sparkSession
    keyed = materialise(spark, _keyed(docs), "exact_digests")
    heavy = materialise(spark, heavy_digests(keyed, support), "exact_heavy")
    hot = keyed.join(F.broadcast(heavy), "_sha")
    group = Window.partitionBy("_sha")
    cold = (keyed.join(F.broadcast(heavy.select("_sha")), "_sha", "left_anti")
            .withColumns({"_best": F.min(_rank()).over(group), "_n": F.count(F.lit(1)).over(group)}))
    columns = ["_sha", "_id", "_best", "_n"]
    return hot.select(*columns).unionByName(cold.select(*columns)).select(
        F.col("_id").alias("doc_id"), F.col("_best.i").alias("keep_id"),
        F.col("_n").alias("group_size"), F.col("_id").eqNullSafe(F.col("_best.i")).alias("kept"),
        F.col("_sha").alias("text_sha256"))


def exact_dedup(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of equal texts, all columns as they were."""
    spark = docs.sparkSession
    keyed = materialise(spark, _keyed(docs), "exact_digests")
    heavy = materialise(spark, heavy_digests(keyed, support), "exact_heavy")
    rows = packed(docs).withColumns({"_id": F.col("_row.doc_id"),
                                     "_len": F.length(text_of("_row.text")).cast("bigint"),
                                     "_sha": digest("_row.text")})
    hot = (rows.join(F.broadcast(heavy), "_sha")
           .where(F.col("_id").eqNullSafe(F.col("_best.i")) & (F.col("_len") == -F.col("_best.l")))
           .dropDuplicates(["_sha"]))
    order = Window.partitionBy("_sha").orderBy(F.desc("_len"), F.asc_nulls_last("_id"))
    cold = (rows.join(F.broadcast(heavy.select("_sha")), "_sha", "left_anti")
            .withColumn("_rn", F.row_number().over(order)).where("_rn = 1"))
    return hot.select("_row").unionByName(cold.select("_row")).select("_row.*")


# The contract's query in DuckDB SQL.
ORACLE_SQL = r"""
WITH k AS (
  SELECT doc_id, length(COALESCE(text, '')) AS n,
         sha256(regexp_replace(COALESCE(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS s
  FROM documents
), w AS (
  SELECT doc_id, s, COUNT(*) OVER (PARTITION BY s) AS group_size,
         FIRST_VALUE(doc_id) OVER (PARTITION BY s ORDER BY n DESC, doc_id ASC NULLS LAST) AS keep_id
  FROM k
)
SELECT doc_id, keep_id, group_size, (doc_id IS NOT DISTINCT FROM keep_id) AS kept, s AS text_sha256 FROM w
"""
