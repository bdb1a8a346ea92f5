"""Load-time checks on the stacked batches: coverage, pair counts, failed pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import count_distinct_with_null

EXPECTED_DESTINATIONS = 126


def batch_coverage(stack: DataFrame, expected: int = EXPECTED_DESTINATIONS) -> DataFrame:
    """Sum over files of each file's index-range width, against the expected total.

    The width is constant within a file, so ``max`` picks it deterministically.  A
    file whose name does not parse contributes a NULL width and makes the total NULL,
    which is reported as a failed validation rather than silently skipped.
    """
    per_file = stack.groupBy("source_filename").agg(F.max("source_coverage").alias("coverage"))
    return per_file.agg(
        F.when(F.count_if(F.col("coverage").isNull()) > 0, F.lit(None).cast("bigint"))
         .otherwise(F.sum("coverage")).cast("bigint").alias("total_coverage"),
        F.count(F.lit(1)).alias("n_files"),
        F.count_if(F.col("coverage").isNull()).alias("n_unparsed_files"),
    ).withColumns({
        "expected": F.lit(expected),
        "valid": F.coalesce(F.col("total_coverage") == F.lit(expected), F.lit(False)),
        "missing": F.lit(expected) - F.col("total_coverage"),
    })


def od_stats(stack: DataFrame) -> DataFrame:
    """Distinct origins, destinations and pairs; NULL counts as a value."""
    pairs = stack.select("origin", "destination").distinct()      # counted on pairs, not on rows
    return pairs.agg(
        count_distinct_with_null("origin").alias("n_origin"),
        count_distinct_with_null("destination").alias("n_destination"),
        F.count(F.lit(1)).alias("n_pairs"),
    )


def error_pairs(stack: DataFrame) -> DataFrame:
    """Pairs with at least one ``duration == "-999"`` row, and their percentage.

    ``sum(duration == "-999")`` without ``na.rm`` is NULL for a pair with a missing
    duration, and ``NULL > 0`` is not counted, as in the source analysis.
    """
    per_pair = stack.groupBy("origin", "destination").agg(
        F.when(F.count_if(F.col("duration").isNull()) > 0, F.lit(None).cast("long"))
         .otherwise(F.count_if(F.col("duration") == F.lit("-999"))).alias("errors"))
    return per_pair.agg(
        F.count_if(F.col("errors") > 0).alias("n_errors"),
        F.count(F.lit(1)).alias("n_pairs"),
    ).withColumn("pct_errors", F.bround(F.lit(100) * F.col("n_errors") / F.col("n_pairs"), 2))
