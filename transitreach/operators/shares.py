"""Leg shares by transit line and agency, and small distribution summaries.

Legs are read once: they are counted per line or agency, and the total is a window
over that small table of counts (one row per line or agency).  Top-k is ``orderBy(...).limit(k)``, planned
as ``TakeOrderedAndProject`` (per-partition top-k, then a k-row merge).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import join_null_safe

TOP_LINES = 20


def transit_legs(legs: DataFrame) -> DataFrame:
    return legs.where(F.col("l_mode") == F.lit("TRANSIT"))


def line_shares(legs: DataFrame, top: int | None = TOP_LINES) -> DataFrame:
    """Share of TRANSIT legs per non-null line, percent to 2 dp, descending.

    The sort is on the rounded percent; ties keep alphabetical line order.
    """
    counts = (transit_legs(legs).where(F.col("l_line").isNotNull())
              .groupBy("l_line").agg(F.count(F.lit(1)).alias("n")))
    total = F.sum("n").over(Window.partitionBy())
    out = counts.select(
        "l_line",
        (F.col("n") / total).alias("Freq"),
        F.bround(F.lit(100) * F.col("n") / total, 2).alias("Percent"),
        F.col("l_line").alias("Transit Route"))
    out = out.orderBy(F.col("Percent").desc(), F.col("l_line").asc())
    return out.limit(top) if top is not None else out


def agency_counts(legs: DataFrame) -> DataFrame:
    """TRANSIT legs per non-null agency, descending (ties alphabetical)."""
    counts = (transit_legs(legs).where(F.col("l_agency").isNotNull())
              .groupBy("l_agency").agg(F.count(F.lit(1)).alias("Count")))
    return (counts.withColumn("Agency", F.col("l_agency"))
                  .orderBy(F.col("Count").desc(), F.col("l_agency").asc()))


def agency_shares(legs: DataFrame) -> DataFrame:
    """The pie's percent per agency."""
    total = F.sum("Count").over(Window.partitionBy())
    return (agency_counts(legs).withColumn("percent", F.lit(100) * F.col("Count") / total)
            .orderBy(F.col("Count").desc(), F.col("l_agency").asc()))


def palette(colors: DataFrame, key: str, name: str) -> DataFrame:
    """One colour per key (the smallest), so that a repeated key cannot multiply rows."""
    return colors.groupBy(F.col(key).alias(name)).agg(F.min("l_color").alias("l_color"))


def line_chart_feed(legs: DataFrame, colors: DataFrame, top: int = TOP_LINES) -> DataFrame:
    shares = line_shares(legs, top)
    out = join_null_safe(shares, palette(colors, "l_line", "Transit Route"), ["Transit Route"], "left")
    return out.orderBy(F.col("Percent").desc(), F.col("l_line").asc())        # a join keeps no order


def agency_chart_feed(legs: DataFrame, colors: DataFrame) -> DataFrame:
    counts = agency_counts(legs)
    out = join_null_safe(counts, palette(colors, "l_agency", "Agency"), ["Agency"], "left")
    return out.orderBy(F.col("Count").desc(), F.col("l_agency").asc())


def sort_desc(df: DataFrame, column: str, tie_break: str) -> DataFrame:
    return df.orderBy(F.col(column).desc(), F.col(tie_break).asc())


def top_k(df: DataFrame, column: str, k: int, tie_break: str) -> DataFrame:
    return sort_desc(df, column, tie_break).limit(k)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, descending; NULL is not counted (pandas ``value_counts``)."""
    return (df.where(F.col(column).isNotNull()).groupBy(column)
              .agg(F.count(F.lit(1)).alias("count"))
              .orderBy(F.col("count").desc(), F.col(column).asc()))


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Equal-width bins between the column's min and max; the last bin is closed.

    The bounds are one scalar subquery; the bin index is a column expression and the
    counts one aggregation, so the column is never collected.
    """
    vals = df.where(F.col(column).isNotNull())
    bounds = vals.select(F.struct(F.min(column).alias("lo"), F.max(column).alias("hi"))).scalar()
    lo, hi = bounds["lo"], bounds["hi"]
    width = (hi - lo) / F.lit(bins)
    idx = F.least(F.floor((F.col(column) - lo) / (hi - lo) * F.lit(bins)).cast("bigint"),
                  F.lit(bins - 1).cast("bigint"))
    idx = F.when(hi == lo, F.lit(0).cast("bigint")).otherwise(idx)
    counts = vals.select(idx.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    spark = df.sparkSession
    grid = spark.range(bins).select(F.col("id").alias("bin"))
    out = join_null_safe(grid, counts, ["bin"], "left").fillna(0, subset=["count"])
    return out.select(
        "bin",
        (lo + F.col("bin") * width).alias("bin_start"),
        (lo + (F.col("bin") + 1) * width).alias("bin_end"),
        "count")
