"""Accessibility counts: how many schools / enrolment places each area reaches.

All counts are ``groupBy`` aggregations with map-side partial aggregation, so a
block group holding a large share of the trips costs one partial row per input
partition.  Zero-filling joins the (per-area, hence bounded by the number of
areas) counts onto the area table; Spark decides broadcast vs. shuffle from the
measured size (AQE), so nothing is broadcast unchecked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import join_null_safe, semi_in, sum_or_zero
from ..params import CUTOFF_GRID, FUNCTION_DEFAULT_CUTOFF, RUNS, AccessParams

MEASURES = ("schools_accessible", "slots_accessible")


def trip_limits(trips: DataFrame, cutoff: float, transfers: int) -> DataFrame:
    """``t_time <= cutoff`` and ``t_transit <= transfers + 1`` (inclusive)."""
    return trips.where((F.col("t_time") <= F.lit(cutoff)) &
                       (F.col("t_transit") <= F.lit(transfers + 1)))


def run_predicate(run: str):
    """``if (run != "both") run == x else TRUE``."""
    return F.lit(True) if run == "both" else (F.col("run") == F.lit(run))


def accessibility_counts(trips: DataFrame, cutoff: float = FUNCTION_DEFAULT_CUTOFF,
                         select_run: str = "both", transfers: int = 5) -> DataFrame:
    """Per geoid counts before zero-filling.

    ``both`` halves the counts (a school reached in one run only counts 0.5) and
    rounds the halved places up.
    """
    t = trip_limits(trips, cutoff, transfers)
    if select_run == "both":
        return t.groupBy("geoid").agg(
            (F.count(F.lit(1)) / F.lit(2)).alias("schools_accessible"),
            F.ceil(sum_or_zero("enrolment") / F.lit(2)).alias("slots_accessible"))
    t = t.where(run_predicate(select_run))
    return t.groupBy("geoid").agg(
        F.count(F.lit(1)).alias("schools_accessible"),
        sum_or_zero("enrolment").cast("bigint").alias("slots_accessible"))


def counts_right_join(counts: DataFrame, areas: DataFrame, measures=MEASURES) -> DataFrame:
    """Keep every area; an area without trips gets 0 (``right_join`` + ``replace_na``)."""
    out = join_null_safe(areas, counts, ["geoid"], "left")
    out = out.fillna(0, subset=list(measures))
    first = ["geoid", *measures]
    return out.select(*first, *[c for c in out.columns if c not in first])


def filter_trips(trips: DataFrame, areas: DataFrame, cutoff: float = FUNCTION_DEFAULT_CUTOFF,
                 select_run: str = "both", transfers: int = 5) -> DataFrame:
    counts = accessibility_counts(trips, cutoff, select_run, transfers)
    return counts_right_join(counts, areas)


def parameter_columns(df: DataFrame, p: AccessParams, carnegie=None) -> DataFrame:
    """Attach the parameter snapshot; multi-selects are joined with ``"; "``.

    ``carnegie`` is the carnegie text as a Column (see ``schools.carnegie_text``).
    """
    if carnegie is None:
        carnegie = F.lit("; ".join(p.carnegie or ()))
    return df.withColumns({
        "time_cutoff": F.lit(p.cutoff),
        "trip_am_pm": F.lit(p.run),
        "trip_max_transfers": F.lit(p.transfers),
        "school_sizes": F.lit("; ".join(p.sizes)),
        "school_sectors": F.lit("; ".join(p.sectors)),
        "school_degree_levels": F.lit("; ".join(p.degree_levels)),
        "school_degree_types": F.lit("; ".join(p.degree_types)),
        "school_carnegie": carnegie,
    })


def accessibility_selected(trips: DataFrame, areas: DataFrame, selected_schools: DataFrame,
                           p: AccessParams, carnegie=None) -> DataFrame:
    """Counts for the selected institutions plus the parameter columns."""
    chosen = semi_in(trips, "school_id", selected_schools, "school_id")
    counts = filter_trips(chosen, areas, p.cutoff, p.run, p.transfers)
    return parameter_columns(counts, p, carnegie)


# ---------------------------------------------------------------- cutoff tables
def area_run_grid(areas: DataFrame, runs=RUNS) -> DataFrame:
    """Every (geoid, run): the areas times the (fixed, two-value) run list."""
    run_values = F.array(*[F.lit(r) for r in runs])
    return areas.select("geoid", F.explode(run_values).alias("run"))


def cutoff_counts(trips: DataFrame, grid: DataFrame, time: float) -> DataFrame:
    """Per (geoid, run): trips strictly under ``time`` and their enrolment, dense."""
    agg = (trips.where(F.col("t_time") < F.lit(time))
                .groupBy("geoid", "run")
                .agg(F.count(F.lit(1)).alias("n"),
                     sum_or_zero("enrolment").cast("bigint").alias("slots")))
    out = join_null_safe(grid, agg, ["geoid", "run"], "left").fillna(0, subset=["n", "slots"])
    return out.select("geoid", "run", "n", "slots")


def cutoff_average(blockgroups: DataFrame) -> DataFrame:
    """Per geoid over runs: ``run='average'``, mean n, ceiling of mean slots."""
    return (blockgroups.groupBy("geoid")
            .agg(F.lit("average").alias("run"),
                 F.avg("n").alias("n"),
                 F.ceil(F.avg("slots")).alias("slots")))


def cutoff_union(blockgroups: DataFrame, time: float) -> DataFrame:
    avgs = cutoff_average(blockgroups)
    runs = blockgroups.select("geoid", "run", F.col("n").cast("double").alias("n"),
                              F.col("slots").cast("bigint").alias("slots"))
    return (runs.unionByName(avgs.select("geoid", "run", "n", F.col("slots").cast("bigint")))
                .withColumn("cutoff", F.lit(time)))


def filter_time(trips: DataFrame, grid: DataFrame, time: float) -> DataFrame:
    return cutoff_union(cutoff_counts(trips, grid, time), time)


def cutoff_sweep(trips: DataFrame, grid: DataFrame, cutoffs=CUTOFF_GRID) -> DataFrame:
    """``filter_time`` for every cutoff, stacked, without repeating the trips.

    Each trip is assigned to the smallest cutoff it satisfies (``t_time < c``), one
    aggregation counts trips per (geoid, run, bucket), and a running sum over the
    ordered cutoffs gives the counts for ``t_time < c``.  The trips are scanned and
    shuffled once (partially aggregated), not once per cutoff; the window runs on
    the small per-area table, whose groups hold one row per cutoff.
    """
    cutoffs = sorted(float(c) for c in cutoffs)
    bucket = F.lit(None).cast("double")
    for c in reversed(cutoffs):
        bucket = F.when(F.col("t_time") < F.lit(c), F.lit(c)).otherwise(bucket)
    per_bucket = (trips.withColumn("cutoff", bucket).where(F.col("cutoff").isNotNull())
                  .groupBy("geoid", "run", "cutoff")
                  .agg(F.count(F.lit(1)).alias("n_b"),
                       sum_or_zero("enrolment").cast("bigint").alias("slots_b")))
    cut_values = F.array(*[F.lit(c) for c in cutoffs])
    dense = grid.select("geoid", "run", F.explode(cut_values).alias("cutoff"))
    filled = join_null_safe(dense, per_bucket, ["geoid", "run", "cutoff"], "left") \
        .fillna(0, subset=["n_b", "slots_b"])
    w = Window.partitionBy("geoid", "run").orderBy("cutoff") \
              .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = filled.select("geoid", "run", "cutoff",
                         F.sum("n_b").over(w).alias("n"),
                         F.sum("slots_b").over(w).alias("slots"))
    avgs = (runs.groupBy("geoid", "cutoff")
                .agg(F.lit("average").alias("run"), F.avg("n").alias("n"),
                     F.ceil(F.avg("slots")).cast("bigint").alias("slots")))
    return (runs.select("geoid", "run", F.col("n").cast("double").alias("n"),
                        F.col("slots").cast("bigint").alias("slots"), "cutoff")
                .unionByName(avgs.select("geoid", "run", "n", "slots", "cutoff")))


def metric_select(df: DataFrame, use_slots: bool) -> DataFrame:
    name = "slots_accessible" if use_slots else "schools_accessible"
    return df.withColumn("value", F.col(name))
