"""End-to-end batch job: batch CSVs -> legs and trips tables in Parquet.

Lineage is cut by writing each table to storage (not by local checkpoints), so
a lost executor only recomputes the current stage from the written input.  The
legs are written partitioned by run; trips are range-partitioned on (run,
t_time, odid), written partitioned by run and sorted by ``t_time`` within files,
so the dashboard's ``t_time <= cutoff`` filter skips files and row groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.legs import clean_legs
from ..operators.trips import build_trips, enrolment_join
from ..operators.validate import batch_coverage, error_pairs, od_stats
from ..session import scratch_path
from ..sources.batches import load_batches


# trips: range-partitioned by run and trip time, so each file holds one slice of
# t_time; the pair id splits a hot (run, t_time) value across tasks
TRIP_LAYOUT = ("run", "t_time", "odid")
# legs: sorted within the tasks that join them; another shuffle of rows this wide, which
# runs its join a second time to sample the bounds, costs more than it saves
LEG_ORDER = ("run", "t_time")


def write_table(df: DataFrame, path: str, partition_by=None, sort_within=None, range_by=None) -> str:
    """Write Parquet; ``range_by`` range-partitions the rows first (sampled bounds,
    so no task gets a whole low-cardinality key)."""
    w = df
    if range_by:
        w = w.repartitionByRange(*range_by)
    if sort_within:
        w = w.sortWithinPartitions(*sort_within)
    writer = w.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def run_etl(spark: SparkSession, batch_dir: str, schools: DataFrame, out_dir: str | None = None,
            max_minutes: float = 100) -> dict:
    """Load, validate, clean and flatten; returns the written paths and load checks."""
    out_dir = out_dir or scratch_path(spark, "etl")
    raw = load_batches(spark, batch_dir)
    raw_path = write_table(raw, f"{out_dir}/raw")
    raw = spark.read.parquet(raw_path)
    checks = {
        "coverage": batch_coverage(raw).first().asDict(),
        "od": od_stats(raw).first().asDict(),
        "errors": error_pairs(raw).first().asDict(),
    }
    legs = clean_legs(raw, max_minutes=max_minutes)
    legs_path = write_table(legs, f"{out_dir}/legs", partition_by=["run"], sort_within=LEG_ORDER)
    legs = spark.read.parquet(legs_path)
    trips = enrolment_join(build_trips(legs), schools)
    trips_path = write_table(trips, f"{out_dir}/trips", partition_by=["run"], sort_within=["t_time"],
                             range_by=TRIP_LAYOUT)
    return {"raw": raw_path, "legs": legs_path, "trips": trips_path, "checks": checks,
            "null_t_time": spark.read.parquet(raw_path).where(F.col("actual_departure").isNull()).count()}
