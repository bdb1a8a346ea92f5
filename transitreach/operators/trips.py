"""Legs -> trips (one row per odid and run)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parse as P
from ..functions.columns import join_null_safe
from .legs import HELPER_COLUMNS, LEG_COLUMNS, MAX_TRIP_MINUTES, RAW_PARSED_COLUMNS, parse_leg_rows

# ---- Fixed values: leg modes and vehicle types counted per trip ----
MODE_COUNTS = (("t_walking", "WALKING"), ("t_transit", "TRANSIT"))
VEHICLE_COUNTS = (
    ("t_bus", "BUS"),
    ("t_ferry", "FERRY"),
    ("t_heavyrail", "HEAVY_RAIL"),
    ("t_subway", "SUBWAY"),
    ("t_tram", "TRAM"),
)
TRIP_KEYS = ("odid", "run")


def flatten_trips(legs: DataFrame, keys=TRIP_KEYS) -> DataFrame:
    """Per trip: highest leg number and leg counts by mode and vehicle.

    ``keys=("odid",)`` reproduces grouping by pair only, which adds the two runs'
    legs together.  Partial aggregation runs map-side, so a hot key costs one row
    per input partition in the shuffle.
    """
    return legs.groupBy(*keys).agg(*_leg_counts())


def _leg_counts() -> list[Column]:
    aggs = [F.max("l_number").alias("t_nlegs")]
    aggs += [F.count_if(F.col("l_mode") == F.lit(v)).alias(n) for n, v in MODE_COUNTS]
    return aggs + [F.count_if(F.col("l_vehicle") == F.lit(v)).alias(n) for n, v in VEHICLE_COUNTS]


def _trip_columns(legs: DataFrame) -> list[str]:
    return [c for c in legs.columns if not c.lower().startswith("l_")]


def distinct_trips(legs: DataFrame) -> DataFrame:
    """``unique(select(legs, -starts_with("l_")))`` (prefix match ignores case)."""
    return legs.select(*_trip_columns(legs)).distinct()


def build_trips(legs: DataFrame, keys=TRIP_KEYS) -> DataFrame:
    """``flatten_trips`` joined to ``distinct_trips``.

    Legs are read once: their counts are taken per distinct trip row (map-side first), and
    the windows that sum these up to the keys run over those rows, not over legs.
    """
    columns = _trip_columns(legs)
    key_rows = Window.partitionBy(*keys)
    trips = legs.groupBy(*columns).agg(*_leg_counts())
    trips = trips.withColumns({"t_nlegs": F.max("t_nlegs").over(key_rows), **{
        n: F.sum(n).over(key_rows) for n, _ in (*MODE_COUNTS, *VEHICLE_COUNTS)}})
    trips = trips.withColumns({
        "school_id": P.orient_school("origin", "destination", "run"),
        "geoid": P.orient_geoid("origin", "destination", "run"),
    })
    return _ordered(trips)


def _ordered(trips: DataFrame) -> DataFrame:
    front = ["odid", "origin", "destination", "school_id", "geoid", "run"]
    count_cols = ["t_nlegs"] + [n for n, _ in MODE_COUNTS] + [n for n, _ in VEHICLE_COUNTS]
    source_cols = [c for c in trips.columns if c.startswith("source")]
    rest_cols = [c for c in trips.columns if c not in front + count_cols + source_cols]
    return trips.select(*front, *count_cols, *rest_cols, *source_cols)


def trips_of_rows(raw: DataFrame, max_minutes: float = MAX_TRIP_MINUTES, roll_midnight: bool = False) -> DataFrame:
    """``build_trips(clean_legs(raw))`` where the legs are not wanted, with the rows parsed once.

    A trip row's own columns decide whether its legs are kept, so legs are summed up (map-side
    first) to distinct trip rows before anything else: the pair's minutes, the transfers and the
    leg counts are windows over those rows, brought together once by pair, and legs are not joined.
    """
    parsed = parse_leg_rows(raw, roll_midnight=roll_midnight).where(F.col("run").isNotNull())
    own = _trip_columns(parsed.drop(*RAW_PARSED_COLUMNS, *HELPER_COLUMNS))
    counts = ["t_nlegs"] + [n for n, _ in (*MODE_COUNTS, *VEHICLE_COUNTS)]
    rows = parsed.groupBy(*own).agg(
        F.sum(F.col("l_travelmins").cast("decimal(12,2)")).alias("_mins"),
        F.count_if(F.col("l_mode").isNull()).alias("_nomode"), *_leg_counts()).repartition("odid")
    kept = F.col("t_time") < F.lit(max_minutes)
    pair_rows = Window.partitionBy("odid", "origin", "destination")
    trip_rows = Window.partitionBy(*TRIP_KEYS)

    def of_kept(how, name):
        return how(F.when(kept, F.col(name))).over(trip_rows)

    rows = rows.withColumn("_travelmins", F.bround(F.coalesce(
        F.sum("_mins").over(pair_rows), F.lit(0).cast("decimal(12,2)")), 0).cast("double"))
    rows = rows.withColumns({
        "t_transfer": F.when(of_kept(F.sum, "_nomode") > 0, F.lit(None).cast("long"))
                       .otherwise(of_kept(F.sum, "t_transit") - F.lit(1)),
        **{n: of_kept(F.max if n == "t_nlegs" else F.sum, n) for n in counts}})
    trips = rows.where(kept).withColumn("t_waiting", F.col("t_time") - F.col("_travelmins"))
    # columns stand as clean_legs has them
    front = [c for c in LEG_COLUMNS if c in trips.columns]
    return _ordered(trips.select(*front, *[c for c in own if c not in front], *counts))


def enrolment_join(trips: DataFrame, schools: DataFrame) -> DataFrame:
    """Trips gain the destination school's ``enrolment`` (left join)."""
    enrol = schools.select("school_id", "enrolment")
    return join_null_safe(trips, enrol, ["school_id"], "left")


def orient_trip(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "school_id": P.orient_school("origin", "destination", "run"),
        "geoid": P.orient_geoid("origin", "destination", "run"),
    })
