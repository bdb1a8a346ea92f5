"""Raw leg rows -> typed ``legs`` table.

Per-row work (sentinels, ids, dict-text regexes, clock parsing) is one narrow
projection.  The two trip-level quantities -- total leg minutes per
(odid, origin, destination) and the transfer count per (odid, run) -- are not
computed with windows over raw legs: a window holds a whole key group in one
task, and one pair may carry a large share of the rows.  Instead the legs are
pre-aggregated map-side to one row per (odid, origin, destination, run), the
small per-trip table is windowed, and the result is joined back on the trip's
keys (AQE splits a hot key on the big side, or broadcasts the per-trip side
when its measured size is small).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parse as P
from ..functions.columns import extract_or_null, try_cast

MAX_TRIP_MINUTES = 100
TRIP_KEYS = ("odid", "origin", "destination", "run")

# raw columns removed once parsed
RAW_PARSED_COLUMNS = (
    "steps", "actual_departure", "actual_arrival", "html_instructions", "transit_details",
    "transit_routing_preference", "total_time", "depart_time", "arrival_time",
    "end_location", "start_location", "distance", "duration",
)
# columns of a kept leg that follow from its others
AFTER_JOIN = {
    "odid": lambda: P.make_odid("origin", "destination", "source_run"),
    "school_id": lambda: P.orient_school("origin", "destination", "source_run"),
    "geoid": lambda: P.orient_geoid("origin", "destination", "source_run"),
    "t_time": lambda: P.minutes_between("t_departure", "t_arrival"),
    "source_t_set_date": lambda: P.set_date_text("source_t_set"),
}
# helper columns dropped before the legs table is returned
HELPER_COLUMNS = (
    "l_instructions", "l_arr_time", "l_dep_time", "l_lat_dep", "l_lon_dep", "l_lat_arr",
    "l_lon_arr", "t_set_actual", "t_travelmins", "t_waitmins", "t_set",
)

LEG_COLUMNS = (
    "odid", "run", "origin", "destination", "school_id", "geoid", "l_number",
    "l_travelmins", "l_distance", "l_mode", "l_dep_stop", "l_arr_stop", "l_agency", "l_line",
    "l_color", "l_text_color", "l_vehicle", "l_num_stops",
    "t_departure", "t_arrival", "t_time", "t_waiting", "t_transfer",
)


def nullify_sentinels(raw: DataFrame) -> DataFrame:
    """``mutate(across(everything(), ~na_if(.x, "-999")))``."""
    return raw.select(*[P.sentinel_to_null(F.col(f"`{c}`")).alias(c) for c in raw.columns])


def parse_leg_rows(raw: DataFrame, roll_midnight: bool = False) -> DataFrame:
    """Every per-row step of the cleaning: one narrow projection, no shuffle."""
    df = nullify_sentinels(raw)
    if "l_number" not in df.columns and "_c0" in df.columns:
        df = df.withColumnRenamed("_c0", "l_number")
    df = df.withColumns({
        "odid": P.make_odid("origin", "destination", "source_run"),
        "run": F.col("source_run"),
        "l_travelmins": P.parse_duration_minutes("duration"),
        "l_distance": P.parse_distance("distance"),
        "l_number": try_cast(F.col("l_number").cast("string"), "int") + F.lit(1),
        "l_lat_arr": P.parse_lat("end_location"),
        "l_lon_arr": P.parse_lng("end_location"),
        "l_lat_dep": P.parse_lat("start_location"),
        "l_lon_dep": P.parse_lng("start_location"),
        "l_dep_stop": P.parse_dep_stop("transit_details"),
        "l_dep_time": P.parse_dep_time_text("transit_details"),
        "l_instructions": F.col("html_instructions"),
        "l_arr_stop": P.parse_arr_stop("transit_details"),
        "l_arr_time": P.parse_arr_time_text("transit_details"),
        "l_agency": extract_or_null("transit_details", P.AGENCY_NAME, 2),
        "l_line": P.parse_line("transit_details"),
        "l_color": P.parse_color("transit_details"),
        "l_text_color": P.parse_text_color("transit_details"),
        "l_vehicle": P.parse_vehicle("transit_details"),
        "l_num_stops": P.parse_num_stops("transit_details"),
        "source_t_set": P.set_time_text("source_run", "arrival_time", "depart_time"),
    })
    df = df.withColumnRenamed("travel_mode", "l_mode")
    # recoded once extracted: the recode names its value several times
    df = df.withColumn("l_agency", P.recode_agency("l_agency"))
    df = df.withColumn("source_t_set_date", P.set_date_text("source_t_set"))
    df = df.withColumns({
        "t_arrival": P.date_clock("source_t_set_date", "actual_arrival"),
        "t_departure": P.date_clock("source_t_set_date", "actual_departure"),
        "t_set": P.reference_time("source_run", "source_t_set_date"),
        "l_dep_time": P.date_clock("source_t_set_date", "l_dep_time"),
        "l_arr_time": P.date_clock("source_t_set_date", "l_arr_time"),
    })
    if roll_midnight:
        df = df.withColumn(
            "t_arrival",
            F.when(F.col("t_arrival") < F.col("t_departure"),
                   F.timestamp_add("DAY", F.lit(1), F.col("t_arrival"))).otherwise(F.col("t_arrival")))
    morning = F.col("source_run") == F.lit(P.MORNING)
    df = df.withColumns({
        "t_time": P.minutes_between("t_departure", "t_arrival"),
        "t_set_actual": F.when(morning, P.minutes_between("t_departure", "t_set"))
                         .when(~morning, P.minutes_between("t_set", "t_arrival")),
        "school_id": P.orient_school("origin", "destination", "run"),
        "geoid": P.orient_geoid("origin", "destination", "run"),
    })
    if "request_time" in df.columns:
        df = df.withColumnRenamed("request_time", "source_request_time")
    return df


def trip_level_values(parsed: DataFrame, max_minutes: float = MAX_TRIP_MINUTES) -> DataFrame:
    """One row per trip (``_trip``: origin, destination and run) with ``t_travelmins`` and ``t_transfer``.

    ``t_travelmins = round(sum(l_travelmins), 0)`` over (odid, origin, destination) on
    all rows; ``t_transfer = sum(l_mode == 'TRANSIT') - 1`` over (odid, run) on the
    rows kept by ``t_time < max_minutes`` (NULL when a kept row has no mode).
    Sums are DECIMAL so the order of partial sums cannot move a .5 tie.  The small rows are brought
    together by pair once, for both windows; the last grouping changes no row but tells the planner
    that the keys are unique, so that a join on them goes where neither value is read.
    """
    kept = F.col("t_time") < F.lit(max_minutes)
    sub = parsed.groupBy(*TRIP_KEYS).agg(
        F.sum(F.col("l_travelmins").cast("decimal(12,2)")).alias("_mins"),
        F.count_if(kept & (F.col("l_mode") == F.lit("TRANSIT"))).alias("_transit"),
        F.count_if(kept & F.col("l_mode").isNull()).alias("_nomode"),
    ).repartition("odid")
    w_pair = Window.partitionBy("odid", "origin", "destination")
    w_run = Window.partitionBy("odid", "run")
    values = sub.select(
        *TRIP_KEYS,
        F.bround(F.coalesce(F.sum("_mins").over(w_pair), F.lit(0).cast("decimal(12,2)")), 0)
         .cast("double").alias("t_travelmins"),
        F.when(F.sum("_nomode").over(w_run) > 0, F.lit(None).cast("long"))
         .otherwise(F.sum("_transit").over(w_run) - F.lit(1)).alias("t_transfer"),
    )
    return values.groupBy(F.struct("origin", "destination", F.col("run").alias("source_run")).alias("_trip")).agg(
        F.first("t_travelmins").alias("t_travelmins"), F.first("t_transfer").alias("t_transfer"))


def clean_legs(raw: DataFrame, max_minutes: float = MAX_TRIP_MINUTES,
               roll_midnight: bool = False, keep_helpers: bool = False) -> DataFrame:
    """Raw stack (all strings) -> typed legs, filtered to ``t_time < max_minutes``."""
    # without a run there is no date, hence no trip time: such rows (of files whose name
    # does not parse) can never be kept, and would form one NULL group in the windows
    parsed = parse_leg_rows(raw, roll_midnight=roll_midnight).where(F.col("run").isNotNull())
    per_trip = trip_level_values(parsed, max_minutes)
    kept = parsed.where(F.col("t_time") < F.lit(max_minutes))
    # plain equality is null-safe here: structs compare NULL fields as equal.  The pair id follows from the
    # other keys; it and what else follows from kept columns is made again after the join, not shuffled
    legs = kept.drop("run", *AFTER_JOIN).join(
        per_trip, F.struct("origin", "destination", "source_run") == F.col("_trip"), "left").drop("_trip")
    legs = legs.withColumn("run", F.col("source_run")).withColumns({c: make() for c, make in AFTER_JOIN.items()})
    legs = legs.select(*kept.columns, "t_travelmins", "t_transfer")
    legs = legs.withColumns({
        "t_waitmins": F.col("t_set_actual") - F.col("t_travelmins"),
        "t_waiting": F.col("t_time") - F.col("t_travelmins"),
    })
    drop = [c for c in RAW_PARSED_COLUMNS if c in legs.columns]
    if not keep_helpers:
        drop += [c for c in HELPER_COLUMNS if c in legs.columns]
    legs = legs.drop(*drop)
    source_cols = [c for c in legs.columns if c.startswith("source")]
    front = [c for c in LEG_COLUMNS if c in legs.columns]
    middle = [c for c in legs.columns if c not in front and c not in source_cols]
    return legs.select(*front, *middle, *source_cols)


def trip_travel_minutes(parsed: DataFrame) -> DataFrame:
    """Per (odid, origin, destination): ``round(sum(l_travelmins), 0)``."""
    return (parsed.groupBy("odid", "origin", "destination")
            .agg(F.bround(F.coalesce(F.sum(F.col("l_travelmins").cast("decimal(12,2)")),
                                     F.lit(0).cast("decimal(12,2)")), 0).cast("double")
                 .alias("t_travelmins")))


def trip_transfers(legs: DataFrame) -> DataFrame:
    """Per (odid, run): ``sum(l_mode == 'TRANSIT') - 1``; NULL if a mode is missing."""
    return (legs.groupBy("odid", "run")
            .agg(F.when(F.count_if(F.col("l_mode").isNull()) > 0, F.lit(None).cast("long"))
                 .otherwise(F.count_if(F.col("l_mode") == F.lit("TRANSIT")) - F.lit(1))
                 .alias("t_transfer")))
