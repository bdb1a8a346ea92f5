"""Route acquisition as Spark jobs on either side of an external fetcher.

``request_plan`` lists the origin-destination requests of one batch, and
``flatten_responses`` turns a table of stored route responses into leg rows in
the fetcher's CSV shape.  The HTTP calls themselves are not part of this
library.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.parse import SENTINEL, python_text, unix_to_ntz
from ..session import scratch_path
from ..sources.batches import BATCH_COLUMNS, INDEX_COLUMN

# ---- Fixed values: request defaults and time formats of the fetcher ----
DEFAULT_PREFERENCE = "standard"
MAX_BROADCAST_ORIGINS = 1_000_000   # indexed origins (id, position, two coordinates) ~ 50 MB
POSITION_BLOCK = 10_000             # origin positions expanded from one row at a time
POSITION_RUN = 256                  # origin positions that stand together in a task, once for each destination
REQUESTS_PER_TASK = 2_000_000       # requests that one task expands, up to the most tasks
MAX_PLAN_TASKS = 10_000
MISSING_TIME_TEXT = "NA"
REQUEST_TIME_FORMAT = "MM/dd/yyyy HH:mm:ss"       # Python %m/%d/%Y %H:%M:%S, then the zone text
REQUEST_ZONE = "America/New_York"
DESIRED_TIME_FORMAT = "MMM dd yyyy h:mma"         # Python %b %d %Y %I:%M%p
STEP_TEXT_COLUMNS = ("distance", "duration", "end_location", "html_instructions",
                     "start_location", "steps", "travel_mode", "transit_details",
                     "actual_departure", "actual_arrival")

TEXT_VALUE = T.StructType([T.StructField("text", T.StringType()), T.StructField("value", T.LongType())])
LAT_LNG = T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lng", T.DoubleType())])
STEP = T.StructType([
    T.StructField("distance", TEXT_VALUE), T.StructField("duration", TEXT_VALUE),
    T.StructField("end_location", LAT_LNG), T.StructField("start_location", LAT_LNG),
    T.StructField("html_instructions", T.StringType()), T.StructField("travel_mode", T.StringType()),
    T.StructField("polyline", T.StructType([T.StructField("points", T.StringType())])),
    # kept as JSON text: their keys differ by step, and the CSV holds them as printed dicts
    T.StructField("transit_details", T.StringType()), T.StructField("steps", T.StringType()),
])
LEG = T.StructType([
    T.StructField("departure_time", TEXT_VALUE), T.StructField("arrival_time", TEXT_VALUE),
    T.StructField("steps", T.ArrayType(STEP)),
])
RESPONSE_SCHEMA = T.ArrayType(T.StructType([T.StructField("legs", T.ArrayType(LEG))]))


# ---------------------------------------------------------------- request plan
def dense_index(df: DataFrame, order_col: str | list[Column], name: str = "idx") -> DataFrame:
    """0-based position of each row in ``order_col`` order, computed distributed.

    Rows are range-partitioned, sorted and written once with their partition and
    place; each row's position is its partition's offset (a running sum over the
    per-partition counts -- one row per partition) plus its place in the partition.
    The offsets and the rows are both read from the written table: computed twice,
    the sampled range bounds and the coalesced partitions could differ.  Requires
    unique ``order_col`` values (a list of sort columns: unique together).
    """
    order = [order_col] if isinstance(order_col, str) else order_col
    ordered = (df.repartitionByRange(*order).sortWithinPartitions(*order)
                 .withColumns({"_pid": F.spark_partition_id(),
                               "_mid": F.monotonically_increasing_id()}))
    ordered = ordered.withColumn("_pos", F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33))
    ordered = ordered.drop("_mid")
    path = scratch_path(df.sparkSession, "dense_index")
    ordered.write.parquet(path)
    ordered = df.sparkSession.read.schema(ordered.schema).parquet(path)
    counts = ordered.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid",
        (F.sum("_n").over(Window.orderBy("_pid")
                          .rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n"))
        .alias("_offset"))
    out = ordered.join(F.broadcast(offsets), "_pid")
    return out.withColumn(name, F.col("_offset") + F.col("_pos")).drop("_pid", "_pos", "_offset")


def slice_rows(df: DataFrame, order_col: str, start: int, end: int | None, name: str = "idx") -> DataFrame:
    """``iloc[start:end]`` in ``order_col`` order, re-numbered from 0."""
    indexed = dense_index(df, order_col, "_row")
    cond = F.col("_row") >= F.lit(start)
    if end is not None:
        cond = cond & (F.col("_row") < F.lit(end))
    return indexed.where(cond).withColumn(name, F.col("_row") - F.lit(start)).drop("_row")


def request_plan(origins: DataFrame, destinations: DataFrame, origin_start: int = 0,
                 origin_end: int | None = None, dest_start: int = 0, dest_end: int | None = None,
                 run: str = "morning", order_col: str = "id") -> DataFrame:
    """Every (destination, origin) request of one batch, numbered as the fetcher does.

    ``origins`` / ``destinations`` carry ``id, lat, lng`` and ``order_col`` (the file order).  The evening batch passes
    the schools as origins.  Each destination row expands to the origin positions
    of the batch (``sequence`` + ``explode``) and is equi-joined to the indexed
    origins: an ordinary hash join on the origin position, no cartesian product.
    The blocks are spread by the number of requests they expand to, since the rows
    before the expansion are few and would all lie in one task.  A task takes the same block for
    neighbouring destinations, run of positions by run: its files hold few origins, which columnar formats
    write as short codes, and the same codes come again after every run.
    Request number = destination position * number of origins + origin position + 1.
    """
    o = slice_rows(origins, order_col, origin_start, origin_end, "o_pos").select(
        "o_pos", F.col("id").alias("origin"), F.col("lat").alias("origin_lat"),
        F.col("lng").alias("origin_lng"))
    d = slice_rows(destinations, order_col, dest_start, dest_end, "d_pos").select(
        "d_pos", F.col("id").alias("destination"), F.col("lat").alias("destination_lat"),
        F.col("lng").alias("destination_lng"))
    # the two counts are one number each; they size the expansion and the join below
    n_origins, n_destinations = o.count(), d.count()
    if n_origins == 0:
        expanded = d.withColumn("o_pos", F.lit(None).cast("bigint")).where(F.lit(False))
    else:
        # in two steps, so that no row ever holds more than POSITION_BLOCK positions
        blocks = F.sequence(F.lit(0).cast("bigint"), F.lit(n_origins - 1).cast("bigint"),
                            F.lit(POSITION_BLOCK).cast("bigint"))
        last = F.least(F.col("_block") + F.lit(POSITION_BLOCK - 1), F.lit(n_origins - 1)).cast("bigint")
        tasks = max(1, min(MAX_PLAN_TASKS, -(-n_origins * n_destinations // REQUESTS_PER_TASK)))
        # the requests of all blocks before, and of this block's destinations before
        before = F.col("_block") * F.lit(n_destinations) + F.col("d_pos") * (last - F.col("_block") + F.lit(1))
        task = F.floor(before / F.lit(max(1, n_origins * n_destinations)) * F.lit(tasks)).cast("int")
        spread = (d.withColumn("_block", F.explode(blocks)).repartitionById(tasks, task)
                   .withColumn("_run", F.explode(F.sequence(F.col("_block"), last, F.lit(POSITION_RUN).cast("bigint"))))
                   .sortWithinPartitions("_run", "d_pos"))
        last = F.least(F.col("_run") + F.lit(POSITION_RUN - 1), last)
        expanded = spread.withColumn("o_pos", F.explode(F.sequence(F.col("_run"), last))).drop("_block", "_run")
    # The planner sizes an explode by its input, so it would take the expanded
    # destinations (|D| x |O| rows) for a small table.  Broadcast the indexed
    # origins when their counted size is bounded; otherwise shuffle both sides.
    if n_origins <= MAX_BROADCAST_ORIGINS:
        pairs = expanded.join(F.broadcast(o), "o_pos")
    else:
        pairs = expanded.hint("shuffle_merge").join(o, "o_pos")
    return pairs.select(
        F.lit(run).alias("run"),
        (F.col("d_pos") * F.lit(n_origins) + F.col("o_pos") + F.lit(1)).alias("request_id"),
        "origin", "origin_lat", "origin_lng", "destination", "destination_lat", "destination_lng")


# ---------------------------------------------------------------- responses
def _route_leg(response: Column) -> Column:
    parsed = F.from_json(response, RESPONSE_SCHEMA)
    return F.get(F.get(parsed, 0)["legs"], 0)


def flatten_responses(responses: DataFrame, response_col: str = "response",
                      keep_walk_only: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Stored responses -> one row per step of the first route's first leg.

    A response without a route, with an empty leg, without leg times, malformed,
    or NULL gives one row with NULL step fields and ``failed = true`` (the
    fetcher's sentinel row).  ``get`` returns NULL out of range, so nothing throws
    under ANSI mode.  ``transit_details`` and the nested ``steps`` come as the dict
    text of the fetcher's CSV.

    A route on foot only has no leg times, so the fetcher counts it as failed;
    ``keep_walk_only`` keeps its steps, with NULL times.  ``carry`` names further
    columns of ``responses`` to pass on.
    """
    leg = _route_leg(F.col(response_col))
    df = responses.withColumn("_leg", leg)
    untimed = F.col("_leg")["departure_time"].isNull() | F.col("_leg")["arrival_time"].isNull()
    if keep_walk_only:
        on_foot = F.forall(F.col("_leg")["steps"], lambda s: s["travel_mode"] == F.lit("WALKING"))
        untimed = untimed & ~F.coalesce(on_foot, F.lit(False))
    failed = (F.col("_leg").isNull() | F.coalesce(F.size(F.col("_leg")["steps"]) <= 0, F.lit(True))
              | untimed)
    df = df.withColumn("failed", failed)
    steps = F.when(~F.col("failed"), F.col("_leg")["steps"])
    df = df.select("*", F.posexplode_outer(steps).alias("l_number", "step"))
    dep, arr = F.col("_leg")["departure_time"], F.col("_leg")["arrival_time"]
    ok = ~F.col("failed")
    return df.select(
        "origin", "destination",
        F.when(ok, F.col("l_number")).otherwise(F.lit(0)).cast("int").alias("l_number"),
        F.col("step")["distance"]["value"].alias("distance_m"),
        F.col("step")["distance"]["text"].alias("distance_text"),
        F.col("step")["duration"]["value"].alias("duration_s"),
        F.col("step")["duration"]["text"].alias("duration_text"),
        F.col("step")["start_location"]["lat"].alias("start_lat"),
        F.col("step")["start_location"]["lng"].alias("start_lng"),
        F.col("step")["end_location"]["lat"].alias("end_lat"),
        F.col("step")["end_location"]["lng"].alias("end_lng"),
        F.col("step")["html_instructions"].alias("html_instructions"),
        F.col("step")["travel_mode"].alias("travel_mode"),
        python_text(F.col("step")["transit_details"]).alias("transit_details"),
        python_text(F.col("step")["steps"]).alias("steps"),
        F.when(ok, dep["text"]).alias("actual_departure"),
        F.when(ok, arr["text"]).alias("actual_arrival"),
        F.when(ok, (arr["value"] - dep["value"]).cast("double") / F.lit(60.0)).alias("total_time"),
        "failed", *carry,
    )


def _dict_text(fields) -> Column:
    """Python-dict text ``{'k': v, ...}`` as pandas writes a dict cell."""
    parts = [F.lit("{")]
    for i, (key, value, quoted) in enumerate(fields):
        if i:
            parts.append(F.lit(", "))
        parts.append(F.lit(f"'{key}': "))
        if quoted:
            parts += [F.lit("'"), value.cast("string"), F.lit("'")]
        else:
            parts.append(value.cast("string"))
    parts.append(F.lit("}"))
    return F.concat(*parts)


def error_sentinel_rows(flat: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Flattened steps -> rows in the fetcher's CSV text shape; failed pairs become one
    ``-999`` row that keeps its origin and destination.  ``carry``: further columns to pass on."""
    ok = ~F.col("failed")

    def text(c: Column) -> Column:
        return F.when(ok, c).otherwise(F.lit(SENTINEL))

    out = flat.select(
        F.col("l_number").cast("string").alias("l_number"),
        text(_dict_text([("text", F.col("distance_text"), True),
                         ("value", F.col("distance_m"), False)])).alias("distance"),
        text(_dict_text([("text", F.col("duration_text"), True),
                         ("value", F.col("duration_s"), False)])).alias("duration"),
        text(_dict_text([("lat", F.col("end_lat"), False), ("lng", F.col("end_lng"), False)]))
        .alias("end_location"),
        text(F.col("html_instructions")).alias("html_instructions"),
        text(_dict_text([("lat", F.col("start_lat"), False), ("lng", F.col("start_lng"), False)]))
        .alias("start_location"),
        text(F.col("steps")).alias("steps"),
        text(F.col("travel_mode")).alias("travel_mode"),
        text(F.col("transit_details")).alias("transit_details"),
        F.col("origin").cast("string").alias("origin"),
        F.col("destination").cast("string").alias("destination"),
        text(F.col("actual_departure")).alias("actual_departure"),
        text(F.col("actual_arrival")).alias("actual_arrival"),
        F.when(ok, F.col("total_time").cast("string")).otherwise(F.lit("-999.0")).alias("total_time"),
        *carry,
    )
    return out


def request_defaults(df: DataFrame, depart_time: str | None = None, arrival_time: str | None = None,
                     preference: str | None = None) -> DataFrame:
    """Batch-level request fields: missing times are ``"NA"``, preference ``"standard"``."""
    return df.withColumns({
        "depart_time": F.lit(depart_time if depart_time is not None else MISSING_TIME_TEXT),
        "arrival_time": F.lit(arrival_time if arrival_time is not None else MISSING_TIME_TEXT),
        "transit_routing_preference": F.lit(preference if preference is not None else DEFAULT_PREFERENCE),
    })


def finished_batch(responses: DataFrame, requested_at: str = "requested_at", response_col: str = "response",
                   depart_time: str | None = None, arrival_time: str | None = None,
                   preference: str | None = None, keep_walk_only: bool = False) -> DataFrame:
    """Stored responses -> the complete rows of one batch file, in ``BATCH_COLUMNS`` order.

    ``requested_at`` is the UTC wall clock of each request; the other request fields hold
    for the whole batch.  ``sinks.write_batch`` writes the result, ``load_batches`` reads it.
    """
    flat = flatten_responses(responses, response_col, keep_walk_only, carry=(requested_at,))
    rows = error_sentinel_rows(flat, carry=(requested_at,))
    rows = rows.withColumn("request_time", format_request_time(requested_at))
    rows = request_defaults(rows, depart_time, arrival_time, preference)
    return rows.withColumnRenamed("l_number", INDEX_COLUMN).select(*BATCH_COLUMNS)


def to_zone_wallclock(ts_utc, zone: str = REQUEST_ZONE) -> Column:
    """UTC wall clock (TIMESTAMP_NTZ) -> the wall clock in ``zone``."""
    ts_utc = F.col(ts_utc) if isinstance(ts_utc, str) else ts_utc
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts_utc.cast("timestamp_ntz"))


def format_request_time(ts_utc, zone: str = REQUEST_ZONE) -> Column:
    """``strftime(now.astimezone(New York), "%m/%d/%Y %H:%M:%S %Z")`` for a UTC wall clock.

    The zone text follows the offset in force: -5 h is EST, -4 h is EDT.
    """
    ts_utc = F.col(ts_utc) if isinstance(ts_utc, str) else ts_utc
    utc = ts_utc.cast("timestamp_ntz")
    local = to_zone_wallclock(utc, zone)
    offset = F.timestamp_diff("MINUTE", utc, local)
    abbrev = F.when(offset == -300, F.lit("EST")).when(offset == -240, F.lit("EDT"))
    return F.when(utc.isNotNull(), F.concat_ws(" ", F.date_format(local, REQUEST_TIME_FORMAT), abbrev))


def parse_desired_time(text, zone: str = REQUEST_ZONE) -> Column:
    """``strptime('Jan 05 2023 2:00PM').astimezone(New York)`` on a UTC machine:
    the text is read as a UTC wall clock and shifted to New York's wall clock."""
    text = F.col(text) if isinstance(text, str) else text
    instant = F.try_to_timestamp(F.concat(text, F.lit(" +0000")), F.lit(DESIRED_TIME_FORMAT + " Z"))
    return to_zone_wallclock(unix_to_ntz(F.unix_seconds(instant)), zone)


__all__ = ["request_plan", "dense_index", "slice_rows", "flatten_responses", "error_sentinel_rows",
           "request_defaults", "finished_batch", "format_request_time", "parse_desired_time", "to_zone_wallclock",
           "RESPONSE_SCHEMA", "STEP_TEXT_COLUMNS"]
