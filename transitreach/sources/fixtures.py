"""Role mapping of the driver's TPC-H-style tables onto the accessibility tables.

An order is one routed trip and its line items are the legs; the two orders of
``pair = l_orderkey div 2`` are the morning and evening trips of one
origin-destination pair.  ``geoid = pair % 150`` and ``school_id = pair div 150``,
so every pair has its own (block group, school) combination.  Raw leg rows are
rendered as the route fetcher writes them (dict text, clock text, ``-999``
sentinels), so the real parsers run on them; the oracle SQL computes the same
expected values from plain columns.  ``FIXTURES.md`` documents every column.

All of it is built with joins and narrow projections, so it scales with the
driver tables.  The only window is the leg index inside one order (an order has
a handful of line items).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import try_cast

# ---- Fixed values of the role mapping (also used by the oracle SQL) ----
AREAS = 150                 # geoid = pair % AREAS, school_id = pair div AREAS
FAILED_EVERY = 97           # orders whose route request failed
NO_LEG_TIMES_EVERY = 89     # responses whose leg lacks departure/arrival time
VEHICLES = {1: ("BUS", "Bus"), 2: ("FERRY", "Ferry"), 3: ("HEAVY_RAIL", "Train"), 4: ("TRAM", "Tram")}
DEFAULT_VEHICLE = ("SUBWAY", "Subway")
RAW_AGENCY = {"ECONOMY": "MTA New York City Transit", "SMALL": "MTA", "PROMO": "NJ TRANSIT BUS"}
SECTORS = ("Public", "Private nonprofit", "Private for-profit")        # by s_suppkey % 3
DEGREE_LEVELS = ("2-year", "4-year or higher")                         # by s_suppkey % 2
DEGREE_TYPES = ("Associate", "Baccalaureate", "Doctoral", "Master's", "Special Focus")  # % 5
SIZE_BOUNDS = ((1000, "Under 1,000"), (5000, "1,000 - 4,999"), (10000, "5,000 - 9,999"),
               (20000, "10,000 - 19,999"))
SIZE_TOP = "20,000 and above"
ZERO_ENROLMENT_EVERY = 17   # institutions with zero enrolment (percent -> NULL)

RAW_COLUMNS = (
    "l_number", "distance", "duration", "end_location", "html_instructions", "start_location",
    "steps", "travel_mode", "transit_details", "origin", "destination", "actual_departure",
    "actual_arrival", "total_time", "request_time", "depart_time", "arrival_time",
    "transit_routing_preference",
)
SOURCE_COLUMNS = ("source_filename", "source_run", "source_apik", "source_start_index",
                  "source_end_index", "source_coverage")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _s(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _clock(minutes: Column) -> Column:
    """Minutes after midnight -> ``h:mm AM`` text."""
    hour = (minutes / 60).cast("int")
    h12 = ((hour + 11) % 12) + 1
    return F.concat(_s(h12), F.lit(":"), F.lpad(_s(minutes % 60), 2, "0"), F.lit(" "),
                    F.when(hour < 12, F.lit("AM")).otherwise(F.lit("PM")))


def _vehicle(ln: Column, which: int) -> Column:
    out = F.lit(DEFAULT_VEHICLE[which])
    for number in sorted(VEHICLES, reverse=True):
        out = F.when(ln == F.lit(number), F.lit(VEHICLES[number][which])).otherwise(out)
    return out


FACT_COLUMNS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                "l_returnflag", "p_type", "p_brand", "o_orderdate", "leg_index")


def joined_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item with its part and order and its place in the order (``FACT_COLUMNS``)."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_returnflag", "l_shipdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    df = (li.join(part, li.l_partkey == part.p_partkey)
            .join(orders, li.l_orderkey == orders.o_orderkey))
    order_legs = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return df.withColumn("leg_index", F.row_number().over(order_legs) - 1).select(*FACT_COLUMNS)


def leg_facts(spark: SparkSession, sf_dir: str, joined: DataFrame | None = None) -> DataFrame:
    """``joined_legs`` (or what was stored of it) with the plain values every leg column derives from."""
    df = joined_legs(spark, sf_dir) if joined is None else joined
    k = F.col("l_orderkey")
    df = df.withColumns({
        "pair": F.floor(k / 2).cast("bigint"),
        "is_morning": (k % 2) == 0,
        "failed": (k % FAILED_EVERY) == 0,
        "walking": F.col("l_returnflag") == F.lit("A"),
        "trip_minutes": F.lit(20) + (k * 7) % 90,
    })
    df = df.withColumns({
        "geoid": _s(F.col("pair") % AREAS),
        "school_id": _s(F.floor(F.col("pair") / AREAS).cast("bigint")),
        "run": F.when(F.col("is_morning"), F.lit("morning")).otherwise(F.lit("evening")),
        "dep_minute": F.when(F.col("is_morning"), F.lit(7 * 60)).otherwise(F.lit(17 * 60)) + k % 60,
        "date_text": F.date_format("o_orderdate", "MM/dd/yyyy"),
    })
    return df.withColumn("arr_minute", F.col("dep_minute") + F.col("trip_minutes"))


def _transit_details(ln: Column) -> Column:
    sk, pk = _s("l_suppkey"), _s("l_partkey")
    agency = F.col("p_type")
    for src, raw in RAW_AGENCY.items():
        agency = F.when(F.col("p_type") == F.lit(src), F.lit(raw)).otherwise(agency)
    line_name = F.when(ln == 3, F.concat(F.col("p_brand"), F.lit(", NYC Subway"))).otherwise(F.col("p_brand"))
    line_name_part = F.when(ln == 5, F.lit("")).otherwise(
        F.concat(F.lit("'name': '"), line_name, F.lit("', ")))
    color = F.concat(F.lit("#"), F.lpad(_s(F.col("l_partkey") % 1000000), 6, "0"))
    text_color = F.when(F.col("l_suppkey") % 2 == 0, F.lit("#000000")).otherwise(F.lit("#FFFFFF"))
    dep_text = F.replace(F.col("dep_clock"), F.lit(" "), F.lit("\\u202f"))
    arr_text = F.replace(F.col("arr_clock"), F.lit(" "), F.lit("\\u202f"))
    return F.concat(
        F.lit("{'arrival_stop': {'location': {'lat': 40.7, 'lng': -73.9}, 'name': 'A"), sk,
        F.lit("'}, 'arrival_time': {'text': '"), arr_text,
        F.lit("', 'time_zone': 'America/New_York', 'value': 1}, 'departure_stop': {'location': "
              "{'lat': 40.6, 'lng': -73.9}, 'name': 'S"), sk,
        F.lit("'}, 'departure_time': {'text': '"), dep_text,
        F.lit("', 'time_zone': 'America/New_York', 'value': 1}, 'headsign': 'H"), pk,
        F.lit("', 'line': {'agencies': [{'name': '"), agency,
        F.lit("', 'phone': '1', 'url': 'u'}], 'color': '"), color, F.lit("', "), line_name_part,
        F.lit("'short_name': 'L"), _s(ln), F.lit("', 'text_color': '"), text_color,
        F.lit("', 'vehicle': {'icon': 'i', 'name': '"), _vehicle(ln, 1),
        F.lit("', 'type': '"), _vehicle(ln, 0), F.lit("'}}, 'num_stops': "), _s(ln), F.lit("}"))


def _transit_json(ln: Column) -> Column:
    """The same transit details as the service sends them (``_transit_details`` is their dict text)."""
    def place(lat: float, letter: str) -> Column:
        location = F.struct(F.lit(lat).alias("lat"), F.lit(-73.9).alias("lng"))
        return F.struct(location.alias("location"), F.concat(F.lit(letter), _s("l_suppkey")).alias("name"))

    def time(minute: str) -> Column:
        return F.struct(F.translate(_clock(F.col(minute)), " ", "\u202f").alias("text"),
                        F.lit("America/New_York").alias("time_zone"), F.lit(1).alias("value"))

    agency = F.col("p_type")
    for src, raw in RAW_AGENCY.items():
        agency = F.when(F.col("p_type") == F.lit(src), F.lit(raw)).otherwise(agency)
    suffix = F.when(ln == 3, F.lit(", NYC Subway")).otherwise(F.lit(""))
    line = F.struct(
        F.array(F.struct(agency.alias("name"), F.lit("1").alias("phone"), F.lit("u").alias("url"))).alias("agencies"),
        F.concat(F.lit("#"), F.lpad(_s(F.col("l_partkey") % 1000000), 6, "0")).alias("color"),
        F.when(ln != 5, F.concat(F.col("p_brand"), suffix)).alias("name"),
        F.concat(F.lit("L"), _s(ln)).alias("short_name"),
        F.when(F.col("l_suppkey") % 2 == 0, F.lit("#000000")).otherwise(F.lit("#FFFFFF")).alias("text_color"),
        F.struct(F.lit("i").alias("icon"), _vehicle(ln, 1).alias("name"), _vehicle(ln, 0).alias("type")).alias("vehicle"))
    return F.struct(
        place(40.7, "A").alias("arrival_stop"), time("arr_minute").alias("arrival_time"),
        place(40.6, "S").alias("departure_stop"), time("dep_minute").alias("departure_time"),
        F.concat(F.lit("H"), _s("l_partkey")).alias("headsign"), line.alias("line"), ln.cast("int").alias("num_stops"))


def batch_names(df: DataFrame) -> DataFrame:
    """Batch file fields: run, fetch client, school index range."""
    school = F.col("school_id").cast("bigint")
    start = school - school % 2
    return df.withColumns({
        "source_run": F.col("run"),
        "source_apik": F.concat(F.lit("key"), _s(school % 3)),
        "source_start_index": start,
        "source_end_index": start + 2,
        "source_coverage": F.lit(2).cast("bigint"),
    }).withColumn("source_filename", F.concat_ws(
        "", F.col("run"), F.lit("_"), F.col("source_apik"), F.lit("_"),
        _s("source_start_index"), F.lit("-"), _s("source_end_index"), F.lit(".csv")))


def raw_steps(spark: SparkSession, sf_dir: str, with_source: bool = True, by_batch: bool = False,
              joined: DataFrame | None = None) -> DataFrame:
    """Leg rows in the route fetcher's CSV schema: every value is text.

    ``by_batch`` clusters and sorts the rows by batch name before their texts are made,
    which are many times as wide as the values they come from.  ``joined``: stored rows of ``joined_legs``.
    """
    f = batch_names(leg_facts(spark, sf_dir, joined))
    # both are written twice, plainly and in the transit details
    f = f.withColumns({"dep_clock": _clock(F.col("dep_minute")), "arr_clock": _clock(F.col("arr_minute"))})
    if by_batch:
        f = f.hint("rebalance", "source_filename").sortWithinPartitions("source_filename")
    ln = F.col("l_linenumber")
    walking, failed = F.col("walking"), F.col("failed")
    sk, pk = F.lpad(_s(F.col("l_suppkey") % 10000), 4, "0"), F.lpad(_s(F.col("l_partkey") % 10000), 4, "0")
    end_lat = (F.when(ln == 6, F.lit("40")).when(ln == 7, F.lit("-33.8688"))
               .otherwise(F.concat(F.lit("40."), sk)))
    cols = {
        "l_number": _s("leg_index"),
        "distance": F.concat(F.lit("{'text': '1 km', 'value': "),
                             _s(F.floor("l_extendedprice").cast("bigint")), F.lit("}")),
        "duration": F.concat(F.lit("{'text': '1 min', 'value': "),
                             _s((F.col("l_quantity") * 37).cast("bigint")), F.lit("}")),
        "end_location": F.concat(F.lit("{'lat': "), end_lat, F.lit(", 'lng': -74."), pk, F.lit("}")),
        "html_instructions": F.when(walking, F.concat(F.lit("Walk to S"), _s("l_suppkey")))
                              .otherwise(F.concat(_vehicle(ln, 1), F.lit(" towards A"), _s("l_suppkey"))),
        "start_location": F.concat(F.lit("{'lat': 40."), pk, F.lit(", 'lng': -73."), sk, F.lit("}")),
        "steps": F.when(walking, F.lit("[{'travel_mode': 'WALKING'}]")),
        "travel_mode": F.when(walking, F.lit("WALKING")).otherwise(F.lit("TRANSIT")),
        "transit_details": F.when(~walking, _transit_details(ln)),
        "origin": F.when(F.col("is_morning"), F.col("geoid")).otherwise(F.col("school_id")),
        "destination": F.when(F.col("is_morning"), F.col("school_id")).otherwise(F.col("geoid")),
        "actual_departure": F.col("dep_clock"),
        "actual_arrival": F.col("arr_clock"),
        "total_time": F.concat(_s("trip_minutes"), F.lit(".0")),
    }
    sentinel_cols = ("distance", "duration", "end_location", "html_instructions", "start_location",
                     "steps", "travel_mode", "transit_details", "actual_departure", "actual_arrival")
    for c in sentinel_cols:
        cols[c] = F.when(failed, F.lit("-999")).otherwise(cols[c])
    cols["total_time"] = F.when(failed, F.lit("-999.0")).otherwise(cols["total_time"])
    cols["request_time"] = F.concat(F.col("date_text"), F.lit(" 12:"),
                                    F.lpad(_s(F.col("l_orderkey") % 60), 2, "0"), F.lit(":00 EST"))
    cols["depart_time"] = F.when(~F.col("is_morning"), F.concat(F.col("date_text"), F.lit(" 17:00:00 EST")))
    cols["arrival_time"] = F.when(F.col("is_morning"), F.concat(F.col("date_text"), F.lit(" 09:00:00 EST")))
    cols["transit_routing_preference"] = F.lit("standard")
    out = f.withColumns(cols)
    if with_source:
        return out.select(*RAW_COLUMNS, *SOURCE_COLUMNS)
    return out.select(*RAW_COLUMNS, "source_filename")


# ---------------------------------------------------------------- dimensions
def ipeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Institution table in the survey's raw column names (upper case, ``own_`` prefixes)."""
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    df = s.join(n, s.s_nationkey == n.n_nationkey, "left")
    key = F.col("s_suppkey")
    total = F.when(key % ZERO_ENROLMENT_EVERY == 0, F.lit(0).cast("bigint")) \
             .otherwise(F.floor(F.abs("s_acctbal")).cast("bigint"))
    size = F.lit(SIZE_TOP)
    for bound, label in reversed(SIZE_BOUNDS):
        size = F.when(total < bound, F.lit(label)).otherwise(size)

    def pick(values, mod):
        out = F.lit(values[-1])
        for i in range(len(values) - 2, -1, -1):
            out = F.when(key % mod == i, F.lit(values[i])).otherwise(out)
        return out

    return df.select(
        _s(key).alias("UNITID"),
        F.col("s_name").alias("INSTNM"),
        F.concat(F.lit("Street "), _s(key)).alias("ADDR"),
        F.col("n_name").alias("CITY"),
        F.lpad(_s(key % 100000), 5, "0").alias("ZIP"),
        F.col("n_name").alias("STABBR"),
        (F.lit(-73.5) - key / F.lit(1000.0)).alias("LONGITUD"),
        (F.lit(40.5) + key / F.lit(2000.0)).alias("LATITUDE"),
        total.alias("EFYTOTLT"),
        F.floor(total / 16).cast("bigint").alias("EFYTOTLM"),
        (total - F.floor(total / 16).cast("bigint")).alias("EFYTOTLW"),
        F.floor(total / 3).cast("bigint").alias("EFYWHITT"),
        F.floor(total / 4).cast("bigint").alias("EFYBKAAW"),
        F.floor(total / 5).cast("bigint").alias("EFYHISPT"),
        F.floor(total / 7).cast("bigint").alias("EFYASIAT"),
        F.floor(total / 11).cast("bigint").alias("EFYNHPIT"),
        F.lit("1").alias("EFFYALEV"), F.lit("1").alias("EFFYLEV"), F.lit("1").alias("LSTUDY"),
        F.lit("0").alias("own_THEOLOG"), F.lit("0").alias("own_OPEFLAG"),
        F.lit("0").alias("own_FORPROFIT"), F.lit(-73.95).alias("LON_CTR"),
        F.lit(40.65).alias("LAT_CTR"), (F.abs("s_acctbal") / F.lit(400.0)).alias("crow_flies"),
        F.lit("1").alias("own_ADMCON7"), F.lit(1).alias("ADMSSN"), F.lit(2).alias("APPLCN"),
        size.alias("own_SIZE"),
        pick(SECTORS, 3).alias("own_SECTOR"),
        pick(DEGREE_LEVELS, 2).alias("own_DEGREE_LEVEL"),
        pick(DEGREE_TYPES, 5).alias("own_DEGREE_TYPES"),
        F.concat(F.lit("C"), _s(key % 7)).alias("own_CARNEGIE"),
        F.when(key % 4 == 0, F.lit("Yes")).otherwise(F.lit("No")).alias("own_MULTICAMPUS"),
        pick(DEGREE_TYPES, 5).alias("own_IPEDS_CATEGORY"),
    )


def blockgroups(spark: SparkSession, sf_dir: str, with_geometry: bool = False) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    cols = [_s("c_custkey").alias("geoid"), F.col("c_name").alias("name")]
    if with_geometry:
        cols.append(rectangle_ring(F.col("c_custkey").cast("double")).alias("geometry"))
    return c.select(*cols)


def rectangle_ring(k: Column) -> Column:
    """A 4 x 2 rectangle anchored at (k, 0), as polygon -> ring -> vertex arrays."""
    def pt(x, y):
        return F.struct(x.alias("x"), F.lit(float(y)).alias("y"))
    ring = F.array(pt(k, 0), pt(k + 4, 0), pt(k + 4, 2), pt(k, 2), pt(k, 0))
    return F.array(ring)


def areas_with_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas as lists of polygons: a hole of one by one in every third, an island of two by two in every fifth."""
    key, k = F.col("c_custkey"), F.col("c_custkey").cast("double")

    def box(x0, y0, x1, y1):
        return F.array(*[F.struct((k + F.lit(x)).alias("x"), F.lit(y).alias("y"))
                         for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))])

    outer, hole, island = box(0.0, 0.0, 4.0, 2.0), box(1.0, 0.25, 2.0, 1.25), box(10.0, 0.0, 12.0, 2.0)
    body = F.when(key % 3 == 0, F.array(outer, hole)).otherwise(F.array(outer))
    return table(spark, sf_dir, "customer").select(
        _s("c_custkey").alias("geoid"), F.col("c_name").alias("name"),
        F.when(key % 5 == 0, F.array(body, F.array(island))).otherwise(F.array(body)).alias("geometry"))


def acs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    est = F.floor(F.abs("c_acctbal")).cast("double")
    return c.select(
        _s("c_custkey").alias("geoid"),
        F.col("c_mktsegment").alias("concept"),
        F.concat(F.lit("v"), _s(F.col("c_nationkey") % 3)).alias("label"),
        est.alias("estimate"),
        (est / F.lit(100.0)).alias("percent"),
    )


def leg_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour per line name; brands whose number is a multiple of 5 are left out."""
    p = table(spark, sf_dir, "part").select("p_brand").distinct()
    num = try_cast(F.regexp_extract("p_brand", r"(\d+)$", 1), "int")
    return (p.where(num % 5 != 0)
             .select(F.col("p_brand").alias("l_line"),
                     F.concat(F.lit("#"), F.lpad(_s(num * 7), 6, "0")).alias("l_color")))


def agency_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour per (recoded) agency; the LARGE agency is left out."""
    from ..functions.parse import recode_agency
    p = table(spark, sf_dir, "part").select("p_type").distinct().where(F.col("p_type") != "LARGE")
    raw = F.col("p_type")
    for src, name in RAW_AGENCY.items():
        raw = F.when(F.col("p_type") == F.lit(src), F.lit(name)).otherwise(raw)
    return p.select(recode_agency(raw).alias("l_agency"),
                    F.concat(F.lit("#"), F.upper(F.substring("p_type", 1, 3))).alias("l_color"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored route responses (JSON text), one per order with line items.

    Every 97th order has no route (``[]``); every 89th has a leg without departure
    and arrival times.  The steps of one response are gathered with
    ``collect_list`` per order -- a response holds one order's handful of legs.
    """
    f = leg_facts(spark, sf_dir)
    ln = F.col("l_linenumber")
    k = F.col("l_orderkey")

    def coord(prefix: str, key: str) -> Column:
        return try_cast(F.concat(F.lit(prefix), F.lpad(_s(F.col(key) % 10000), 4, "0")), "double")

    end_lat = (F.when(ln == 6, F.lit(40.0)).when(ln == 7, F.lit(-33.8688))
               .otherwise(coord("40.", "l_suppkey")))
    step = F.struct(
        F.struct(F.lit("1 km").alias("text"), F.floor("l_extendedprice").cast("bigint").alias("value")).alias("distance"),
        F.struct(F.lit("1 min").alias("text"), (F.col("l_quantity") * 37).cast("bigint").alias("value")).alias("duration"),
        F.struct(end_lat.alias("lat"), coord("-74.", "l_partkey").alias("lng")).alias("end_location"),
        F.struct(coord("40.", "l_partkey").alias("lat"), coord("-73.", "l_suppkey").alias("lng")).alias("start_location"),
        F.when(F.col("walking"), F.concat(F.lit("Walk to S"), _s("l_suppkey")))
         .otherwise(F.concat(_vehicle(ln, 1), F.lit(" towards A"), _s("l_suppkey"))).alias("html_instructions"),
        F.when(F.col("walking"), F.lit("WALKING")).otherwise(F.lit("TRANSIT")).alias("travel_mode"),
        F.struct(F.lit("abc").alias("points")).alias("polyline"),
        F.when(F.col("walking"), F.array(F.struct(F.lit("WALKING").alias("travel_mode")))).alias("steps"),
        F.when(~F.col("walking"), _transit_json(ln)).alias("transit_details"),
    )
    per_order = (f.groupBy("l_orderkey").agg(
        F.first("geoid").alias("geoid"), F.first("school_id").alias("school_id"),
        F.first("is_morning").alias("is_morning"), F.first("dep_minute").alias("dep_minute"),
        F.first("arr_minute").alias("arr_minute"), F.first("o_orderdate").alias("o_orderdate"),
        F.sort_array(F.collect_list(F.struct("leg_index", step.alias("step")))).alias("steps")))
    no_times = (k % NO_LEG_TIMES_EVERY) == 0
    dep = F.struct(_clock(F.col("dep_minute")).alias("text"),
                   (F.col("dep_minute") * 60).cast("bigint").alias("value"))
    arr = F.struct(_clock(F.col("arr_minute")).alias("text"),
                   (F.col("arr_minute") * 60).cast("bigint").alias("value"))
    leg = F.struct(F.when(~no_times, dep).alias("departure_time"),
                   F.when(~no_times, arr).alias("arrival_time"),
                   F.transform("steps", lambda s: s["step"]).alias("steps"))
    route = F.array(F.struct(F.array(leg).alias("legs")))
    response = F.when((k % FAILED_EVERY) == 0, F.lit("[]")).otherwise(F.to_json(route))
    return per_order.select(
        F.when(F.col("is_morning"), F.col("geoid")).otherwise(F.col("school_id")).alias("origin"),
        F.when(F.col("is_morning"), F.col("school_id")).otherwise(F.col("geoid")).alias("destination"),
        response.alias("response"))
