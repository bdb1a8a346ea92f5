"""Expected role tables as DuckDB SQL, computed from plain driver-table columns.

These CTEs state what each role table must contain (FIXTURES.md); the Spark
side builds the fetcher's text rows and parses them, so an oracle match checks
the parsers, the NA rules, the rounding and the trip-level aggregates.
"""

from __future__ import annotations


def D(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def clock(m: str) -> str:
    return (f"CAST((({m}) // 60 + 11) % 12 + 1 AS VARCHAR) || ':' || "
            f"lpad(CAST(({m}) % 60 AS VARCHAR), 2, '0') || ' ' || "
            f"CASE WHEN ({m}) // 60 < 12 THEN 'AM' ELSE 'PM' END")


VEH_TYPE = ("CASE ln WHEN 1 THEN 'BUS' WHEN 2 THEN 'FERRY' WHEN 3 THEN 'HEAVY_RAIL' "
            "WHEN 4 THEN 'TRAM' ELSE 'SUBWAY' END")
VEH_NAME = ("CASE ln WHEN 1 THEN 'Bus' WHEN 2 THEN 'Ferry' WHEN 3 THEN 'Train' "
            "WHEN 4 THEN 'Tram' ELSE 'Subway' END")
RAW_AGENCY = ("CASE p_type WHEN 'ECONOMY' THEN 'MTA New York City Transit' WHEN 'SMALL' THEN 'MTA' "
              "WHEN 'PROMO' THEN 'NJ TRANSIT BUS' ELSE p_type END")
AGENCY = ("CASE p_type WHEN 'ECONOMY' THEN 'MTA - NYC Subway' WHEN 'SMALL' THEN 'MTA - NYC Bus' "
          "WHEN 'PROMO' THEN 'NJ Transit Bus' ELSE p_type END")
COLOR = "'#' || lpad(CAST(pk % 1000000 AS VARCHAR), 6, '0')"
TEXT_COLOR = "CASE WHEN sk % 2 = 0 THEN '#000000' ELSE '#FFFFFF' END"
PK4 = "lpad(CAST(pk % 10000 AS VARCHAR), 4, '0')"
SK4 = "lpad(CAST(sk % 10000 AS VARCHAR), 4, '0')"

FACTS = f"""
lf AS (
  SELECT l.l_orderkey AS k, l.l_linenumber AS ln, l.l_partkey AS pk, l.l_suppkey AS sk,
         l.l_quantity AS qty, l.l_extendedprice AS price, l.l_shipdate AS shipdate,
         p.p_type, p.p_brand, o.o_orderdate,
         (l.l_orderkey % 2 = 0) AS is_morning,
         (l.l_orderkey % 97 = 0) AS failed,
         (l.l_returnflag = 'A') AS walking,
         ROW_NUMBER() OVER (PARTITION BY l.l_orderkey
                            ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice) - 1 AS leg_index,
         20 + (l.l_orderkey * 7) % 90 AS trip_minutes,
         CASE WHEN l.l_orderkey % 2 = 0 THEN 420 ELSE 1020 END + l.l_orderkey % 60 AS dep_minute,
         CAST((l.l_orderkey // 2) % 150 AS VARCHAR) AS geoid,
         CAST((l.l_orderkey // 2) // 150 AS VARCHAR) AS school_id,
         (l.l_orderkey // 2) // 150 AS school_num,
         CASE WHEN l.l_orderkey % 2 = 0 THEN 'morning' ELSE 'evening' END AS run,
         strftime(o.o_orderdate, '%m/%d/%Y') AS date_text
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN orders o ON l.l_orderkey = o.o_orderkey
),
lf2 AS (
  SELECT *,
         CASE WHEN is_morning THEN geoid ELSE school_id END AS origin,
         CASE WHEN is_morning THEN school_id ELSE geoid END AS destination,
         dep_minute + trip_minutes AS arr_minute,
         school_num - school_num % 2 AS start_index
  FROM lf
)"""

TRANSIT_TEXT = (
    "$${'arrival_stop': {'location': {'lat': 40.7, 'lng': -73.9}, 'name': 'A$$ || CAST(sk AS VARCHAR) || "
    f"$$'}}, 'arrival_time': {{'text': '$$ || replace({clock('arr_minute')}, ' ', '\\u202f') || "
    "$$', 'time_zone': 'America/New_York', 'value': 1}, 'departure_stop': {'location': "
    "{'lat': 40.6, 'lng': -73.9}, 'name': 'S$$ || CAST(sk AS VARCHAR) || "
    f"$$'}}, 'departure_time': {{'text': '$$ || replace({clock('dep_minute')}, ' ', '\\u202f') || "
    "$$', 'time_zone': 'America/New_York', 'value': 1}, 'headsign': 'H$$ || CAST(pk AS VARCHAR) || "
    f"$$', 'line': {{'agencies': [{{'name': '$$ || {RAW_AGENCY} || "
    f"$$', 'phone': '1', 'url': 'u'}}], 'color': '$$ || {COLOR} || $$', $$ || "
    "CASE WHEN ln = 5 THEN '' ELSE $$'name': '$$ || "
    "CASE WHEN ln = 3 THEN p_brand || ', NYC Subway' ELSE p_brand END || $$', $$ END || "
    f"$$'short_name': 'L$$ || CAST(ln AS VARCHAR) || $$', 'text_color': '$$ || {TEXT_COLOR} || "
    f"$$', 'vehicle': {{'icon': 'i', 'name': '$$ || {VEH_NAME} || $$', 'type': '$$ || {VEH_TYPE} || "
    "$$'}}, 'num_stops': $$ || CAST(ln AS VARCHAR) || '}'"
)

SOURCE_COLS = """
         run AS source_run,
         'key' || CAST(school_num % 3 AS VARCHAR) AS source_apik,
         start_index AS source_start_index,
         start_index + 2 AS source_end_index,
         CAST(2 AS BIGINT) AS source_coverage,
         run || '_key' || CAST(school_num % 3 AS VARCHAR) || '_' || CAST(start_index AS VARCHAR) || '-'
           || CAST(start_index + 2 AS VARCHAR) || '.csv' AS source_filename"""

RAW = f"""
raw AS (
  SELECT
    CAST(leg_index AS VARCHAR) AS l_number,
    CASE WHEN failed THEN '-999' ELSE $${{'text': '1 km', 'value': $$ || CAST(CAST(FLOOR(price) AS BIGINT) AS VARCHAR) || '}}' END AS distance,
    CASE WHEN failed THEN '-999' ELSE $${{'text': '1 min', 'value': $$ || CAST(CAST(qty * 37 AS BIGINT) AS VARCHAR) || '}}' END AS duration,
    CASE WHEN failed THEN '-999' ELSE $${{'lat': $$ || (CASE WHEN ln = 6 THEN '40' WHEN ln = 7 THEN '-33.8688' ELSE '40.' || {SK4} END)
         || $$, 'lng': -74.$$ || {PK4} || '}}' END AS end_location,
    CASE WHEN failed THEN '-999' WHEN walking THEN 'Walk to S' || CAST(sk AS VARCHAR)
         ELSE {VEH_NAME} || ' towards A' || CAST(sk AS VARCHAR) END AS html_instructions,
    CASE WHEN failed THEN '-999' ELSE $${{'lat': 40.$$ || {PK4} || $$, 'lng': -73.$$ || {SK4} || '}}' END AS start_location,
    CASE WHEN failed THEN '-999' WHEN walking THEN $$[{{'travel_mode': 'WALKING'}}]$$ ELSE NULL END AS steps,
    CASE WHEN failed THEN '-999' WHEN walking THEN 'WALKING' ELSE 'TRANSIT' END AS travel_mode,
    CASE WHEN failed THEN '-999' WHEN walking THEN NULL ELSE {TRANSIT_TEXT} END AS transit_details,
    origin, destination,
    CASE WHEN failed THEN '-999' ELSE {clock('dep_minute')} END AS actual_departure,
    CASE WHEN failed THEN '-999' ELSE {clock('arr_minute')} END AS actual_arrival,
    CASE WHEN failed THEN '-999.0' ELSE CAST(trip_minutes AS VARCHAR) || '.0' END AS total_time,
    date_text || ' 12:' || lpad(CAST(k % 60 AS VARCHAR), 2, '0') || ':00 EST' AS request_time,
    CASE WHEN is_morning THEN NULL ELSE date_text || ' 17:00:00 EST' END AS depart_time,
    CASE WHEN is_morning THEN date_text || ' 09:00:00 EST' ELSE NULL END AS arrival_time,
    'standard' AS transit_routing_preference,{SOURCE_COLS}
  FROM lf2
)"""

PARSED = f"""
pl AS (
  SELECT
    geoid || '-' || school_id AS odid, run, origin, destination, school_id, geoid,
    CAST(leg_index + 1 AS INTEGER) AS l_number,
    CASE WHEN failed THEN NULL ELSE round_even({D('CAST(qty * 37 AS BIGINT)')} / {D('60')}, 2) END AS l_travelmins,
    CASE WHEN failed THEN NULL ELSE CAST(FLOOR(price) AS BIGINT) END AS l_distance,
    CASE WHEN failed OR ln IN (6, 7) THEN NULL ELSE CAST('40.' || {SK4} AS DOUBLE) END AS l_lat_arr,
    CASE WHEN failed THEN NULL ELSE CAST('-74.' || {PK4} AS DOUBLE) END AS l_lon_arr,
    CASE WHEN failed THEN NULL ELSE CAST('40.' || {PK4} AS DOUBLE) END AS l_lat_dep,
    CASE WHEN failed THEN NULL ELSE CAST('-73.' || {SK4} AS DOUBLE) END AS l_lon_dep,
    CASE WHEN failed THEN NULL WHEN walking THEN 'WALKING' ELSE 'TRANSIT' END AS l_mode,
    CASE WHEN failed OR walking THEN NULL ELSE 'S' || CAST(sk AS VARCHAR) END AS l_dep_stop,
    CASE WHEN failed OR walking THEN NULL ELSE 'A' || CAST(sk AS VARCHAR) END AS l_arr_stop,
    CASE WHEN failed OR walking THEN NULL ELSE o_orderdate + to_minutes(dep_minute) END AS l_dep_time,
    CASE WHEN failed OR walking THEN NULL ELSE o_orderdate + to_minutes(arr_minute) END AS l_arr_time,
    CASE WHEN failed THEN NULL WHEN walking THEN 'Walk to S' || CAST(sk AS VARCHAR)
         ELSE {VEH_NAME} || ' towards A' || CAST(sk AS VARCHAR) END AS l_instructions,
    CASE WHEN failed OR walking THEN NULL ELSE {AGENCY} END AS l_agency,
    CASE WHEN failed OR walking THEN NULL WHEN ln = 5 THEN 'Subway' ELSE p_brand END AS l_line,
    CASE WHEN failed OR walking THEN NULL ELSE {COLOR} END AS l_color,
    CASE WHEN failed OR walking THEN NULL ELSE {TEXT_COLOR} END AS l_text_color,
    CASE WHEN failed OR walking THEN NULL ELSE {VEH_TYPE} END AS l_vehicle,
    CASE WHEN failed OR walking THEN NULL ELSE CAST(ln AS INTEGER) END AS l_num_stops,
    CASE WHEN failed THEN NULL ELSE o_orderdate + to_minutes(dep_minute) END AS t_departure,
    CASE WHEN failed THEN NULL ELSE o_orderdate + to_minutes(arr_minute) END AS t_arrival,
    CASE WHEN failed THEN NULL ELSE {D('trip_minutes')} END AS t_time,
    o_orderdate + to_minutes(CASE WHEN is_morning THEN 540 ELSE 1020 END) AS t_set,
    CASE WHEN failed THEN NULL WHEN is_morning THEN {D('540 - dep_minute')}
         ELSE {D('arr_minute - 1020')} END AS t_set_actual,
    date_text || ' 12:' || lpad(CAST(k % 60 AS VARCHAR), 2, '0') || ':00 EST' AS source_request_time,{SOURCE_COLS},
    CASE WHEN is_morning THEN date_text || ' 09:00:00 EST' ELSE date_text || ' 17:00:00 EST' END AS source_t_set,
    date_text AS source_t_set_date,
    failed, walking, k, ln, sk, pk, qty, price, shipdate, o_orderdate, p_type, p_brand
  FROM lf2
)"""

LEG_COLUMNS = (
    "odid", "run", "origin", "destination", "school_id", "geoid", "l_number", "l_travelmins",
    "l_distance", "l_mode", "l_dep_stop", "l_arr_stop", "l_agency", "l_line", "l_color",
    "l_text_color", "l_vehicle", "l_num_stops", "t_departure", "t_arrival", "t_time",
    "t_waiting", "t_transfer", "source_request_time", "source_filename", "source_run",
    "source_apik", "source_start_index", "source_end_index", "source_coverage", "source_t_set",
    "source_t_set_date",
)

LEGS = f"""
tm AS (
  SELECT odid, origin, destination,
         CAST(round_even(COALESCE(SUM(CAST(l_travelmins AS DECIMAL(12,2))), 0), 0) AS DOUBLE) AS t_travelmins
  FROM pl GROUP BY odid, origin, destination
),
tr AS (
  SELECT odid, run, COUNT(*) FILTER (WHERE l_mode = 'TRANSIT') - 1 AS t_transfer
  FROM pl WHERE t_time < 100 GROUP BY odid, run
),
legs AS (
  SELECT {', '.join('pl.' + c for c in LEG_COLUMNS if c not in ('t_waiting', 't_transfer'))},
         pl.t_time - tm.t_travelmins AS t_waiting, tr.t_transfer, tm.t_travelmins
  FROM pl
  JOIN tm ON pl.odid = tm.odid AND pl.origin = tm.origin AND pl.destination = tm.destination
  JOIN tr ON pl.odid = tr.odid AND pl.run = tr.run
  WHERE pl.t_time < 100
)"""

TRIP_REST = ("odid", "origin", "destination", "school_id", "geoid", "run", "t_departure",
             "t_arrival", "t_time", "t_waiting", "t_transfer", "source_request_time",
             "source_filename", "source_run", "source_apik", "source_start_index",
             "source_end_index", "source_coverage", "source_t_set", "source_t_set_date")
TRIP_COUNTS = """MAX(l_number) AS t_nlegs,
         COUNT(*) FILTER (WHERE l_mode = 'WALKING') AS t_walking,
         COUNT(*) FILTER (WHERE l_mode = 'TRANSIT') AS t_transit,
         COUNT(*) FILTER (WHERE l_vehicle = 'BUS') AS t_bus,
         COUNT(*) FILTER (WHERE l_vehicle = 'FERRY') AS t_ferry,
         COUNT(*) FILTER (WHERE l_vehicle = 'HEAVY_RAIL') AS t_heavyrail,
         COUNT(*) FILTER (WHERE l_vehicle = 'SUBWAY') AS t_subway,
         COUNT(*) FILTER (WHERE l_vehicle = 'TRAM') AS t_tram"""
TRIP_COLUMNS = TRIP_REST[:6] + ("t_nlegs", "t_walking", "t_transit", "t_bus", "t_ferry",
                                "t_heavyrail", "t_subway", "t_tram") + TRIP_REST[6:]

TRIPS = f"""
trips AS (
  SELECT {', '.join(TRIP_REST)},
         {TRIP_COUNTS}
  FROM legs GROUP BY {', '.join(TRIP_REST)}
)"""

PERCENTS = (("percent male", "tot // 16"), ("percent female", "tot - tot // 16"),
            ("percent white", "tot // 3"), ("percent black", "tot // 4"),
            ("percent hispanic", "tot // 5"), ("percent aapi", "tot // 7 + tot // 11"))


def share_pct(num: str, den: str) -> str:
    """100 * half-even round of num/den to 3 places, by exact integer arithmetic."""
    q = f"((1000 * ({num})) // ({den}))"
    r = f"((1000 * ({num})) % ({den}))"
    rounded = f"({q} + CASE WHEN 2 * {r} > ({den}) THEN 1 WHEN 2 * {r} = ({den}) THEN {q} % 2 ELSE 0 END)"
    return f"CASE WHEN ({den}) = 0 THEN NULL ELSE {D('100')} * ({D(rounded)} / {D('1000')}) END"


IPEDS_BASE = """
ipb AS (
  SELECT s.s_suppkey AS key, s.s_name, s.s_acctbal, n.n_name,
         CASE WHEN s.s_suppkey % 17 = 0 THEN CAST(0 AS BIGINT)
              ELSE CAST(FLOOR(ABS(s.s_acctbal)) AS BIGINT) END AS tot
  FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey
)"""

SIZE = ("CASE WHEN tot < 1000 THEN 'Under 1,000' WHEN tot < 5000 THEN '1,000 - 4,999' "
        "WHEN tot < 10000 THEN '5,000 - 9,999' WHEN tot < 20000 THEN '10,000 - 19,999' "
        "ELSE '20,000 and above' END")
SECTOR = "CASE key % 3 WHEN 0 THEN 'Public' WHEN 1 THEN 'Private nonprofit' ELSE 'Private for-profit' END"
LEVEL = "CASE key % 2 WHEN 0 THEN '2-year' ELSE '4-year or higher' END"
DTYPES = ("CASE key % 5 WHEN 0 THEN 'Associate' WHEN 1 THEN 'Baccalaureate' WHEN 2 THEN 'Doctoral' "
          "WHEN 3 THEN 'Master''s' ELSE 'Special Focus' END")
ZIP = "lpad(CAST(key % 100000 AS VARCHAR), 5, '0')"

IPEDS = IPEDS_BASE + f""",
ip AS (
  SELECT CAST(key AS VARCHAR) AS "UNITID", s_name AS "INSTNM", 'Street ' || CAST(key AS VARCHAR) AS "ADDR",
         n_name AS "CITY", {ZIP} AS "ZIP", n_name AS "STABBR",
         {D('-73.5')} - {D('key')} / {D('1000.0')} AS "LONGITUD",
         {D('40.5')} + {D('key')} / {D('2000.0')} AS "LATITUDE",
         tot AS "EFYTOTLT", tot // 16 AS "EFYTOTLM", tot - tot // 16 AS "EFYTOTLW", tot // 3 AS "EFYWHITT",
         tot // 4 AS "EFYBKAAW", tot // 5 AS "EFYHISPT", tot // 7 AS "EFYASIAT", tot // 11 AS "EFYNHPIT",
         '1' AS "EFFYALEV", '1' AS "EFFYLEV", '1' AS "LSTUDY", '0' AS "own_THEOLOG", '0' AS "own_OPEFLAG",
         '0' AS "own_FORPROFIT", {D('-73.95')} AS "LON_CTR", {D('40.65')} AS "LAT_CTR",
         ABS(s_acctbal) / {D('400.0')} AS crow_flies, '1' AS "own_ADMCON7", 1 AS "ADMSSN", 2 AS "APPLCN",
         {SIZE} AS "own_SIZE", {SECTOR} AS "own_SECTOR", {LEVEL} AS "own_DEGREE_LEVEL",
         {DTYPES} AS "own_DEGREE_TYPES", 'C' || CAST(key % 7 AS VARCHAR) AS "own_CARNEGIE",
         CASE WHEN key % 4 = 0 THEN 'Yes' ELSE 'No' END AS "own_MULTICAMPUS",
         {DTYPES} AS "own_IPEDS_CATEGORY"
  FROM ipb
)"""

SCHOOL_PERCENTS = ",\n         ".join(f'{share_pct(num, "tot")} AS "{name}"' for name, num in PERCENTS)
SCHOOLS = IPEDS_BASE + f""",
sch AS (
  SELECT CAST(key AS VARCHAR) AS school_id, s_name AS school_name,
         'Street ' || CAST(key AS VARCHAR) || ', ' || COALESCE(n_name, 'NA') || ', ' || {ZIP} AS address,
         n_name AS city, {ZIP} AS zip, n_name AS state,
         {D('-73.5')} - {D('key')} / {D('1000.0')} AS longitude,
         {D('40.5')} + {D('key')} / {D('2000.0')} AS latitude,
         tot AS enrolment, {SIZE} AS size, {SECTOR} AS sector, {LEVEL} AS degree_level,
         {DTYPES} AS degree_types, 'C' || CAST(key % 7 AS VARCHAR) AS carnegie,
         CASE WHEN key % 4 = 0 THEN 'Yes' ELSE 'No' END AS multicampus, {DTYPES} AS ipeds_category,
         {SCHOOL_PERCENTS}
  FROM ipb
)"""

TRIPS_FULL = """
tf AS (
  SELECT trips.*, sch.enrolment FROM trips LEFT JOIN sch ON trips.school_id = sch.school_id
)"""

AREAS = """
bg AS (SELECT CAST(c_custkey AS VARCHAR) AS geoid, c_name AS name, c_custkey FROM customer)"""

ACS = f"""
acs AS (
  SELECT CAST(c_custkey AS VARCHAR) AS geoid, c_mktsegment AS concept,
         'v' || CAST(c_nationkey % 3 AS VARCHAR) AS label,
         {D('FLOOR(ABS(c_acctbal))')} AS estimate,
         {D('FLOOR(ABS(c_acctbal))')} / {D('100.0')} AS percent
  FROM customer
)"""

LEG_COLORS = """
lc AS (
  SELECT DISTINCT p_brand AS l_line,
         '#' || lpad(CAST(CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INTEGER) * 7 AS VARCHAR), 6, '0') AS l_color
  FROM part WHERE CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INTEGER) % 5 <> 0
)"""

AGENCY_COLORS = f"""
ac AS (
  SELECT DISTINCT {AGENCY} AS l_agency, '#' || upper(substr(p_type, 1, 3)) AS l_color
  FROM part WHERE p_type <> 'LARGE'
)"""

# name -> (sql, dependencies)
CTES = {
    "facts": (FACTS, ()),
    "raw": (RAW, ("facts",)),
    "parsed": (PARSED, ("facts",)),
    "legs": (LEGS, ("parsed",)),
    "trips": (TRIPS, ("legs",)),
    "ipeds": (IPEDS, ()),
    "schools": (SCHOOLS, ()),
    "trips_full": (TRIPS_FULL, ("trips", "schools")),
    "areas": (AREAS, ()),
    "acs": (ACS, ()),
    "leg_colors": (LEG_COLORS, ()),
    "agency_colors": (AGENCY_COLORS, ()),
}


def with_ctes(*names: str, extra: str = "") -> str:
    """A WITH clause holding ``names`` and their dependencies, in order."""
    order: list[str] = []

    def add(n):
        if n in order:
            return
        for dep in CTES[n][1]:
            add(dep)
        order.append(n)

    for n in names:
        add(n)
    parts = []
    for n in order:
        sql = CTES[n][0].strip()
        # ipeds and schools share the ``ipb`` base CTE
        if n in ("ipeds", "schools") and ("ipeds" in order and "schools" in order) and n == order[
                max(order.index("ipeds"), order.index("schools"))]:
            sql = sql.split("),\n", 1)[1].strip()
        parts.append(sql)
    if extra:
        parts.append(extra.strip())
    return "WITH " + ",\n".join(parts) + "\n"
