"""Registered queries: one per operator of the inventory, each with its DuckDB oracle.

``QUERIES[name] = (spark_fn, oracle_sql_or_None)``.  Every query reads the
driver tables (through the role mapping) over their whole extent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse as P
from ..functions.columns import extract_or_null, semi_in
from ..functions.geo import EARTH_MILES, multipolygon_centroid, polygon_centroid
from ..operators import census as C
from ..operators import columns as CO
from ..operators import coverage as CV
from ..operators import facets as FA
from ..operators import filters as FL
from ..operators import legs as L
from ..operators import measure as M
from ..operators import nearby as NB
from ..operators import refetch as RF
from ..operators import schools as S
from ..operators import shares as SH
from ..operators import trips as T
from ..operators import validate as V
from ..params import AccessParams
from ..plans import acquire as A
from ..plans import cube as CB
from ..plans import pages as PG
from ..plans import serve as SV
from ..plans import sql_functions as SQ
from ..session import scratch_path, shuffle_files_dropped
from ..sources import batches as B
from ..sources import fixtures as fx
from ..sources import shapefile as SHP
from ..sources import sinks as SK
from . import roles as R
from .oracle_tables import (AGENCY, LEG_COLUMNS, PERCENTS, RAW_AGENCY, TRANSIT_TEXT, TRIP_COLUMNS,
                            TRIP_COUNTS, TRIP_REST, D, clock, with_ctes)

QUERIES: dict[str, tuple] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return deco


def cols(names) -> str:
    return ", ".join(f'"{c}"' for c in names)


RAW_COLS = ("l_number", "distance", "duration", "end_location", "html_instructions", "start_location",
            "steps", "travel_mode", "transit_details", "origin", "destination", "actual_departure",
            "actual_arrival", "total_time", "request_time", "depart_time", "arrival_time",
            "transit_routing_preference", "source_filename", "source_run", "source_apik",
            "source_start_index", "source_end_index", "source_coverage")
KEY = ("odid", "run", "l_number")
SCHOOL_COLS = ("school_id", "school_name", "address", "city", "zip", "state", "longitude", "latitude",
               "enrolment", "size", "sector", "degree_level", "degree_types", "carnegie", "multicampus",
               "ipeds_category") + tuple(n for n, _ in PERCENTS)
IPEDS_COLS = ("UNITID", "INSTNM", "ADDR", "CITY", "ZIP", "STABBR", "LONGITUD", "LATITUDE", "EFYTOTLT",
              "EFYTOTLM", "EFYTOTLW", "EFYWHITT", "EFYBKAAW", "EFYHISPT", "EFYASIAT", "EFYNHPIT",
              "EFFYALEV", "EFFYLEV", "LSTUDY", "own_THEOLOG", "own_OPEFLAG", "own_FORPROFIT", "LON_CTR",
              "LAT_CTR", "crow_flies", "own_ADMCON7", "ADMSSN", "APPLCN", "own_SIZE", "own_SECTOR",
              "own_DEGREE_LEVEL", "own_DEGREE_TYPES", "own_CARNEGIE", "own_MULTICAMPUS",
              "own_IPEDS_CATEGORY")
PARAM_COLS = ("time_cutoff", "trip_am_pm", "trip_max_transfers", "school_sizes", "school_sectors",
              "school_degree_levels", "school_degree_types", "school_carnegie")


def half_even(num: str, den: str, digits: int, factor: int = 1) -> str:
    """round_half_even(factor * num / den, digits) by exact integer arithmetic, as DOUBLE."""
    scale = 10 ** digits
    q = f"(({factor * scale} * ({num})) // ({den}))"
    r = f"(({factor * scale} * ({num})) % ({den}))"
    rounded = f"({q} + CASE WHEN 2 * {r} > ({den}) THEN 1 WHEN 2 * {r} = ({den}) THEN {q} % 2 ELSE 0 END)"
    return f"({D(rounded)} / {D(str(scale))})"


def sel_ctes(p: AccessParams) -> str:
    """``sel`` (selected schools), ``st`` (selected trips) and ``sl`` (selected legs)."""
    run = R.sql_run(p)
    return (R.sql_selected_schools(p) + ",\n"
            f"st AS (SELECT * FROM tf WHERE t_time <= {p.cutoff} AND t_transit <= {p.transfers + 1}{run} "
            "AND school_id IN (SELECT school_id FROM sel)),\n"
            f"sl AS (SELECT * EXCLUDE (t_travelmins) FROM legs WHERE t_time <= {p.cutoff} "
            f"AND t_transfer <= {p.transfers}{run} AND school_id IN (SELECT school_id FROM sel))")


def acc_sql(p: AccessParams, semi: bool = True, with_params: bool = True, select: str = "SELECT * FROM acc",
            more=()) -> str:
    extra = (sel_ctes(p) + ",\n" if semi else "") + R.sql_accessibility(p, semi, with_params)
    return with_ctes("trips_full", "areas", "legs", *more, extra=extra) + select


def acs_sel(concept: str, label: str) -> str:
    return f"acs_sel AS (SELECT * FROM acs WHERE concept = '{concept}' AND label = '{label}')"


def T_(spark, d) -> SV.Tables:
    return R.tables(spark, d)


def written_back(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(spark, name)
    SK.write_csv(df, path)
    return SK.read_csv_back(spark, path, df)


# ======================================================================== 2.1 sources
def batch_folder(spark, d):
    """The raw rows written as the fetcher's batch CSV files (once per session)."""
    def write(path):
        raw = fx.raw_steps(spark, d, with_source=False, by_batch=True)
        SK.write_batches(raw.withColumnRenamed("l_number", B.INDEX_COLUMN), path, clustered=True)
    return R.stored_folder(spark, d, "batches", write)


@query("load_batches", with_ctes("raw") + f"SELECT {cols(RAW_COLS)} FROM raw")
def q_load_batches(spark, d):
    return B.load_batches(spark, batch_folder(spark, d)).select(*RAW_COLS)


@query("file_metadata", with_ctes("raw") +
       "SELECT DISTINCT source_filename, source_run, source_apik, source_start_index, source_end_index, "
       "source_coverage FROM raw")
def q_file_metadata(spark, d):
    return B.load_batches(spark, batch_folder(spark, d)).select(
        "source_filename", "source_run", "source_apik", "source_start_index", "source_end_index",
        "source_coverage").distinct()


@query("rename_index", with_ctes("raw") + "SELECT l_number, COUNT(*) AS count FROM raw GROUP BY l_number")
def q_rename_index(spark, d):
    return B.load_batches(spark, batch_folder(spark, d)).groupBy("l_number").agg(
        F.count(F.lit(1)).alias("count"))


@query("load_snapshot", with_ctes("trips_full") + "SELECT * FROM tf")
def q_load_snapshot(spark, d):
    path = scratch_path(spark, "snapshot")
    R.trips_full(spark, d).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@query("read_schools", with_ctes("ipeds") + f"SELECT {cols(IPEDS_COLS)} FROM ip")
def q_read_schools(spark, d):
    ip = fx.ipeds(spark, d)
    return written_back(spark, ip, "ipeds")


@query("read_polygons", with_ctes("areas") +
       "SELECT geoid, name, 1 AS n_rings, 5 AS n_vertices, CAST(c_custkey AS DOUBLE) AS x0, "
       "CAST(0 AS DOUBLE) AS y0 FROM bg")
def q_read_polygons(spark, d):
    polys = R.areas(spark, d, geometry=True)
    path = scratch_path(spark, "polygons")
    polys.write.mode("overwrite").json(path)
    back = spark.read.schema(polys.schema).json(path)
    return back.select("geoid", "name", F.size("geometry").alias("n_rings"),
                       F.size(F.get("geometry", 0)).alias("n_vertices"),
                       F.get(F.get("geometry", 0), 0)["x"].alias("x0"),
                       F.get(F.get("geometry", 0), 0)["y"].alias("y0"))


@query("read_shapefile", with_ctes("areas") + """, parts AS (
  SELECT geoid, name, CAST(c_custkey AS DOUBLE) AS k, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS hole,
    CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS island FROM bg)
SELECT geoid, name, 1 + island AS n_polygons, 1 + hole + island AS n_rings, 5 * (1 + hole + island) AS n_vertices,
  ROUND((8 * (k + 2) - hole * (k + 1.5) + island * 4 * (k + 11)) / (8 - hole + 4 * island), 6) AS centroid_x,
  ROUND((8 - hole * 0.75 + island * 4) / (8 - hole + 4 * island), 6) AS centroid_y FROM parts""")
def q_read_shapefile(spark, d):
    """Areas with holes (every third) and islands (every fifth), through polygon files and back."""
    SHP.register(spark)
    path = scratch_path(spark, "shapefile")
    fx.areas_with_parts(spark, d).write.format("shapefile").mode("append").save(path)
    back = spark.read.format("shapefile").load(path)
    c = multipolygon_centroid(F.col("geometry"))
    rings = F.flatten("geometry")
    return back.select("geoid", "name", F.size("geometry").alias("n_polygons"), F.size(rings).alias("n_rings"),
                       F.size(F.flatten(rings)).alias("n_vertices"), F.round(c["x"], 6).alias("centroid_x"),
                       F.round(c["y"], 6).alias("centroid_y"))


@query("preview", with_ctes("schools") +
       f"SELECT {cols(SCHOOL_COLS)} FROM sch ORDER BY CAST(school_id AS BIGINT) LIMIT 5")
def q_preview(spark, d):
    s = R.schools(spark, d)
    return s.orderBy(F.col("school_id").cast("bigint")).limit(5)


# ======================================================================== 2.2 sinks
@query("write_batch", with_ctes("raw") + f"SELECT {cols(RAW_COLS)} FROM raw")
def q_write_batch(spark, d):
    root = scratch_path(spark, "write-batch")
    raw = fx.raw_steps(spark, d)          # written by the sink alone: no stored copy beside it
    name = SK.write_batch(raw, root, "all", "key", 0, 126)
    return spark.read.parquet(f"{root}/{name}.parquet").select(*RAW_COLS)


@query("export_schools", acc_sql(R.P_SUBSET, select=(
    "SELECT * FROM sel WHERE school_id IN (SELECT school_id FROM st)")))
def q_export_schools(spark, d):
    return written_back(spark, SV.schools_table(T_(spark, d), R.P_SUBSET), "export-schools")


@query("export_blockgroups", acc_sql(R.P_SUBSET))
def q_export_blockgroups(spark, d):
    return written_back(spark, SV.blockgroups_table(T_(spark, d), R.P_SUBSET), "export-counts")


@query("export_trips", acc_sql(R.P_SUBSET, select="SELECT * EXCLUDE (enrolment) FROM st"))
def q_export_trips(spark, d):
    return written_back(spark, SV.trips_table(T_(spark, d), R.P_SUBSET), "export-trips")


@query("export_legs", acc_sql(R.P_SUBSET, select="SELECT * FROM sl"))
def q_export_legs(spark, d):
    sel = SV.select(T_(spark, d), R.P_SUBSET)
    return written_back(spark, sel.legs, "export-legs")


CENSUS_SELECT = ("SELECT acc.geoid, acc.schools_accessible, acc.slots_accessible, acc.name, "
                 "a.concept, a.label, a.estimate, a.percent, " + ", ".join(f"acc.{c}" for c in PARAM_COLS) +
                 " FROM acc LEFT JOIN acs_sel a ON acc.geoid = a.geoid")


def census_sql(p: AccessParams, select: str = CENSUS_SELECT) -> str:
    extra = (sel_ctes(p) + ",\n" + R.sql_accessibility(p) + ",\n" + acs_sel(p.concept, p.variable))
    return with_ctes("trips_full", "areas", "legs", "acs", extra=extra) + select


@query("export_census", census_sql(R.P_CENSUS))
def q_export_census(spark, d):
    return written_back(spark, SV.census_table(T_(spark, d), R.P_CENSUS), "export-census")


PAGE_ORDER = ("schools_accessible DESC NULLS LAST, geoid ASC NULLS FIRST, slots_accessible ASC NULLS FIRST, "
              "name ASC NULLS FIRST, " + ", ".join(f"{c} ASC NULLS FIRST" for c in PARAM_COLS))


@query("export_page", acc_sql(R.P_SUBSET, select=f"SELECT * FROM acc ORDER BY {PAGE_ORDER} LIMIT 10"))
def q_export_page(spark, d):
    page = FL.table_page(SV.blockgroups_table(T_(spark, d), R.P_SUBSET),
                         order_by="schools_accessible", descending=True, page=0, page_size=10)
    return written_back(spark, page, "export-page")


# ======================================================================== 2.3 projections
@query("select_columns", with_ctes("trips") + "SELECT odid, run, geoid, school_id, t_time FROM trips")
def q_select_columns(spark, d):
    return CO.select_columns(R.trips(spark, d), "odid", "run", "geoid", "school_id", "t_time")


@query("drop_columns", with_ctes("legs") +
       "SELECT * EXCLUDE (l_color, l_text_color, source_request_time, t_travelmins) FROM legs")
def q_drop_columns(spark, d):
    return CO.drop_columns(R.legs(spark, d), "l_color", "l_text_color", "source_request_time")


@query("drop_prefix", with_ctes("legs") +
       "SELECT * EXCLUDE (t_departure, t_arrival, t_time, t_waiting, t_transfer, t_travelmins) FROM legs")
def q_drop_prefix(spark, d):
    return CO.drop_prefix(R.legs(spark, d), "T_")


@query("rename_columns", with_ctes("trips") +
       "SELECT odid, run, t_time AS minutes, t_transit AS transit_legs FROM trips")
def q_rename_columns(spark, d):
    t = R.trips(spark, d).select("odid", "run", "t_time", "t_transit")
    return CO.rename_columns(t, {"t_time": "minutes", "t_transit": "transit_legs"})


def _normalised(c: str) -> str:
    return c.lower().replace("own_", "", 1)


@query("normalise_names", with_ctes("ipeds") +
       "SELECT " + ", ".join(f'"{c}" AS "{_normalised(c)}"' for c in IPEDS_COLS) + " FROM ip")
def q_normalise_names(spark, d):
    return CO.normalise_names(fx.ipeds(spark, d))


@query("relocate_columns", with_ctes("trips") + "SELECT * FROM trips")
def q_relocate_columns(spark, d):
    return CO.relocate_columns(R.trips(spark, d), ["t_time", "t_transit"], after="run")


def _sentinel_sql(c: str) -> str:
    return (f"CASE WHEN \"{c}\" = '-999' OR TRY_CAST(\"{c}\" AS DOUBLE) = -999 THEN NULL "
            f"ELSE \"{c}\" END AS \"{c}\"")


@query("across_all", with_ctes("raw") + "SELECT " + ", ".join(_sentinel_sql(c) for c in RAW_COLS) + " FROM raw")
def q_across_all(spark, d):
    raw = R.raw(spark, d).select(*RAW_COLS)
    return CO.across_all(raw, P.sentinel_to_null)


@query("across_range", with_ctes("schools") +
       "SELECT school_id, " + cols(n for n, _ in PERCENTS) + " FROM sch")
def q_across_range(spark, d):
    ip = fx.ipeds(spark, d)
    shares = ip.select(
        F.col("UNITID").alias("school_id"),
        *[F.try_divide(sum((F.col(p) for p in parts[1:]), F.col(parts[0])).cast("double"),
                       F.col("EFYTOTLT").cast("double")).alias(name.lower())
          for name, parts in S.SHARE_COLUMNS])
    first, last = S.SHARE_COLUMNS[0][0].lower(), S.SHARE_COLUMNS[-1][0].lower()
    return CO.across_range(shares, first, last, lambda c: F.lit(100) * F.bround(c, 3))


@query("add_literals", with_ctes("areas") +
       "SELECT geoid, name, 'both' AS trip_am_pm, 'Public; Private nonprofit' AS school_sectors, "
       "60 AS time_cutoff FROM bg")
def q_add_literals(spark, d):
    a = R.areas(spark, d)
    return CO.add_literals(a, {"trip_am_pm": "both", "school_sectors": ["Public", "Private nonprofit"],
                               "time_cutoff": 60})


DERIVED = ("odid", "run", "origin", "destination", "school_id", "geoid", "l_number", "l_travelmins",
           "l_distance", "t_departure", "t_arrival", "t_time")


@query("derive_columns", with_ctes("parsed") + f"SELECT {cols(DERIVED)} FROM pl")
def q_derive_columns(spark, d):
    return R.parsed(spark, d).select(*DERIVED)


@query("metric_select", acc_sql(R.P_CENSUS, select="SELECT geoid, slots_accessible AS value FROM acc"))
def q_metric_select(spark, d):
    return M.metric_select(SV.accessibility(T_(spark, d), R.P_CENSUS), True).select("geoid", "value")


@query("pull_distinct", with_ctes("schools") + "SELECT DISTINCT carnegie FROM sch")
def q_pull_distinct(spark, d):
    return CO.pull_distinct(R.schools(spark, d), "carnegie")


# ======================================================================== 2.4 filters
@query("filter_institutions", acc_sql(R.P_SUBSET, select="SELECT * FROM sel"))
def q_filter_institutions(spark, d):
    return S.filter_institutions(R.schools(spark, d), R.P_SUBSET)


@query("filter_trips_params", acc_sql(R.P_SUBSET, select="SELECT * FROM st"))
def q_filter_trips_params(spark, d):
    return SV.select(T_(spark, d), R.P_SUBSET).trips


@query("filter_legs_params", acc_sql(R.P_MORNING, select="SELECT * FROM sl"))
def q_filter_legs_params(spark, d):
    return SV.select(T_(spark, d), R.P_MORNING).legs


@query("filter_run", with_ctes("trips") + "SELECT * FROM trips WHERE run = 'evening'")
def q_filter_run(spark, d):
    return FL.filter_run(R.trips(spark, d), "evening")


@query("filter_max_duration", with_ctes("parsed") +
       "SELECT odid, run, l_number, t_time FROM pl WHERE t_time < 100")
def q_filter_max_duration(spark, d):
    return FL.filter_max_duration(R.parsed(spark, d)).select("odid", "run", "l_number", "t_time")


@query("filter_cutoff_strict", with_ctes("trips") + "SELECT * FROM trips WHERE t_time < 60")
def q_filter_cutoff_strict(spark, d):
    return FL.filter_cutoff_strict(R.trips(spark, d), 60)


@query("filter_transit", with_ctes("legs") +
       "SELECT * EXCLUDE (t_travelmins) FROM legs WHERE l_mode = 'TRANSIT'")
def q_filter_transit(spark, d):
    return FL.filter_transit(R.legs_to_read(spark, d))


@query("filter_acs", with_ctes("acs") + "SELECT * FROM acs WHERE concept = 'BUILDING' AND label = 'v1'")
def q_filter_acs(spark, d):
    return FL.filter_acs(R.acs(spark, d), "BUILDING", "v1")


@query("cascade_choices", acc_sql(R.P_SUBSET, select="SELECT DISTINCT carnegie FROM sel"))
def q_cascade_choices(spark, d):
    return S.carnegie_choices(R.schools(spark, d), R.P_SUBSET)


def facet_sql(p: AccessParams) -> str:
    """Each picker's values, counted among the institutions the other pickers leave."""
    conds = {c: ("TRUE" if getattr(p, f) is None else R.sql_in(c, getattr(p, f))) for c, f in FA.PICKERS}
    return " UNION ALL ".join(
        f"SELECT '{c}' AS dimension, {c} AS value, COUNT(*) FILTER (" + " AND ".join(
            x for o, x in conds.items() if o != c) + f") AS n_schools, {conds[c]} AS chosen FROM sch GROUP BY {c}"
        for c in conds)


P_FACETS = AccessParams(sectors=("Public", "Private nonprofit"), sizes=("Under 1,000", "1,000 - 4,999"),
                        degree_types=("Associate", "Doctoral"), carnegie=("C1", "C2", "C3"))


@query("facet_counts", with_ctes("schools") + facet_sql(P_FACETS))
def q_facet_counts(spark, d):
    return FA.facet_counts(FA.bitmap_index(R.schools(spark, d)), P_FACETS)


@query("acs_choices", with_ctes("acs") +
       "SELECT DISTINCT label, concept, label = (SELECT MIN(label) FROM acs WHERE concept = 'BUILDING') "
       "AS is_default FROM acs WHERE concept = 'BUILDING'")
def q_acs_choices(spark, d):
    return FL.acs_choices(R.acs(spark, d), "BUILDING")


@query("non_empty_guard", with_ctes("schools", extra=R.sql_selected_schools(R.P_EMPTY)) +
       "SELECT COUNT(*) AS n_schools, CASE WHEN COUNT(*) > 0 THEN '' ELSE "
       "'Error, no schools match your selection criteria. Modify and try again.' END AS warning FROM sel")
def q_non_empty_guard(spark, d):
    return S.non_empty_guard(S.filter_institutions(R.schools(spark, d), R.P_EMPTY))


TRIP_TABLE_COLS = tuple(c for c in TRIP_COLUMNS)
PAGE2_ORDER = ("t_time DESC NULLS LAST, " +
               ", ".join(f"{c} ASC NULLS FIRST" for c in TRIP_TABLE_COLS if c != "t_time"))


@query("table_page", acc_sql(R.P_SUBSET, select=(
    "SELECT * EXCLUDE (enrolment) FROM st WHERE lower(run) LIKE '%morning%' OR lower(source_filename) "
    f"LIKE '%morning%' OR lower(source_run) LIKE '%morning%' ORDER BY {PAGE2_ORDER} OFFSET 10 LIMIT 10")))
def q_table_page(spark, d):
    table = SV.trips_table(T_(spark, d), R.P_SUBSET)
    return FL.table_page(table, search="Morning", order_by="t_time", descending=True, page=1, page_size=10)


def table_index(spark, d, search=False):
    """The trips table of the subset, sorted once per session, and indexed when it is searched."""
    def write(path):
        PG.write_rows(SV.trips_table(T_(spark, d), R.P_SUBSET), path, order_by="t_time", descending=True)
    path = R.stored_folder(spark, d, "table_index", write)
    if search:
        R.stored_part(spark, d, "table_index", "grams", lambda: PG.write_grams(spark, path))
    return PG.TableIndex(spark, path)


@query("table_page_search", acc_sql(R.P_SUBSET, select=(
    "SELECT * EXCLUDE (enrolment) FROM st WHERE lower(run) LIKE '%morning%' OR lower(source_filename) "
    f"LIKE '%morning%' OR lower(source_run) LIKE '%morning%' ORDER BY {PAGE2_ORDER} OFFSET 10 LIMIT 10")))
def q_table_page_search(spark, d):
    index = table_index(spark, d, search=True)
    key = index.page_after("Morning").agg(F.max("_place")).first()[0]      # the first page's last position
    return index.page_after("Morning", -1 if key is None else key).drop("_place")


@query("table_page_deep", acc_sql(R.P_SUBSET, select=(
    f"SELECT * EXCLUDE (enrolment) FROM st ORDER BY {PAGE2_ORDER} OFFSET 5000 LIMIT 25")))
def q_table_page_deep(spark, d):
    return table_index(spark, d).page_at(200, 25).drop("_place")


# ======================================================================== 2.5 joins
NEAR_MILES = 4.0


def _haversine_sql(lat_a: str, lon_a: str, lat_b: str, lon_b: str) -> str:
    return (f"(2 * {EARTH_MILES} * asin(sqrt(least(1.0, pow(sin((radians({lat_b}) - radians({lat_a})) / 2), 2) + "
            f"cos(radians({lat_a})) * cos(radians({lat_b})) * pow(sin((radians({lon_b}) - radians({lon_a})) / 2), 2)))))")


@query("crow_flies", with_ctes("ipeds") + (
    "SELECT UNITID AS school_id, round("
    + _haversine_sql("LATITUDE", "LONGITUD", "LAT_CTR", "LON_CTR") + ", 6) AS crow_flies, "
    + _haversine_sql("LATITUDE", "LONGITUD", "LAT_CTR", "LON_CTR") + " <= 30 AS in_study FROM ip"))
def q_crow_flies(spark, d):
    miles = NB.crow_flies(fx.ipeds(spark, d), "LATITUDE", "LONGITUD", "LAT_CTR", "LON_CTR")
    return miles.select(F.col("UNITID").alias("school_id"), F.round("crow_flies", 6).alias("crow_flies"),
                        (F.col("crow_flies") <= 30).alias("in_study"))


@query("schools_within_miles", with_ctes("schools", extra=(
    "ct AS (SELECT CAST(c_custkey AS VARCHAR) AS id, 40.4 + (c_custkey % 997) / 1000.0 AS lat, "
    "-73.4 - (c_custkey % 1009) / 1000.0 AS lng FROM customer),\n"
    "pr AS (SELECT ct.id AS centre_id, school_id AS point_id, "
    + _haversine_sql("ct.lat", "ct.lng", "latitude", "longitude") + " AS m FROM ct, sch)")) +
    f"SELECT centre_id, point_id, round(m, 6) AS miles FROM pr WHERE m <= {NEAR_MILES}")
def q_schools_within_miles(spark, d):
    k = F.col("c_custkey")
    centres = fx.table(spark, d, "customer").select(
        k.cast("string").alias("id"), (F.lit(40.4) + (k % 997) / F.lit(1000.0)).alias("lat"),
        (F.lit(-73.4) - (k % 1009) / F.lit(1000.0)).alias("lng"))
    near = NB.within_distance(centres, _schools_points(spark, d).drop("ord"), NEAR_MILES)
    return near.withColumn("miles", F.round("miles", 6))


def _origins_areas(spark, d):
    a = R.areas(spark, d, geometry=True)
    c = polygon_centroid(F.col("geometry"))
    return a.select(F.col("geoid").alias("id"), c["y"].alias("lat"), c["x"].alias("lng"),
                    F.col("geoid").cast("bigint").alias("ord"))


def _schools_points(spark, d):
    s = R.schools(spark, d)
    return s.select(F.col("school_id").alias("id"), F.col("latitude").alias("lat"),
                    F.col("longitude").alias("lng"), F.col("school_id").cast("bigint").alias("ord"))


OD_SQL = with_ctes("areas", "schools", extra=(
    "o AS (SELECT ROW_NUMBER() OVER (ORDER BY c_custkey) - 1 AS o_pos, geoid AS origin, "
    "CAST(1 AS DOUBLE) AS origin_lat, CAST(c_custkey AS DOUBLE) + 2 AS origin_lng FROM bg),\n"
    "d AS (SELECT ROW_NUMBER() OVER (ORDER BY CAST(school_id AS BIGINT)) - 1 AS d_pos, school_id AS destination, "
    "latitude AS destination_lat, longitude AS destination_lng FROM sch),\n"
    "n AS (SELECT COUNT(*) AS n FROM o)")) + (
    "SELECT 'morning' AS run, d.d_pos * n.n + o.o_pos + 1 AS request_id, origin, origin_lat, origin_lng, "
    "destination, destination_lat, destination_lng FROM d, o, n")


@query("od_cross_join", OD_SQL)
def q_od_cross_join(spark, d):
    return A.request_plan(_origins_areas(spark, d), _schools_points(spark, d), order_col="ord",
                          run="morning")


REQ_SQL = with_ctes("areas", "schools", extra=(
    "o0 AS (SELECT ROW_NUMBER() OVER (ORDER BY CAST(school_id AS BIGINT)) - 1 AS r, school_id AS origin, "
    "latitude AS origin_lat, longitude AS origin_lng FROM sch),\n"
    "o AS (SELECT r AS o_pos, * EXCLUDE (r) FROM o0),\n"
    "d0 AS (SELECT ROW_NUMBER() OVER (ORDER BY c_custkey) - 1 AS r, geoid AS destination, "
    "CAST(1 AS DOUBLE) AS destination_lat, CAST(c_custkey AS DOUBLE) + 2 AS destination_lng FROM bg),\n"
    "d AS (SELECT r AS d_pos, * EXCLUDE (r) FROM d0),\n"
    "n AS (SELECT COUNT(*) AS n FROM o)")) + (
    "SELECT 'evening' AS run, d.d_pos * n.n + o.o_pos + 1 AS request_id, origin, origin_lat, origin_lng, "
    "destination, destination_lat, destination_lng FROM d, o, n")


@query("request_plan", REQ_SQL)
def q_request_plan(spark, d):
    # the evening plan: schools are the origins; every school and every area
    return A.request_plan(_schools_points(spark, d), _origins_areas(spark, d), order_col="ord",
                          run="evening")


@query("semi_join_schools", acc_sql(R.P_SUBSET, select=(
    "SELECT * FROM tf WHERE school_id IN (SELECT school_id FROM sel)")))
def q_semi_join_schools(spark, d):
    return semi_in(R.trips_full(spark, d), "school_id",
                   S.filter_institutions(R.schools(spark, d), R.P_SUBSET), "school_id")


@query("schools_in_range", acc_sql(R.P_SUBSET, select=(
    "SELECT * FROM sel WHERE school_id IN (SELECT school_id FROM st)")))
def q_schools_in_range(spark, d):
    return SV.schools_table(T_(spark, d), R.P_SUBSET)


P_EVENING = AccessParams(run="evening")


@query("counts_right_join", acc_sql(P_EVENING, semi=False, with_params=False))
def q_counts_right_join(spark, d):
    counts = M.accessibility_counts(R.trips_full(spark, d), 60, "evening", 5)
    return M.counts_right_join(counts, R.areas(spark, d))


def cutoff_counts_sql(time, select="SELECT * FROM cc"):
    return with_ctes("trips_full", "areas", extra=(
        "grid AS (SELECT geoid, run FROM bg, (VALUES ('morning'), ('evening')) r(run)),\n"
        "cc AS (SELECT g.geoid, g.run, COALESCE(a.n, 0) AS n, COALESCE(a.slots, 0) AS slots FROM grid g "
        "LEFT JOIN (SELECT geoid, run, COUNT(*) AS n, CAST(COALESCE(SUM(enrolment), 0) AS BIGINT) AS slots "
        f"FROM tf WHERE t_time < {time} GROUP BY geoid, run) a ON g.geoid = a.geoid AND g.run = a.run)")) + select


def _grid(spark, d):
    return M.area_run_grid(R.areas(spark, d))


@query("grid_right_join", cutoff_counts_sql(30))
def q_grid_right_join(spark, d):
    return M.cutoff_counts(R.trips_full(spark, d), _grid(spark, d), 30)


@query("natural_left_join", with_ctes("legs") + (
    "SELECT r.*, c.* EXCLUDE (odid) FROM "
    f"(SELECT odid, {TRIP_COUNTS} FROM legs GROUP BY odid) c "
    f"JOIN (SELECT DISTINCT {', '.join(TRIP_REST)} FROM legs) r ON c.odid = r.odid"))
def q_natural_left_join(spark, d):
    return T.build_trips(R.legs(spark, d), keys=("odid",))


@query("census_join", census_sql(R.P_CENSUS))
def q_census_join(spark, d):
    t = T_(spark, d)
    return C.census_join(SV.blockgroups_table(t, R.P_CENSUS),
                         FL.filter_acs(t.acs, R.P_CENSUS.concept, R.P_CENSUS.variable))


@query("census_geo_join", with_ctes("areas", "acs", extra=acs_sel("BUILDING", "v1")) +
       "SELECT bg.geoid, bg.name, a.concept, a.label, a.estimate, a.percent FROM bg "
       "LEFT JOIN acs_sel a ON bg.geoid = a.geoid")
def q_census_geo_join(spark, d):
    return C.census_geo_join(R.areas(spark, d), FL.filter_acs(R.acs(spark, d), "BUILDING", "v1"))


def shares_sql(p: AccessParams, select: str, more=()) -> str:
    extra = (sel_ctes(p) + ",\n"
             "lcnt AS (SELECT l_line, COUNT(*) AS n FROM sl WHERE l_mode = 'TRANSIT' AND l_line IS NOT NULL "
             "GROUP BY l_line),\n"
             "ltot AS (SELECT SUM(n) AS total FROM lcnt),\n"
             f"shares AS (SELECT l_line, {D('n')} / {D('total')} AS \"Freq\", "
             f"{half_even('n', 'total', 2, 100)} AS \"Percent\", l_line AS \"Transit Route\" "
             "FROM lcnt, ltot),\n"
             "top AS (SELECT * FROM shares ORDER BY \"Percent\" DESC, l_line ASC LIMIT 20),\n"
             "acnt AS (SELECT l_agency, COUNT(*) AS \"Count\", l_agency AS \"Agency\" FROM sl "
             "WHERE l_mode = 'TRANSIT' AND l_agency IS NOT NULL GROUP BY l_agency),\n"
             "atot AS (SELECT SUM(\"Count\") AS total FROM acnt)")
    return with_ctes("trips_full", "legs", *more, extra=extra) + select


@query("line_color_join", shares_sql(R.P_DEFAULT, (
    "SELECT top.*, lc.l_color FROM top LEFT JOIN lc ON top.\"Transit Route\" = lc.l_line"), more=("leg_colors",)))
def q_line_color_join(spark, d):
    return SV.line_chart(T_(spark, d), R.P_DEFAULT)


@query("agency_color_join", shares_sql(R.P_DEFAULT, (
    "SELECT acnt.*, ac.l_color FROM acnt LEFT JOIN ac ON acnt.\"Agency\" = ac.l_agency"),
    more=("agency_colors",)))
def q_agency_color_join(spark, d):
    return SV.agency_chart(T_(spark, d), R.P_DEFAULT)


@query("enrolment_join", with_ctes("trips_full") + "SELECT * FROM tf")
def q_enrolment_join(spark, d):
    return T.enrolment_join(R.trips(spark, d), R.schools(spark, d))


# ======================================================================== SQL surface
def _sql_args(p: AccessParams) -> dict:
    return {"cutoff": float(p.cutoff), "run": p.run, "transfers": p.transfers, "sizes": list(p.sizes), "sectors": list(p.sectors),
            "levels": list(p.degree_levels), "types": list(p.degree_types)}


ACCESS_CALL = ("accessibility(cutoff => :cutoff, run => :run, transfers => :transfers, sizes => :sizes, "
               "sectors => :sectors, degree_levels => :levels, degree_types => :types)")


def _by_sql(spark, d, text: str, p: AccessParams) -> DataFrame:
    SQ.register(spark, T_(spark, d))
    return spark.sql(text, args=_sql_args(p))


@query("sql_accessibility", acc_sql(R.P_SUBSET, with_params=False, select=(
    "SELECT geoid, name, schools_accessible, slots_accessible FROM acc")))
def q_sql_accessibility(spark, d):
    return _by_sql(spark, d, f"SELECT * FROM {ACCESS_CALL}", R.P_SUBSET)


@query("sql_schools_in_range", acc_sql(R.P_MORNING, select=(
    "SELECT school_id, school_name, sector, size FROM sel WHERE school_id IN (SELECT school_id FROM st)")))
def q_sql_schools_in_range(spark, d):
    return _by_sql(spark, d, f"SELECT * FROM {ACCESS_CALL.replace('accessibility', 'schools_in_range')}", R.P_MORNING)


@query("sql_line_shares", acc_sql(R.P_SUBSET, select=(
    "SELECT l_line, COUNT(*) AS n_legs, CAST(COUNT(*) AS DOUBLE) / SUM(COUNT(*)) OVER () AS share FROM sl "
    "WHERE l_mode = 'TRANSIT' AND l_line IS NOT NULL GROUP BY l_line")))
def q_sql_line_shares(spark, d):
    return _by_sql(spark, d, f"SELECT * FROM {ACCESS_CALL.replace('accessibility', 'line_shares')}", R.P_SUBSET)


# ======================================================================== 2.6 aggregation
@query("accessibility_both", acc_sql(R.P_DEFAULT, semi=False, with_params=False))
def q_accessibility_both(spark, d):
    return M.filter_trips(R.trips_full(spark, d), R.areas(spark, d), 60, "both", 5)


P_RUN = AccessParams(run="morning", cutoff=45, transfers=2)


@query("accessibility_run", acc_sql(P_RUN, semi=False, with_params=False))
def q_accessibility_run(spark, d):
    return M.filter_trips(R.trips_full(spark, d), R.areas(spark, d), 45, "morning", 2)


P_FN_DEFAULT = AccessParams(cutoff=90)


@query("filter_trips", acc_sql(P_FN_DEFAULT, semi=False, with_params=False))
def q_filter_trips(spark, d):
    return M.filter_trips(R.trips_full(spark, d), R.areas(spark, d))


@query("accessibility_selected", acc_sql(R.P_SUBSET))
def q_accessibility_selected(spark, d):
    return SV.accessibility(T_(spark, d), R.P_SUBSET)


CUBE_BATCHES = 4


def access_cube(spark, d):
    """The cube of all trips, added in batches (once per session), the first one twice."""
    def write(path):
        cube, trips, schools = CB.AccessCube(spark, path), R.trips_full(spark, d), R.schools(spark, d)
        for b in [*range(CUBE_BATCHES), 0]:
            cube.add(str(b), trips.where(F.pmod(F.xxhash64("odid", "run"), F.lit(CUBE_BATCHES)) == b), schools)
    return CB.AccessCube(spark, R.stored_folder(spark, d, "cube", write))


@query("accessibility_cube", acc_sql(R.P_SUBSET))
def q_accessibility_cube(spark, d):
    return access_cube(spark, d).accessibility(R.areas(spark, d), R.schools(spark, d), R.P_SUBSET)


@query("accessibility_cube_compacted", acc_sql(R.P_MORNING))
def q_accessibility_cube_compacted(spark, d):
    cube = access_cube(spark, d).compacted(scratch_path(spark, "cube_base"))
    return cube.accessibility(R.areas(spark, d), R.schools(spark, d), R.P_MORNING)


@query("cutoff_counts", cutoff_counts_sql(45))
def q_cutoff_counts(spark, d):
    return M.cutoff_counts(R.trips_full(spark, d), _grid(spark, d), 45)


@query("cutoff_average", cutoff_counts_sql(45, (
    "SELECT geoid, 'average' AS run, AVG(n) AS n, CAST(CEIL(AVG(slots)) AS BIGINT) AS slots "
    "FROM cc GROUP BY geoid")))
def q_cutoff_average(spark, d):
    return M.cutoff_average(M.cutoff_counts(R.trips_full(spark, d), _grid(spark, d), 45)) \
        .select("geoid", "run", "n", F.col("slots").cast("bigint").alias("slots"))


@query("cutoff_union", cutoff_counts_sql(60, (
    "SELECT geoid, run, CAST(n AS DOUBLE) AS n, slots, 60 AS cutoff FROM cc UNION ALL "
    "SELECT geoid, 'average', AVG(n), CAST(CEIL(AVG(slots)) AS BIGINT), 60 FROM cc GROUP BY geoid")))
def q_cutoff_union(spark, d):
    return M.filter_time(R.trips_full(spark, d), _grid(spark, d), 60)


SWEEP_SQL = with_ctes("trips_full", "areas", extra=(
    "grid AS (SELECT geoid, run FROM bg, (VALUES ('morning'), ('evening')) r(run)),\n"
    "cuts AS (SELECT CAST(c AS DOUBLE) AS cutoff FROM range(15, 101, 5) t(c)),\n"
    "sw AS (SELECT g.geoid, g.run, k.cutoff, CAST(COUNT(tf.odid) AS DOUBLE) AS n, "
    "CAST(COALESCE(SUM(tf.enrolment), 0) AS BIGINT) AS slots FROM grid g CROSS JOIN cuts k "
    "LEFT JOIN tf ON tf.geoid = g.geoid AND tf.run = g.run AND tf.t_time < k.cutoff "
    "GROUP BY g.geoid, g.run, k.cutoff)")) + (
    "SELECT geoid, run, n, slots, cutoff FROM sw UNION ALL "
    "SELECT geoid, 'average', AVG(n), CAST(CEIL(AVG(slots)) AS BIGINT), cutoff FROM sw GROUP BY geoid, cutoff")


@query("cutoff_sweep", SWEEP_SQL)
def q_cutoff_sweep(spark, d):
    return M.cutoff_sweep(R.trips_full(spark, d), _grid(spark, d))


@query("batch_coverage", with_ctes("raw") + (
    "SELECT CAST(SUM(coverage) AS BIGINT) AS total_coverage, COUNT(*) AS n_files, "
    "COUNT(*) FILTER (WHERE coverage IS NULL) AS n_unparsed_files, 126 AS expected, "
    "COALESCE(SUM(coverage) = 126, FALSE) AS valid, 126 - CAST(SUM(coverage) AS BIGINT) AS missing "
    "FROM (SELECT source_filename, MAX(source_coverage) AS coverage FROM raw GROUP BY source_filename)"))
def q_batch_coverage(spark, d):
    return V.batch_coverage(R.raw(spark, d))


RANGE_MODULUS, RANGE_MOST = 1_000_007, 25      # planted batch ranges: one per order


def _planted_ranges(spark, d):
    """One fetched index range per order: runs by parity, ranges that overlap and leave gaps."""
    k = F.col("o_orderkey")
    start = (k * 7919) % RANGE_MODULUS
    return fx.table(spark, d, "orders").select(
        F.when(k % 2 == 0, F.lit("morning")).otherwise(F.lit("evening")).alias("source_run"),
        start.alias("source_start_index"), (start + F.col("o_custkey") % RANGE_MOST).alias("source_end_index"))


def _sweep_sql(ranges: str, first: int, last: int) -> str:
    return (f"ev AS (SELECT run, pos, SUM(change) AS change FROM (SELECT run, s AS pos, 1 AS change FROM {ranges} WHERE s < e "
            f"UNION ALL SELECT run, e, -1 FROM {ranges} WHERE s < e UNION ALL SELECT run, b, 0 FROM {ranges}, "
            f"(VALUES ({first}), ({last})) t(b)) GROUP BY run, pos HAVING SUM(change) <> 0 OR pos IN ({first}, {last})),\n"
            "sw AS (SELECT run AS source_run, pos AS start_index, LEAD(pos) OVER w AS end_index, "
            "CAST(SUM(change) OVER w AS BIGINT) AS times FROM ev WINDOW w AS (PARTITION BY run ORDER BY pos)),\n"
            f"seg AS (SELECT *, CASE WHEN start_index < {first} OR end_index > {last} THEN 'unexpected' "
            "WHEN times = 0 THEN 'missing' WHEN times = 1 THEN 'once' ELSE 'repeated' END AS kind "
            "FROM sw WHERE end_index IS NOT NULL),\n"
            "sg AS (SELECT * FROM seg WHERE kind <> 'unexpected' OR times > 0)\n")


@query("coverage_segments", (
    "WITH rg AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'morning' ELSE 'evening' END AS run, "
    f"(o_orderkey * 7919) % {RANGE_MODULUS} AS s, (o_orderkey * 7919) % {RANGE_MODULUS} + o_custkey % {RANGE_MOST} AS e "
    "FROM orders),\n" + _sweep_sql("rg", 0, RANGE_MODULUS) + "SELECT * FROM sg"))
def q_coverage_segments(spark, d):
    return CV.coverage_segments(_planted_ranges(spark, d), 0, RANGE_MODULUS)


@query("coverage_summary", with_ctes("raw", extra=(
    "rg AS (SELECT DISTINCT source_filename, source_run AS run, source_start_index AS s, source_end_index AS e FROM raw),\n" +
    _sweep_sql("rg", 0, V.EXPECTED_DESTINATIONS))) + (
    "SELECT source_run, CAST((SELECT COUNT(*) FROM rg WHERE rg.run = sg.source_run) AS BIGINT) AS n_files, "
    "CAST(COALESCE(SUM(end_index - start_index) FILTER (kind IN ('once', 'repeated')), 0) AS BIGINT) AS covered, "
    "CAST(COALESCE(SUM(end_index - start_index) FILTER (kind = 'missing'), 0) AS BIGINT) AS missing, "
    "CAST(COALESCE(SUM((end_index - start_index) * (times - 1)) FILTER (kind = 'repeated'), 0) AS BIGINT) AS refetched, "
    "CAST(COALESCE(SUM(end_index - start_index) FILTER (kind = 'unexpected'), 0) AS BIGINT) AS unexpected, "
    "COUNT(*) FILTER (kind = 'missing') AS n_gaps, COUNT(*) FILTER (kind = 'repeated') AS n_repeated, "
    "COALESCE(SUM(end_index - start_index) FILTER (kind = 'missing'), 0) = 0 AS valid FROM sg GROUP BY source_run"))
def q_coverage_summary(spark, d):
    ranges = CV.fetched_ranges(R.raw(spark, d))
    return CV.coverage_summary(CV.coverage_segments(ranges, 0, V.EXPECTED_DESTINATIONS), ranges)


@query("od_stats", with_ctes("raw") + (
    "SELECT COUNT(DISTINCT origin) AS n_origin, COUNT(DISTINCT destination) AS n_destination, "
    "(SELECT COUNT(*) FROM (SELECT DISTINCT origin, destination FROM raw)) AS n_pairs FROM raw"))
def q_od_stats(spark, d):
    return V.od_stats(R.raw(spark, d))


@query("error_pairs", with_ctes("raw", extra=(
    "pe AS (SELECT origin, destination, COUNT(*) FILTER (WHERE duration = '-999') AS errors "
    "FROM raw GROUP BY origin, destination),\n"
    "ps AS (SELECT COUNT(*) FILTER (WHERE errors > 0) AS n_errors, COUNT(*) AS n_pairs FROM pe)")) +
    f"SELECT n_errors, n_pairs, {half_even('n_errors', 'n_pairs', 2, 100)} AS pct_errors FROM ps")
def q_error_pairs(spark, d):
    return V.error_pairs(R.raw(spark, d))


LEDGER_BATCHES = 3


def pair_ledger(spark, d):
    """The pair states of all files, added in batches (once per session), the first one twice."""
    def write(path):
        ledger, raw = RF.PairLedger(spark, path), R.raw(spark, d)
        for b in [*range(LEDGER_BATCHES), 0]:
            with shuffle_files_dropped(spark):
                ledger.add(raw.where(F.pmod(F.xxhash64("source_filename"), F.lit(LEDGER_BATCHES)) == b))
    return RF.PairLedger(spark, R.stored_folder(spark, d, "pair_ledger", write))


@query("od_stats_merged", QUERIES["od_stats"][1])
def q_od_stats_merged(spark, d):
    return pair_ledger(spark, d).od_stats()


@query("error_pairs_merged", QUERIES["error_pairs"][1])
def q_error_pairs_merged(spark, d):
    return pair_ledger(spark, d).error_pairs()


def refetched(spark, d):
    """The raw rows and a second fetch of the failed pairs, which fails again for every fifth area."""
    raw = R.raw(spark, d)
    area = F.when(F.col("source_run") == "morning", F.col("origin")).otherwise(F.col("destination")).cast("bigint")
    again = raw.where(F.col("duration") == RF.FAILED).withColumns({
        "duration": F.when(area % 5 == 0, F.lit(RF.FAILED)).otherwise(F.lit("{'text': '1 min', 'value': 60}")),
        "request_time": F.lit("12/31/2099 00:00:00 EST"),
        "source_filename": F.concat(F.lit("retry_"), F.col("source_filename"))})
    return raw.unionByName(again)


@query("refetched_pairs", with_ctes("raw") + (
    "SELECT origin, destination, source_run, CASE WHEN duration = '-999' THEN 'retry_' ELSE '' END || source_filename "
    "AS source_filename, CASE WHEN duration = '-999' AND CAST(CASE WHEN source_run = 'morning' THEN origin ELSE destination END "
    "AS BIGINT) % 5 <> 0 THEN $${'text': '1 min', 'value': 60}$$ ELSE duration END AS duration, l_number FROM raw"))
def q_refetched_pairs(spark, d):
    return RF.best_fetch(refetched(spark, d)).select(*RF.PAIR, "source_filename", "duration", "l_number")


@query("flatten_trips", with_ctes("legs") + f"SELECT odid, run, {TRIP_COUNTS} FROM legs GROUP BY odid, run")
def q_flatten_trips(spark, d):
    return T.flatten_trips(R.legs(spark, d))


@query("distinct_trips", with_ctes("legs") + f"SELECT DISTINCT {', '.join(TRIP_REST)} FROM legs")
def q_distinct_trips(spark, d):
    return T.distinct_trips(R.legs(spark, d))


@query("distinct_dims", with_ctes("schools") +
       "SELECT DISTINCT size, sector, degree_level, degree_types, carnegie FROM sch")
def q_distinct_dims(spark, d):
    return R.schools(spark, d).select("size", "sector", "degree_level", "degree_types", "carnegie").distinct()


@query("trip_travel_minutes", with_ctes("legs") + "SELECT * FROM tm")
def q_trip_travel_minutes(spark, d):
    return L.trip_travel_minutes(R.parsed(spark, d))


@query("trip_transfers", with_ctes("legs") +
       "SELECT odid, run, COUNT(*) FILTER (WHERE l_mode = 'TRANSIT') - 1 AS t_transfer FROM legs GROUP BY odid, run")
def q_trip_transfers(spark, d):
    return L.trip_transfers(R.legs_to_read(spark, d))


@query("line_shares", shares_sql(R.P_DEFAULT, "SELECT * FROM top"))
def q_line_shares(spark, d):
    return SH.line_shares(SV.select(T_(spark, d), R.P_DEFAULT).legs)


@query("agency_counts", shares_sql(R.P_DEFAULT, "SELECT * FROM acnt"))
def q_agency_counts(spark, d):
    return SH.agency_counts(SV.select(T_(spark, d), R.P_DEFAULT).legs)


@query("agency_shares", shares_sql(R.P_DEFAULT, (
    "SELECT acnt.*, CAST(100 * \"Count\" AS DOUBLE) / CAST(total AS DOUBLE) AS percent FROM acnt, atot")))
def q_agency_shares(spark, d):
    return SH.agency_shares(SV.select(T_(spark, d), R.P_DEFAULT).legs)


@query("value_counts", with_ctes("schools") +
       "SELECT state, COUNT(*) AS count FROM sch WHERE state IS NOT NULL GROUP BY state")
def q_value_counts(spark, d):
    return SH.value_counts(R.schools(spark, d), "state")


HIST_SQL = with_ctes("ipeds", extra=(
    "v AS (SELECT crow_flies AS x FROM ip WHERE crow_flies IS NOT NULL),\n"
    "b AS (SELECT MIN(x) AS lo, MAX(x) AS hi FROM v),\n"
    "c AS (SELECT CASE WHEN hi = lo THEN CAST(0 AS BIGINT) ELSE "
    "LEAST(CAST(FLOOR((x - lo) / (hi - lo) * 10) AS BIGINT), CAST(9 AS BIGINT)) END AS bin, "
    "COUNT(*) AS count FROM v, b GROUP BY 1)")) + (
    "SELECT r.bin, lo + r.bin * ((hi - lo) / 10) AS bin_start, lo + (r.bin + 1) * ((hi - lo) / 10) AS bin_end, "
    "COALESCE(c.count, 0) AS count FROM range(10) r(bin) CROSS JOIN b LEFT JOIN c ON r.bin = c.bin")


@query("histogram", HIST_SQL)
def q_histogram(spark, d):
    return SH.histogram(fx.ipeds(spark, d), "crow_flies", bins=10)


@query("sort_desc", with_ctes("schools") + f"SELECT {cols(SCHOOL_COLS)} FROM sch ORDER BY enrolment DESC, school_id")
def q_sort_desc(spark, d):
    return SH.sort_desc(R.schools(spark, d), "enrolment", "school_id")


@query("top_k", with_ctes("trips") + "SELECT * FROM trips ORDER BY t_time DESC, odid, run LIMIT 20")
def q_top_k(spark, d):
    return R.trips(spark, d).orderBy(F.col("t_time").desc(), "odid", "run").limit(20)


@query("union_by_name", with_ctes("trips") + (
    "SELECT * EXCLUDE (t_tram), CAST(NULL AS BIGINT) AS t_tram FROM trips WHERE run = 'morning' "
    "UNION ALL SELECT * FROM trips WHERE run = 'evening'"))
def q_union_by_name(spark, d):
    t = R.trips(spark, d)
    return B.union_by_name(t.where(F.col("run") == "morning").drop("t_tram"),
                           t.where(F.col("run") == "evening"))


# ======================================================================== 2.7 scalar functions
def parsed_sql(*columns: str) -> str:
    return with_ctes("parsed") + f"SELECT {cols(KEY + columns)} FROM pl"


def parsed_q(*columns: str):
    def fn(spark, d):
        return R.parsed(spark, d).select(*KEY, *columns)
    return fn


SCALAR_PARSED = {
    "make_odid": ("origin", "destination", "source_run"),
    "parse_duration": ("l_travelmins",),
    "parse_distance": ("l_distance",),
    "leg_number": ("source_filename",),
    "parse_coords": ("l_lat_dep", "l_lon_dep", "l_lat_arr", "l_lon_arr"),
    "parse_dep_stop": ("l_dep_stop",),
    "parse_arr_stop": ("l_arr_stop",),
    "parse_leg_times": ("l_dep_time", "l_arr_time"),
    "copy_instructions": ("l_instructions",),
    "parse_agency": ("l_agency",),
    "parse_line": ("l_line",),
    "parse_color": ("l_color",),
    "parse_text_color": ("l_text_color",),
    "parse_vehicle": ("l_vehicle",),
    "parse_num_stops": ("l_num_stops",),
    "set_date": ("source_t_set", "source_t_set_date"),
    "parse_trip_times": ("t_departure", "t_arrival"),
    "reference_time": ("t_set",),
    "trip_duration": ("t_time",),
}
for _name, _cols in SCALAR_PARSED.items():
    QUERIES[_name] = (parsed_q(*_cols), parsed_sql(*_cols))


@query("make_run", with_ctes("parsed") + "SELECT odid, l_number, source_run, run FROM pl")
def q_make_run(spark, d):
    return R.parsed(spark, d).select("odid", "l_number", "source_run", "run")


@query("sentinel_to_null", with_ctes("raw") + (
    "SELECT source_filename, origin, destination, l_number, " +
    ", ".join(_sentinel_sql(c) for c in ("duration", "total_time", "travel_mode")) + " FROM raw"))
def q_sentinel_to_null(spark, d):
    raw = R.raw(spark, d)
    return raw.select("source_filename", "origin", "destination", "l_number",
                      *[P.sentinel_to_null(c).alias(c) for c in ("duration", "total_time", "travel_mode")])


@query("orient_trip", with_ctes("trips") + "SELECT odid, run, origin, destination, school_id, geoid FROM trips")
def q_orient_trip(spark, d):
    t = R.trips(spark, d).select("odid", "run", "origin", "destination")
    return T.orient_trip(t)


@query("recode_agency", with_ctes("facts") + (
    f"SELECT DISTINCT {RAW_AGENCY} AS raw_agency, {AGENCY} AS l_agency FROM lf2 "
    "WHERE NOT failed AND NOT walking"))
def q_recode_agency(spark, d):
    raw = R.raw(spark, d).where(F.col("transit_details").isNotNull() & (F.col("transit_details") != "-999"))
    name = extract_or_null("transit_details", P.AGENCY_NAME, 2)
    return raw.select(name.alias("raw_agency"), P.recode_agency(name).alias("l_agency")).distinct()


@query("schedule_gap", with_ctes("legs") + (
    "SELECT l.odid, l.run, l.l_number, p.t_set_actual, p.t_set_actual - l.t_travelmins AS t_waitmins "
    "FROM legs l JOIN pl p ON l.odid = p.odid AND l.run = p.run AND l.l_number = p.l_number"))
def q_schedule_gap(spark, d):
    return L.clean_legs(R.raw(spark, d), keep_helpers=True).select(
        "odid", "run", "l_number", "t_set_actual", "t_waitmins")


@query("waiting_minutes", with_ctes("legs") + "SELECT odid, run, l_number, t_waiting FROM legs")
def q_waiting_minutes(spark, d):
    return L.clean_legs(R.raw(spark, d)).select("odid", "run", "l_number", "t_waiting")


@query("paste_address", with_ctes("schools") + "SELECT school_id, address FROM sch")
def q_paste_address(spark, d):
    ip = fx.ipeds(spark, d)
    return ip.select(F.col("UNITID").alias("school_id"), S.paste_address().alias("address"))


@query("demographic_percents", with_ctes("schools") +
       "SELECT school_id, " + cols(n for n, _ in PERCENTS) + " FROM sch")
def q_demographic_percents(spark, d):
    return R.schools(spark, d).select("school_id", *[CO.q(n) for n, _ in PERCENTS])


@query("fill_zero", cutoff_counts_sql(20))
def q_fill_zero(spark, d):
    return M.cutoff_counts(R.trips_full(spark, d), _grid(spark, d), 20)


RESP_EXPECTED = with_ctes("facts", extra=(
    "ord AS (SELECT DISTINCT k, origin, destination, (k % 97 = 0 OR k % 89 = 0) AS bad FROM lf2),\n"
    "ok AS (SELECT lf2.* FROM lf2 JOIN ord USING (k) WHERE NOT ord.bad),\n"
    "flat AS (\n"
    "  SELECT origin, destination, CAST(leg_index AS INTEGER) AS l_number,\n"
    "    CAST(FLOOR(price) AS BIGINT) AS distance_m, '1 km' AS distance_text,\n"
    "    CAST(qty * 37 AS BIGINT) AS duration_s, '1 min' AS duration_text,\n"
    "    CAST('40.' || lpad(CAST(pk % 10000 AS VARCHAR), 4, '0') AS DOUBLE) AS start_lat,\n"
    "    CAST('-73.' || lpad(CAST(sk % 10000 AS VARCHAR), 4, '0') AS DOUBLE) AS start_lng,\n"
    "    CASE WHEN ln = 6 THEN CAST(40 AS DOUBLE) WHEN ln = 7 THEN CAST(-33.8688 AS DOUBLE)\n"
    "         ELSE CAST('40.' || lpad(CAST(sk % 10000 AS VARCHAR), 4, '0') AS DOUBLE) END AS end_lat,\n"
    "    CAST('-74.' || lpad(CAST(pk % 10000 AS VARCHAR), 4, '0') AS DOUBLE) AS end_lng,\n"
    "    CASE WHEN walking THEN 'Walk to S' || CAST(sk AS VARCHAR) ELSE\n"
    "      CASE ln WHEN 1 THEN 'Bus' WHEN 2 THEN 'Ferry' WHEN 3 THEN 'Train' WHEN 4 THEN 'Tram' ELSE 'Subway' END\n"
    "      || ' towards A' || CAST(sk AS VARCHAR) END AS html_instructions,\n"
    "    CASE WHEN walking THEN 'WALKING' ELSE 'TRANSIT' END AS travel_mode,\n"
    f"    CASE WHEN walking THEN NULL ELSE {TRANSIT_TEXT} END AS transit_details,\n"
    "    CASE WHEN walking THEN $$[{'travel_mode': 'WALKING'}]$$ ELSE NULL END AS steps,\n"
    f"    {clock('dep_minute')} AS actual_departure, {clock('arr_minute')} AS actual_arrival,\n"
    f"    {D('trip_minutes')} AS total_time, FALSE AS failed\n"
    "  FROM ok\n"
    "  UNION ALL\n"
    "  SELECT origin, destination, 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,\n"
    "         NULL, NULL, NULL, TRUE FROM ord WHERE bad\n"
    ")"))


def _flat(spark, d):
    return A.flatten_responses(R.responses(spark, d))


@query("flatten_responses", RESP_EXPECTED + "SELECT * FROM flat")
def q_flatten_responses(spark, d):
    return _flat(spark, d)


@query("total_time", RESP_EXPECTED + "SELECT DISTINCT origin, destination, total_time FROM flat")
def q_total_time(spark, d):
    return _flat(spark, d).select("origin", "destination", "total_time").distinct()


def _dict_sql(fields) -> str:
    parts = []
    for key, value, quoted in fields:
        v = f"'''' || {value} || ''''" if quoted else f"CAST({value} AS VARCHAR)"
        parts.append(f"'''{key}'': ' || {v}")
    return "'{' || " + " || ', ' || ".join(parts) + " || '}'"


SENTINEL_SELECT = (
    "SELECT CAST(l_number AS VARCHAR) AS l_number, "
    f"CASE WHEN failed THEN '-999' ELSE {_dict_sql([('text', 'distance_text', True), ('value', 'distance_m', False)])} END AS distance, "
    f"CASE WHEN failed THEN '-999' ELSE {_dict_sql([('text', 'duration_text', True), ('value', 'duration_s', False)])} END AS duration, "
    f"CASE WHEN failed THEN '-999' ELSE {_dict_sql([('lat', 'end_lat', False), ('lng', 'end_lng', False)])} END AS end_location, "
    "CASE WHEN failed THEN '-999' ELSE html_instructions END AS html_instructions, "
    f"CASE WHEN failed THEN '-999' ELSE {_dict_sql([('lat', 'start_lat', False), ('lng', 'start_lng', False)])} END AS start_location, "
    "CASE WHEN failed THEN '-999' ELSE steps END AS steps, "
    "CASE WHEN failed THEN '-999' ELSE travel_mode END AS travel_mode, "
    "CASE WHEN failed THEN '-999' ELSE transit_details END AS transit_details, origin, destination, "
    "CASE WHEN failed THEN '-999' ELSE actual_departure END AS actual_departure, "
    "CASE WHEN failed THEN '-999' ELSE actual_arrival END AS actual_arrival, "
    "CASE WHEN failed THEN '-999.0' ELSE CAST(total_time AS VARCHAR) END AS total_time FROM flat")


@query("error_sentinel_rows", RESP_EXPECTED + SENTINEL_SELECT)
def q_error_sentinel_rows(spark, d):
    return A.error_sentinel_rows(_flat(spark, d))


@query("request_defaults", RESP_EXPECTED + (
    "SELECT origin, destination, l_number, 'NA' AS depart_time, '01/05/2023 09:00:00 EST' AS arrival_time, "
    "'standard' AS transit_routing_preference FROM flat"))
def q_request_defaults(spark, d):
    rows = A.request_defaults(_flat(spark, d), arrival_time="01/05/2023 09:00:00 EST")
    return rows.select("origin", "destination", "l_number", "depart_time", "arrival_time",
                       "transit_routing_preference")


@query("format_request_time", (
    "SELECT o_orderkey, strftime(timezone('America/New_York', o_orderdate AT TIME ZONE 'UTC'), "
    "'%m/%d/%Y %H:%M:%S') || ' ' || CASE date_diff('minute', o_orderdate, "
    "timezone('America/New_York', o_orderdate AT TIME ZONE 'UTC')) WHEN -300 THEN 'EST' "
    "WHEN -240 THEN 'EDT' END AS request_time FROM orders"))
def q_format_request_time(spark, d):
    o = fx.table(spark, d, "orders")
    return o.select("o_orderkey", A.format_request_time(F.col("o_orderdate")).alias("request_time"))


@query("parse_desired_time", (
    "SELECT o_orderkey, strftime(o_orderdate, '%b %d %Y') || ' 2:00PM' AS desired, "
    "timezone('America/New_York', (o_orderdate + INTERVAL 14 HOUR) AT TIME ZONE 'UTC') AS desired_time "
    "FROM orders"))
def q_parse_desired_time(spark, d):
    o = fx.table(spark, d, "orders").select(
        "o_orderkey", F.concat(F.date_format("o_orderdate", "MMM dd yyyy"), F.lit(" 2:00PM")).alias("desired"))
    return o.withColumn("desired_time", A.parse_desired_time("desired"))


@query("polygon_centroid", with_ctes("areas") +
       "SELECT geoid, CAST(c_custkey AS DOUBLE) + 2 AS centroid_x, CAST(1 AS DOUBLE) AS centroid_y FROM bg")
def q_polygon_centroid(spark, d):
    a = R.areas(spark, d, geometry=True)
    c = polygon_centroid(F.col("geometry"))
    return a.select("geoid", c["x"].alias("centroid_x"), c["y"].alias("centroid_y"))


@query("point_from_lonlat", with_ctes("schools") + "SELECT school_id, longitude AS x, latitude AS y FROM sch")
def q_point_from_lonlat(spark, d):
    from ..functions.geo import point_from_lonlat
    s = R.schools(spark, d).withColumn("point", point_from_lonlat("longitude", "latitude"))
    return s.select("school_id", F.col("point")["x"].alias("x"), F.col("point")["y"].alias("y"))


# ======================================================================== 2.8 composites
@query("clean_legs", with_ctes("legs") + f"SELECT {cols(LEG_COLUMNS)} FROM legs")
def q_clean_legs(spark, d):
    return L.clean_legs(R.raw(spark, d))


@query("build_trips", with_ctes("trips") + "SELECT * FROM trips")
def q_build_trips(spark, d):
    return T.build_trips(R.legs_to_read(spark, d))


@query("process_schools", with_ctes("schools") + f"SELECT {cols(SCHOOL_COLS)} FROM sch")
def q_process_schools(spark, d):
    return R.schools(spark, d)


@query("accessibility_map_feed", acc_sql(R.P_CENSUS, select=(
    "SELECT acc.geoid, acc.name, acc.slots_accessible AS value, CAST(bg.c_custkey AS DOUBLE) + 2 AS centroid_x, "
    "CAST(1 AS DOUBLE) AS centroid_y FROM acc JOIN bg ON acc.geoid = bg.geoid")))
def q_accessibility_map_feed(spark, d):
    return SV.accessibility_map(R.tables(spark, d, geometry=True), R.P_CENSUS, keep_geometry=False)


@query("census_map_feed", with_ctes("areas", "acs", extra=acs_sel("BUILDING", "v1")) + (
    "SELECT bg.geoid, bg.name, a.percent AS value, CAST(bg.c_custkey AS DOUBLE) + 2 AS centroid_x, "
    "CAST(1 AS DOUBLE) AS centroid_y FROM bg LEFT JOIN acs_sel a ON bg.geoid = a.geoid"))
def q_census_map_feed(spark, d):
    return SV.census_map(R.tables(spark, d, geometry=True), R.P_CENSUS, keep_geometry=False)


@query("scatter_feed", census_sql(R.P_CENSUS, select=(
    "SELECT acc.geoid, a.percent AS x, acc.slots_accessible AS y FROM acc "
    "LEFT JOIN acs_sel a ON acc.geoid = a.geoid")))
def q_scatter_feed(spark, d):
    return SV.scatter(T_(spark, d), R.P_CENSUS)


@query("line_chart_feed", shares_sql(R.P_SUBSET, (
    "SELECT top.*, lc.l_color FROM top LEFT JOIN lc ON top.\"Transit Route\" = lc.l_line"), more=("leg_colors",)))
def q_line_chart_feed(spark, d):
    return SV.line_chart(T_(spark, d), R.P_SUBSET)


@query("agency_chart_feed", shares_sql(R.P_SUBSET, (
    "SELECT acnt.*, ac.l_color FROM acnt LEFT JOIN ac ON acnt.\"Agency\" = ac.l_agency"),
    more=("agency_colors",)))
def q_agency_chart_feed(spark, d):
    return SV.agency_chart(T_(spark, d), R.P_SUBSET)


@query("schools_table", acc_sql(R.P_MORNING, select=(
    "SELECT * FROM sel WHERE school_id IN (SELECT school_id FROM st)")))
def q_schools_table(spark, d):
    return SV.schools_table(T_(spark, d), R.P_MORNING)


@query("trips_table", acc_sql(R.P_MORNING, select="SELECT * EXCLUDE (enrolment) FROM st"))
def q_trips_table(spark, d):
    return SV.trips_table(T_(spark, d), R.P_MORNING)


@query("legs_table", acc_sql(R.P_MORNING, select=(
    "SELECT * EXCLUDE (t_departure, t_arrival, t_time, t_waiting, t_transfer) FROM sl")))
def q_legs_table(spark, d):
    return SV.legs_table(T_(spark, d), R.P_MORNING)


@query("blockgroups_table", acc_sql(R.P_MORNING))
def q_blockgroups_table(spark, d):
    return SV.blockgroups_table(T_(spark, d), R.P_MORNING)


@query("census_table", census_sql(AccessParams(concept="AUTOMOBILE", variable="v2")))
def q_census_table(spark, d):
    return SV.census_table(T_(spark, d), AccessParams(concept="AUTOMOBILE", variable="v2"))


@query("non_empty_selection", with_ctes("schools", extra=R.sql_selected_schools(R.P_SUBSET)) +
       "SELECT COUNT(*) AS n_schools, CASE WHEN COUNT(*) > 0 THEN '' ELSE "
       "'Error, no schools match your selection criteria. Modify and try again.' END AS warning FROM sel")
def q_non_empty_selection(spark, d):
    return S.non_empty_guard(S.filter_institutions(R.schools(spark, d), R.P_SUBSET))


def spark_queries() -> dict:
    return {k: v[0] for k, v in QUERIES.items()}


def oracle_sqls() -> dict:
    return {k: v[1] for k, v in QUERIES.items() if v[1] is not None}


__all__ = ["QUERIES", "spark_queries", "oracle_sqls"]
