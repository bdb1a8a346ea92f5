"""Indexed paging, distances and the SQL functions against the plain operators and brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from transitreach.functions.geo import EARTH_MILES, great_circle_miles
from transitreach.operators import filters as FL
from transitreach.operators import nearby as NB
from transitreach.params import AccessParams
from transitreach.plans import pages as PG
from transitreach.plans import serve as SV
from transitreach.plans import sql_functions as SQ

TABLE = "id bigint, name string, t double, run string"


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(6)
    rows = [(rng.choice([None, rng.randrange(300)]), rng.choice([None, "Canal St", "canal street", "Avenue J", "AV", "日本 Canal", "a%b_c"]),
             rng.choice([None, 1.5, 2.5, float(rng.randrange(9))]), rng.choice(["morning", "evening"])) for _ in range(400)]
    return spark.createDataFrame(rows, TABLE).repartition(3)


@pytest.fixture(scope="module")
def index(spark, table, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "t")
    PG.write_table_index(table, path, order_by="t", descending=True)
    return PG.TableIndex(spark, path)


def rows_of(df):
    return [tuple(r) for r in df.drop("_place").collect()]


def test_pages_equal_offset_paging(table, index):
    for page, size in ((0, 10), (7, 10), (39, 10), (40, 10), (1, 150)):
        assert rows_of(index.page_at(page, size)) == rows_of(FL.table_page(table, None, "t", True, page, size))


@pytest.mark.parametrize("search", ["Canal", "canal st", "MORNING", "av", "2.5", "日本", "%b_", "no such text", "1"])
@pytest.mark.parametrize("window", [7, PG.WINDOW])
def test_search_pages_equal_offset_paging(table, index, search, window):
    after = -1
    for page in range(3):
        got = index.page_after(search, after, 6, window).collect()
        want = rows_of(FL.table_page(table, search, "t", True, page, 6))
        assert [tuple(r)[1:] if r.__fields__[0] == "_place" else tuple(r)[:-1] for r in got] == want
        if not got:
            break
        after = max(r["_place"] for r in got)


def test_a_search_reads_only_its_grams(spark, index):
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    try:
        plan = index.matches("Canal", 10, 90)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "PartitionFilters: [isnotnull(folder" in plan or "PartitionFilters: [folder" in plan
    assert "In(gram, [ana,can,nal])" in plan and "GreaterThan(_place,10)" in plan and "LessThanOrEqual(_place,90)" in plan


def test_an_empty_table_has_no_pages(spark, table, tmp_path):
    PG.write_table_index(table.where("FALSE"), str(tmp_path / "t"))
    empty = PG.TableIndex(spark, str(tmp_path / "t"))
    assert empty.page_at(0).count() == 0 and empty.page_after("canal").count() == 0


# ---------------------------------------------------------------- distances
def haversine(a, b):
    (y1, x1), (y2, x2) = ([math.radians(v) for v in p] for p in (a, b))
    h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
    return 2 * EARTH_MILES * math.asin(min(1, math.sqrt(h)))


def places(seed, n):
    rng = random.Random(seed)
    out = [(i, rng.gauss(40.7, 0.4), rng.gauss(-74, 0.4)) for i in range(n)]
    out += [(n + i, rng.uniform(-90, 90), rng.choice([-179.9, 179.9, -180.0, 180.0, rng.uniform(-180, 180)])) for i in range(60)]
    out += [(2 * n, 90.0, 10.0), (2 * n, 89.9, -170.0), (2 * n + 1, -90.0, 0.0), (2 * n + 2, None, 1.0), (2 * n + 3, 1.0, None)]
    return out


@pytest.mark.parametrize("miles, salt", [(3.0, 1), (30.0, 4), (900.0, 1)])
def test_within_distance(spark, miles, salt):
    a, b = places(1, 60), places(2, 80)
    frames = [spark.createDataFrame(x, "id bigint, lat double, lng double") for x in (a, b)]
    got = NB.within_distance(*frames, miles, salt)
    want = sorted((i, j, round(haversine((y, x), (v, u)), 6)) for i, y, x in a for j, v, u in b
                  if None not in (y, x, v, u) and haversine((y, x), (v, u)) <= miles)
    assert sorted((r[0], r[1], round(r[2], 6)) for r in got.collect()) == want and want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_known_distance(spark):
    row = spark.range(1).select(great_circle_miles(F.lit(40.7128), F.lit(-74.006), F.lit(34.0522), F.lit(-118.2437)).alias("d"),
                                great_circle_miles(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("n")).first()
    assert abs(row["d"] - 2445.6) < 1 and row["n"] is None


# ---------------------------------------------------------------- SQL functions
@pytest.fixture(scope="module")
def role_tables(spark):
    rng = random.Random(3)
    schools = spark.createDataFrame(
        [(f"s{i}", f"School {i}", *rng.choice([("Under 1,000", "Public"), ("1,000 - 4,999", "Private nonprofit"), (None, "Public")]),
          rng.choice(["2-year", "4-year or higher"]), "Doctoral", f"C{i % 3}") for i in range(12)],
        "school_id string, school_name string, size string, sector string, degree_level string, degree_types string, carnegie string")
    trips = spark.createDataFrame(
        [(f"g{rng.randrange(7)}", f"s{rng.randrange(14)}", rng.choice(["morning", "evening"]), float(rng.randrange(10, 99)),
          rng.randrange(0, 5), rng.choice([None, rng.randrange(900)])) for _ in range(300)],
        "geoid string, school_id string, run string, t_time double, t_transit bigint, enrolment bigint")
    legs = spark.createDataFrame(
        [(rng.choice(["A", "B", None]), rng.choice(["TRANSIT", "WALKING"]), f"s{rng.randrange(14)}", rng.choice(["morning", "evening"]),
          float(rng.randrange(10, 99)), rng.randrange(0, 4)) for _ in range(300)],
        "l_line string, l_mode string, school_id string, run string, t_time double, t_transfer bigint")
    areas = spark.createDataFrame([(f"g{i}", f"Area {i}") for i in range(9)], "geoid string, name string")
    return SV.Tables(schools=schools, areas=areas, acs=areas, trips=trips, legs=legs)


def test_sql_functions(spark, role_tables):
    assert set(SQ.register(spark, role_tables)) == {"accessibility", "schools_in_range", "line_shares"}
    for p in (AccessParams(sizes=("Under 1,000",), cutoff=55, transfers=2), AccessParams(run="morning", sectors=("Public",), cutoff=70.5,
              sizes=("Under 1,000", "1,000 - 4,999"), carnegie=("C0", "C2"))):
        args = dict(c=float(p.cutoff), r=p.run, t=p.transfers, s=list(p.sizes), k=None if p.carnegie is None else list(p.carnegie),
                    x=list(p.sectors))
        call = "(cutoff => :c, run => :r, transfers => :t, sizes => :s, sectors => :x, carnegie => CAST(:k AS ARRAY<STRING>))"
        got = spark.sql(f"SELECT * FROM accessibility{call}", args=args).collect()
        want = SV.accessibility(role_tables, p).select("geoid", "name", "schools_accessible", "slots_accessible").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))
        near = spark.sql(f"SELECT school_id FROM schools_in_range{call}", args=args).collect()
        assert sorted(r[0] for r in near) == sorted(r["school_id"] for r in SV.schools_table(role_tables, p).collect())
    every = spark.sql("SELECT SUM(share) FROM line_shares() WHERE n_legs > 0").first()[0]
    assert every == pytest.approx(1.0)


def test_callers_filters_and_parameters_reach_the_scan(spark, role_tables, tmp_path):
    stored = SV.Tables(**{n: (getattr(role_tables, n).write.parquet(str(tmp_path / n)), spark.read.parquet(str(tmp_path / n)))[1]
                          for n in ("schools", "areas", "acs", "trips", "legs")})
    SQ.register(spark, stored)
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    try:
        plan = spark.sql("SELECT geoid FROM accessibility(cutoff => 40, run => 'morning') WHERE geoid = 'g1'")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "LessThanOrEqual(t_time,40.0)" in plan and "EqualTo(run,morning)" in plan and "EqualTo(geoid,g1)" in plan
