"""What the ETL's outputs read and write: legs once, only parsed columns that are needed, no copy of trips."""

import types

import pytest
from pyspark.sql import functions as F

from rows import raw_frame, raw_row
from transitreach.catalog import roles as R
from transitreach.catalog.registry import QUERIES
from transitreach.functions.columns import join_null_safe
from transitreach.operators.legs import clean_legs
from transitreach.operators.trips import build_trips, distinct_trips, flatten_trips, trips_of_rows
from transitreach.params import AccessParams
from transitreach.plans import pages as PG
from transitreach.plans import serve as SV


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    rows = []
    for run in ("morning", "evening"):
        for i in range(3):
            rows.append(raw_row(source_run=run, l_number=str(i), travel_mode="WALKING" if i == 0 else "TRANSIT",
                                depart_time="01/12/2023 17:00:00 EST"))
    rows.append(raw_row(l_number="7", actual_arrival="8:59 AM"))         # another trip row of the same pair
    rows += [raw_row(origin=None, destination=None)] * 2
    rows.append(raw_row(source_run=None))
    path = str(tmp_path_factory.mktemp("raw"))
    raw_frame(spark, rows).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def rows_of(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("keys", [("odid", "run"), ("odid",)])
def test_trips_read_legs_once(raw, tmp_path, keys):
    path = str(tmp_path / "legs")
    clean_legs(raw).write.parquet(path)
    legs = raw.sparkSession.read.parquet(path)
    trips = build_trips(legs, keys)
    assert trips._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    want = join_null_safe(flatten_trips(legs, keys), distinct_trips(legs), list(keys), "left")
    assert rows_of(trips) == rows_of(want) and trips.count() == 4


def test_trips_do_not_write_legs_nor_parse_their_texts(spark, raw, monkeypatch):
    built = []

    def stored(_spark, _d, name, build, **_):
        built.append((name, build()))
        return built[-1][1]

    monkeypatch.setattr(R, "raw", lambda *_: raw)
    monkeypatch.setattr(R, "_stored", stored)
    monkeypatch.setattr(R, "schools", lambda *_: spark.createDataFrame([("190001", 5)], "school_id string, enrolment long"))
    full = R.trips_full(spark, "nowhere")
    assert [name for name, _ in built] == ["trips"]           # neither legs nor a second copy of trips
    assert {r["enrolment"] for r in full.where("run = 'morning' AND origin IS NOT NULL").collect()} == {5}
    plan = full._jdf.queryExecution().optimizedPlan().toString()
    assert "agencies(" not in plan and "arrival_stop" not in plan


def test_legs_are_written_when_read_again(spark, raw, monkeypatch):
    monkeypatch.setattr(R, "raw", lambda *_: raw)
    monkeypatch.setattr(R, "legs", lambda *_: "written")
    monkeypatch.setattr(R, "_READ", set())
    first = R.legs_to_read(spark, "nowhere")
    assert rows_of(first) == rows_of(clean_legs(raw))
    assert R.legs_to_read(spark, "nowhere") == "written"


def test_an_output_of_legs_does_not_ask_for_trips(spark, raw):
    class Tables(types.SimpleNamespace):
        @property
        def trips(self):
            raise AssertionError("trips were built")

    schools = spark.createDataFrame(
        [("190001", "Under 1,000", "Public", "2-year", "Doctoral", "C1")],
        "school_id string, size string, sector string, degree_level string, degree_types string, carnegie string")
    colors = spark.createDataFrame([("MTA - NYC Subway", "#1")], "l_agency string, l_color string")
    p = AccessParams(transfers=5, cutoff=90)
    t = Tables(schools=schools, legs=clean_legs(raw), agency_colors=colors)
    assert SV.select(t, p).legs.count() and SV.agency_chart(t, p).count() == 1
    with pytest.raises(AssertionError):
        SV.select(t, p).trips


def test_grams_are_noted_by_block_and_only_for_searches(spark, tmp_path):
    path = str(tmp_path / "t")
    n = 3 * PG.BLOCK
    table = spark.range(n).select("id", F.concat(F.lit("Line "), F.col("id") % 5).alias("line"))
    PG.write_rows(table, path, "id")
    index = PG.TableIndex(spark, path)
    assert [r["id"] for r in index.page_at(2, 3).collect()] == [6, 7, 8]
    assert not (tmp_path / "t" / "grams").exists()
    PG.write_grams(spark, path)
    assert spark.read.parquet(f"{path}/grams").where("gram = 'lin'").count() == 3
    last = index.page_after("ine 4", 2 * PG.BLOCK, 2).collect()
    assert [r["id"] for r in last] == [i for i in range(2 * PG.BLOCK + 1, n) if i % 5 == 4][:2]


def test_trips_of_rows_parse_rows_once(raw, tmp_path):
    """Without written legs: the trips of the legs, from one read of the rows and without a join."""
    odd = raw.unionByName(raw_frame(raw.sparkSession, [
        raw_row(l_number="8", actual_arrival="11:59 PM"),                # too long: its minutes count, its legs do not
        raw_row(destination="190009", travel_mode="-999"), raw_row(destination="190009"),
        raw_row(destination="190010", actual_departure="-999"), raw_row(destination="190011", duration="-999")]))
    for name, rows in (("rows", raw), ("odd", odd)):
        path = str(tmp_path / name)
        rows.write.parquet(path)
        stored = raw.sparkSession.read.parquet(path)
        got, want = trips_of_rows(stored), build_trips(clean_legs(stored))
        assert got.dtypes == want.dtypes and rows_of(got) == rows_of(want) and got.count()
        plan = got._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("FileScan") == 1 and "Join" not in plan


def test_stored_trips_make_no_legs(raw, monkeypatch):
    scans = []
    monkeypatch.setattr(R, "raw", lambda spark, d: raw)
    monkeypatch.setattr(R, "_stored", lambda spark, d, name, build, **layout: scans.append(build()) or scans[-1])
    R.trips(raw.sparkSession, "/no/such/folder")
    assert scans[0]._jdf.queryExecution().sparkPlan().toString().count("FileScan") == 1


def written(spark, folder, name, monkeypatch):
    """The tables that a query writes in a new session, and its plan with sort-merge joins."""
    names, store = [], R._stored
    monkeypatch.setattr(R, "_STORED", {})
    monkeypatch.setattr(R, "_READ", set())
    monkeypatch.setattr(R, "_stored", lambda s, d, table, *rest, **layout: names.append(table) or store(s, d, table, *rest, **layout))
    df = QUERIES[name][0](spark, folder)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return set(names), df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_trip_transfers_write_neither_texts_nor_legs_and_join_nothing(spark, sf_small, monkeypatch):
    names, plan = written(spark, sf_small, "trip_transfers", monkeypatch)
    assert names == {"joined_legs"}
    assert "Join" not in plan and plan.count("FileScan") == 1


def test_ledger_makes_only_the_texts_it_reads(spark, sf_small, monkeypatch):
    names, _ = written(spark, sf_small, "od_stats_merged", monkeypatch)
    assert names == {"joined_legs"}
    stored = spark.read.parquet(R._STORED[R._stored_key(spark, sf_small, "joined_legs")][0])
    assert "transit_details" not in stored.columns and stored.count() == R.raw(spark, sf_small).count()


def shuffled_legs(plan):
    """The columns of the legs' side of the join, as the step below its exchange makes them."""
    lines = plan.split("\n")
    return lines[1 + next(i for i, line in enumerate(lines) if "Exchange hashpartitioning(struct(origin" in line)]


def test_transit_legs_are_not_written_and_shuffle_no_derived_columns(spark, sf_small, monkeypatch):
    names, plan = written(spark, sf_small, "filter_transit", monkeypatch)
    assert names == {"joined_legs"}
    side = shuffled_legs(plan)
    assert "l_dep_stop" in side and not any(f"AS {c}#" in side for c in ("odid", "school_id", "geoid", "run", "t_time"))


def test_trips_of_read_legs_write_no_legs_and_parse_no_texts_for_them(spark, sf_small, monkeypatch):
    names, plan = written(spark, sf_small, "build_trips", monkeypatch)
    assert names == {"joined_legs"}
    assert "l_vehicle" in shuffled_legs(plan) and "departure_stop(" not in plan
