"""Trips, accessibility counts, shares and institution rules (FIXTURES.md section 2)."""

import pytest
from pyspark.sql import functions as F

from transitreach.operators import measure as M
from transitreach.operators import schools as S
from transitreach.operators import shares as SH
from transitreach.operators.trips import build_trips
from transitreach.params import AccessParams

LEG_SCHEMA = ("odid string, run string, origin string, destination string, l_number int, "
              "l_mode string, l_vehicle string, l_line string, l_agency string, t_time double")


def legs_frame(spark, rows):
    return spark.createDataFrame(rows, LEG_SCHEMA)


def test_trips_grouped_by_pair_and_run(spark):
    legs = legs_frame(spark, [
        ("p", "morning", "g", "s", 1, "WALKING", None, None, None, 40.0),
        ("p", "morning", "g", "s", 2, "TRANSIT", "BUS", "B1", "A", 40.0),
        ("p", "evening", "s", "g", 1, "TRANSIT", "SUBWAY", "Q", "A", 50.0),
    ])
    trips = {r["run"]: r for r in build_trips(legs).collect()}
    assert trips["morning"]["t_nlegs"] == 2 and trips["morning"]["t_walking"] == 1
    assert trips["morning"]["t_bus"] == 1 and trips["evening"]["t_subway"] == 1
    assert trips["morning"]["school_id"] == "s" and trips["evening"]["school_id"] == "s"
    assert trips["evening"]["geoid"] == "g"
    # grouping by pair only adds the two runs' legs together
    compat = build_trips(legs, keys=("odid",)).select("t_transit").distinct().collect()
    assert [r[0] for r in compat] == [2]


def trips_frame(spark, rows):
    return spark.createDataFrame(rows, "geoid string, school_id string, run string, t_time double, "
                                       "t_transit long, enrolment long")


def test_both_runs_halve_and_cutoff_is_inclusive(spark):
    trips = trips_frame(spark, [
        ("g1", "s1", "morning", 60.0, 1, 101),   # exactly at the cutoff: kept
        ("g1", "s2", "morning", 30.0, 1, None),  # no enrolment
        ("g1", "s2", "evening", 30.0, 1, None),
        ("g2", "s1", "morning", 61.0, 1, 101),   # too slow
    ])
    areas = spark.createDataFrame([("g1", "a"), ("g2", "b"), ("g3", "c")], "geoid string, name string")
    got = {r["geoid"]: r for r in M.filter_trips(trips, areas, cutoff=60).collect()}
    assert got["g1"]["schools_accessible"] == 1.5
    assert got["g1"]["slots_accessible"] == 51                     # ceiling(101 / 2)
    assert got["g2"]["schools_accessible"] == 0 and got["g2"]["slots_accessible"] == 0
    assert got["g3"]["schools_accessible"] == 0
    one = {r["geoid"]: r for r in M.filter_trips(trips, areas, 60, "evening").collect()}
    assert one["g1"]["schools_accessible"] == 1 and one["g1"]["slots_accessible"] == 0


def test_strict_cutoff_table(spark):
    trips = trips_frame(spark, [("g1", "s1", "morning", 60.0, 1, 10), ("g1", "s2", "morning", 59.0, 1, 5)])
    grid = M.area_run_grid(spark.createDataFrame([("g1",), ("g2",)], "geoid string"))
    got = {(r["geoid"], r["run"]): r for r in M.cutoff_counts(trips, grid, 60).collect()}
    assert got[("g1", "morning")]["n"] == 1 and got[("g1", "morning")]["slots"] == 5
    assert got[("g2", "evening")]["n"] == 0


def test_cutoff_sweep_equals_per_cutoff_counts(spark):
    trips = trips_frame(spark, [("g1", "s1", "morning", float(t), 1, t) for t in (14, 15, 16, 44, 99)]
                        + [("g2", "s1", "evening", 20.0, 1, 7)])
    grid = M.area_run_grid(spark.createDataFrame([("g1",), ("g2",), ("g3",)], "geoid string"))
    sweep = M.cutoff_sweep(trips, grid, cutoffs=(15, 20, 45, 100))
    for cutoff in (15, 20, 45, 100):
        want = sorted(tuple(r) for r in M.cutoff_union(M.cutoff_counts(trips, grid, cutoff), cutoff)
                      .select("geoid", "run", "n", "slots", "cutoff").collect())
        got = sorted(tuple(r) for r in sweep.where(F.col("cutoff") == cutoff)
                     .select("geoid", "run", "n", "slots", "cutoff").collect())
        assert got == want, cutoff


def test_line_shares_exclude_null_lines_and_break_ties_alphabetically(spark):
    rows = [("p", "morning", "g", "s", i, "TRANSIT", "BUS", f"L{i:02d}", "A", 1.0) for i in range(21)]
    rows += [("p", "morning", "g", "s", 99, "TRANSIT", "BUS", None, "A", 1.0),
             ("p", "morning", "g", "s", 98, "WALKING", None, "W", None, 1.0)]
    got = SH.line_shares(legs_frame(spark, rows)).collect()
    assert len(got) == 20
    assert [r["l_line"] for r in got] == [f"L{i:02d}" for i in range(20)]
    assert got[0]["Percent"] == round(100 / 21, 2)


def test_agency_counts_descending(spark):
    rows = [("p", "morning", "g", "s", i, "TRANSIT", "BUS", "L", a, 1.0)
            for i, a in enumerate(["B", "A", "A", None])]
    got = [(r["Agency"], r["Count"]) for r in SH.agency_counts(legs_frame(spark, rows)).collect()]
    assert got == [("A", 2), ("B", 1)]


def test_demographic_percents_half_even_and_zero_enrolment(spark):
    df = spark.createDataFrame([(16, 1, 15, 4, 2, 1, 1, 0), (0, 0, 0, 0, 0, 0, 0, 0)],
                               "Enrolment long, EFYTOTLM long, EFYTOTLW long, EFYWHITT long, "
                               "EFYBKAAW long, EFYHISPT long, EFYASIAT long, EFYNHPIT long")
    a, b = S.demographic_percents(df).collect()
    assert a["Percent male"] == 6.2               # 100 * half-even(0.0625, 3)
    assert a["Percent AAPI"] == 6.2
    assert b["Percent male"] is None


def test_empty_selection_selects_nothing_and_warns(spark):
    schools = spark.createDataFrame(
        [("1", "Under 1,000", "2-year", "Public", "Associate", "C1")],
        "school_id string, size string, degree_level string, sector string, degree_types string, "
        "carnegie string")
    assert S.filter_institutions(schools, AccessParams()).count() == 1
    empty = S.filter_institutions(schools, AccessParams(degree_types=()))
    assert empty.count() == 0
    (r,) = S.non_empty_guard(empty).collect()
    assert r["n_schools"] == 0 and r["warning"].startswith("Error")


def test_an_output_without_trips_does_not_run_the_etl(spark, monkeypatch):
    from transitreach.catalog import roles

    def built(*_):
        raise AssertionError("the ETL ran")

    for name in ("raw", "legs", "trips", "trips_full"):
        monkeypatch.setattr(roles, name, built)
    monkeypatch.setattr(roles, "areas", lambda *_: "areas")
    t = roles.tables(spark, "nowhere")
    assert t.areas == "areas"
    with pytest.raises(AssertionError):
        t.trips
