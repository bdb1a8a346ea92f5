"""The maintained cube and the bitmap facets against the plain operators."""

import random

import pytest
from pyspark.sql import functions as F

from transitreach import params as PA
from transitreach.operators import facets as FA
from transitreach.operators import measure as M
from transitreach.plans.cube import AccessCube, cube_cells

SCHOOL = "school_id string, size string, sector string, degree_level string, degree_types string, carnegie string"
TRIP = "geoid string, school_id string, run string, t_time double, t_transit bigint, enrolment bigint"


def schools_rows(rng, n):
    def pick(values):
        return rng.choice([*values, None]) if rng.random() < 0.1 else rng.choice(values)
    return [(f"s{i}", pick(PA.SIZE_CHOICES), pick(PA.SECTOR_CHOICES), pick(PA.DEGREE_LEVEL_CHOICES),
             pick(PA.DEGREE_TYPE_CHOICES), pick(["C1", "C2", "C3"])) for i in range(n)]


def snapshot(rng):
    def some(values):
        return tuple(rng.sample(values, rng.randrange(1, len(values) + 1)))
    return PA.AccessParams(sizes=some(PA.SIZE_CHOICES), sectors=some(PA.SECTOR_CHOICES),
                           degree_levels=some(PA.DEGREE_LEVEL_CHOICES), degree_types=some(PA.DEGREE_TYPE_CHOICES),
                           carnegie=rng.choice([None, ("C1",), ("C2", "C3")]), run=rng.choice(["both", "morning", "evening"]),
                           cutoff=rng.choice([15, 37.5, 60, 100]), transfers=rng.randrange(0, 6))


@pytest.fixture(scope="module")
def data():
    rng = random.Random(11)
    schools = schools_rows(rng, 40)
    trips = [(f"g{rng.randrange(12)}", f"s{rng.randrange(44)}", rng.choice(["morning", "evening"]),
              rng.choice([None, float(rng.randrange(5, 100)), 60.0]), rng.choice([None, *range(6)]),
              rng.choice([None, 0, rng.randrange(5000)])) for _ in range(900)]
    return rng, schools, trips


def test_cube_equals_the_trips_after_every_batch(spark, tmp_path, data):
    rng, schools_, trips = data
    schools = spark.createDataFrame(schools_, SCHOOL)
    areas = spark.createDataFrame([(f"g{i}", f"n{i}") for i in range(14)], "geoid string, name string")
    cube = AccessCube(spark, str(tmp_path / "cube"))
    rows = []
    for b, at in enumerate(range(0, 900, 300)):
        part = spark.createDataFrame(trips[at:at + 300], TRIP)
        cube.add(str(b), part, schools)
        cube.add(str(b), part, schools)                  # delivered again
        rows += trips[at:at + 300]
    gone = rows[:50]                                       # corrections: out with the old trip, in with the new one
    new = [(*r[:3], 33.0, 2, 77) for r in gone]
    fixed = spark.createDataFrame([(*r, -1) for r in gone] + [(*r, 1) for r in new], TRIP + ", sign int")
    cube.add("fix", fixed, schools)
    rows = rows[50:] + new
    every = spark.createDataFrame(rows, TRIP)
    small = cube.compacted(str(tmp_path / "base"))
    assert small.cells().count() == cube_cells(every, schools).where("n_trips <> 0 OR n_places <> 0").count()
    for k in range(4):
        p = snapshot(rng)
        chosen = schools
        for column, field in FA.PICKERS:
            if (values := getattr(p, field)) is not None:
                chosen = chosen.where(F.col(column).isin(list(values)))
        want = sorted(tuple(r) for r in M.accessibility_selected(every, areas, chosen, p, F.lit("x")).drop("school_carnegie").collect())
        for c in (cube, small):
            got = sorted(tuple(r) for r in c.accessibility(areas, schools, p).drop("school_carnegie").collect())
            assert got == want, p


def test_cube_pushes_the_snapshot_to_its_files(spark, tmp_path, data):
    _, schools, trips = data
    cube = AccessCube(spark, str(tmp_path / "cube"))
    cube.add("0", spark.createDataFrame(trips, TRIP), spark.createDataFrame(schools, SCHOOL))
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    try:
        plan = cube.counts(PA.AccessParams(run="morning"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "LessThanOrEqual(t_time" in plan and "EqualTo(run,morning)" in plan and "Join" not in plan


@pytest.mark.parametrize("n", [0, 1, 60])
def test_facets(spark, data, n):
    rng, *_ = data
    rows = schools_rows(random.Random(n), n)
    index = FA.bitmap_index(spark.createDataFrame(rows, SCHOOL))
    names = [c for c, _ in FA.PICKERS]
    for p in [snapshot(rng), PA.AccessParams(), PA.AccessParams(sectors=()), snapshot(rng)]:
        choice = {c: getattr(p, f) for c, f in FA.PICKERS}
        want = []
        for i, c in enumerate(names):
            for v in {r[i + 1] for r in rows}:
                left = sum(r[i + 1] == v and all(choice[o] is None or r[j + 1] in choice[o]
                                                 for j, o in enumerate(names) if o != c) for r in rows)
                want.append((c, v, left, choice[c] is None or v in choice[c]))
        assert sorted((tuple(r) for r in FA.facet_counts(index, p).collect()), key=str) == sorted(want, key=str)


def test_facets_over_several_buckets(spark):
    """More positions than one bitmap holds; a bucket in which one picker matches nothing."""
    rows = spark.range(70_000).select(
        F.format_string("s%06d", "id").alias("school_id"), F.when(F.col("id") < 40_000, "Public").otherwise("Private nonprofit").alias("sector"),
        F.lit("2-year").alias("degree_level"), F.lit("Doctoral").alias("degree_types"),
        F.when(F.col("id") % 2 == 0, "Under 1,000").otherwise("1,000 - 4,999").alias("size"), F.lit("C1").alias("carnegie"))
    p = PA.AccessParams(sectors=("Public",), sizes=("Under 1,000",))
    got = {(r["dimension"], r["value"]): r["n_schools"] for r in FA.facet_counts(FA.bitmap_index(rows), p).collect()}
    assert got["sector", "Public"] == 20_000 and got["sector", "Private nonprofit"] == 15_000
    assert got["size", "Under 1,000"] == 20_000 and got["size", "1,000 - 4,999"] == 20_000 and got["carnegie", "C1"] == 20_000
