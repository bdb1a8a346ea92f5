
from pyspark.sql import functions as F

from transitreach.catalog import roles as R
from transitreach.operators import measure as M
from transitreach.operators import shares as SH


def counts(spark, d, cutoff, run="both", transfers=5):
    df = M.filter_trips(R.trips_full(spark, d), R.areas(spark, d), cutoff, run, transfers)
    return {r["geoid"]: (r["schools_accessible"], r["slots_accessible"]) for r in df.collect()}


def test_counts_rise_with_cutoff_and_transfers(spark, sf_small):
    low, high = counts(spark, sf_small, 40), counts(spark, sf_small, 80)
    assert all(high[g][0] >= low[g][0] and high[g][1] >= low[g][1] for g in low)
    few, many = counts(spark, sf_small, 80, transfers=0), counts(spark, sf_small, 80, transfers=5)
    assert all(many[g][0] >= few[g][0] for g in few)
    assert sum(v[0] for v in high.values()) > sum(v[0] for v in low.values())


def test_both_runs_is_the_mean_of_the_runs(spark, sf_small):
    both = counts(spark, sf_small, 75)
    am, pm = counts(spark, sf_small, 75, "morning"), counts(spark, sf_small, 75, "evening")
    assert both.keys() == am.keys() == pm.keys()
    assert all(both[g][0] == (am[g][0] + pm[g][0]) / 2 for g in both)


def test_line_percents_sum_to_100(spark, sf_small):
    shares = SH.line_shares(R.legs(spark, sf_small), top=None)
    (total,) = shares.agg(F.sum("Percent")).first()
    n = shares.count()
    assert abs(total - 100) <= 0.005 * n


def test_leg_counts_bound_modes(spark, sf_small):
    trips = R.trips(spark, sf_small)
    assert trips.where(F.col("t_nlegs") < F.col("t_walking") + F.col("t_transit")).count() == 0
    vehicles = F.col("t_bus") + F.col("t_ferry") + F.col("t_heavyrail") + F.col("t_subway") + F.col("t_tram")
    assert trips.where(vehicles > F.col("t_transit")).count() == 0


def test_primary_keys_unique(spark, sf_small):
    for df, key in ((R.trips(spark, sf_small), ["odid", "run"]),
                    (R.legs(spark, sf_small), ["odid", "run", "l_number"]),
                    (R.schools(spark, sf_small), ["school_id"]),
                    (R.areas(spark, sf_small), ["geoid"])):
        assert df.groupBy(*key).count().where(F.col("count") > 1).count() == 0, key
