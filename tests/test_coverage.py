"""Interval coverage and the running sum beneath it, against brute force."""

import random
from collections import Counter
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from transitreach.operators import coverage as CV
from transitreach.operators.scan import running

SCHEMA = "source_run string, source_start_index bigint, source_end_index bigint"


def brute(rows, first, last):
    out = []
    for run in {r for r, *_ in rows}:
        times = Counter(x for r, a, b in rows if r == run and a is not None and b is not None for x in range(a, b))
        for x in range(first, last):
            times.setdefault(x, 0)
        for (n, inside, _), xs in groupby(enumerate(sorted(times)), key=lambda t: (
                times[t[1]], first <= t[1] < last, t[1] - t[0])):
            xs = [x for _, x in xs]
            kind = "unexpected" if not inside else "missing" if n == 0 else "once" if n == 1 else "repeated"
            out.append((run, xs[0], xs[-1] + 1, n, kind))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_segments(spark, seed):
    rng = random.Random(seed)
    rows = []
    for run in ("morning", "evening", None):
        for _ in range(60):
            a = rng.randrange(-20, 420)
            rows.append((run, a, a + rng.randrange(-2, 12)))
    rows += [("late", None, None), ("late", 5, 5), ("all", 0, 400), ("twice", 0, 200), ("twice", 200, 400), ("twice", 100, 101)]
    ranges = spark.createDataFrame(rows, SCHEMA).repartition(3)
    segments = CV.coverage_segments(ranges, 0, 400)
    assert sorted((tuple(r) for r in segments.collect()), key=str) == brute(rows, 0, 400)
    per_run = {r["source_run"]: r for r in CV.coverage_summary(segments, ranges).collect()}
    assert per_run["all"]["valid"] and per_run["twice"]["valid"] and not per_run["late"]["valid"]
    assert (per_run["twice"]["refetched"], per_run["twice"]["n_files"], per_run["late"]["missing"]) == (1, 3, 400)


def test_an_overlap_does_not_hide_a_gap(spark):
    """Widths add up to the expected total, yet an index is missing."""
    ranges = spark.createDataFrame([("m", 0, 6), ("m", 4, 8)], SCHEMA)
    row = CV.coverage_summary(CV.coverage_segments(ranges, 0, 10), ranges).first()
    assert (row["covered"], row["missing"], row["refetched"], row["valid"]) == (8, 2, 2, False)


def test_empty(spark):
    assert CV.coverage_segments(spark.createDataFrame([], SCHEMA), 0, 9).count() == 0


def test_running_carries_over_partitions(spark):
    """One group with nearly all rows lies in many partitions."""
    rng = random.Random(1)
    rows = [("hot" if k % 20 else None if k % 40 else "b", k, rng.randrange(-5, 6)) for k in range(3000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = running(spark.createDataFrame(rows, "g string, k bigint, v bigint").repartition(5), ["g"], "k", "v", "total", "next").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = []
    for g in {r[0] for r in rows}:
        own, total = [r for r in rows if r[0] == g], 0
        for i, (_, k, v) in enumerate(own):
            total += v
            want.append((g, k, v, total, own[i + 1][1] if i + 1 < len(own) else None))
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)


def test_plan_has_no_single_partition(spark):
    ranges = spark.createDataFrame([("m", 0, 6)], SCHEMA).withColumn("source_end_index", F.col("source_end_index"))
    plan = CV.coverage_segments(ranges, 0, 10)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "CartesianProduct" not in plan
