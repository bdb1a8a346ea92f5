
import json

import pytest
from pyspark.sql import functions as F

from transitreach.functions.parse import python_text
from transitreach.operators.legs import clean_legs
from transitreach.plans.acquire import dense_index, finished_batch, flatten_responses, request_plan
from transitreach.sources.batches import BATCH_COLUMNS, load_batches
from transitreach.sources.sinks import write_batch


def points(spark, ids):
    return spark.createDataFrame([(str(i), float(i), -float(i), i) for i in ids],
                                 "id string, lat double, lng double, ord long")


def test_dense_index_is_file_order(spark):
    df = dense_index(points(spark, [40, 10, 30, 20, 50]).repartition(3), "ord", "pos")
    assert sorted((r["ord"], r["pos"]) for r in df.collect()) == [(10, 0), (20, 1), (30, 2), (40, 3), (50, 4)]


def test_batch_slice_and_request_numbers(spark):
    schools = points(spark, range(100, 106))
    areas = points(spark, range(1, 5))
    plan = request_plan(areas, schools, dest_start=2, dest_end=4, order_col="ord", run="morning")
    got = sorted((r["request_id"], r["origin"], r["destination"]) for r in plan.collect())
    # destinations 102 and 103 (positions 0, 1 of the slice) x 4 origins
    assert got == [(d * 4 + o + 1, str(o + 1), str(102 + d)) for d in range(2) for o in range(4)]


def test_failed_responses_become_one_failed_row(spark):
    ok = ('[{"legs": [{"departure_time": {"text": "8:00 AM", "value": 0}, '
          '"arrival_time": {"text": "8:30 AM", "value": 1800}, "steps": ['
          '{"travel_mode": "WALKING", "duration": {"text": "1", "value": 60}}, '
          '{"travel_mode": "TRANSIT", "duration": {"text": "2", "value": 120}}]}]}]')
    no_times = '[{"legs": [{"steps": [{"travel_mode": "WALKING"}]}]}]'
    rows = [("a", "x", ok), ("b", "x", "[]"), ("c", "x", no_times), ("d", "x", "not json"), ("e", "x", None)]
    df = spark.createDataFrame(rows, "origin string, destination string, response string")
    out = flatten_responses(df).collect()
    by_origin = {}
    for r in out:
        by_origin.setdefault(r["origin"], []).append(r)
    assert len(by_origin["a"]) == 2 and by_origin["a"][0]["total_time"] == 30.0
    assert not any(r["failed"] for r in by_origin["a"])
    assert sorted(r["duration_s"] for r in by_origin["a"]) == [60, 120]
    for o in "bcde":
        assert len(by_origin[o]) == 1 and by_origin[o][0]["failed"]
        assert by_origin[o][0]["duration_s"] is None


@pytest.mark.parametrize("partitions", ["8", "64"])
def test_dense_index_of_many_rows_is_the_rank(spark, tmp_path, partitions):
    n = 300_000
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        ids = spark.range(n).select(((F.col("id") * 7_919) % n).alias("ord"))        # a permutation of 0..n-1
        dense_index(ids, "ord", "pos").write.parquet(str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    written = spark.read.parquet(str(tmp_path / "out"))
    assert written.count() == n and written.where("ord <> pos").count() == 0


VALUES = [
    {"b": 1, "a": [1.5, -2, True, False, None], "c": {}},
    {"name": "Fulton St, \"A\": {x}", "apostrophe": "St George's", "both": "a'b\"c"},
    {"t": "8:00\u202fAM", "s": "a\\b", "n": "line\nbreak", "tab": "\t", "e": "", "u": "caf\u00e9"},
    [], [{"travel_mode": "WALKING"}, "null", "true"],
]


@pytest.mark.parametrize("ascii_only", [True, False])
def test_python_text_is_what_python_prints(spark, ascii_only):
    rows = [(i, json.dumps(v, ensure_ascii=ascii_only)) for i, v in enumerate(VALUES)] + [(99, None)]
    out = spark.createDataFrame(rows, "i int, j string").select("i", python_text("j").alias("t")).collect()
    got = {r["i"]: r["t"] for r in out}
    assert got == {**{i: repr(v) for i, v in enumerate(VALUES)}, 99: None}


def response(legs_timed=True, modes=("WALKING", "TRANSIT")):
    details = {
        "arrival_stop": {"location": {"lat": 40.7, "lng": -73.9}, "name": "St George's"},
        "arrival_time": {"text": "8:25\u202fAM", "time_zone": "America/New_York", "value": 1},
        "departure_stop": {"location": {"lat": 40.6, "lng": -73.9}, "name": "Fulton St"},
        "departure_time": {"text": "8:05\u202fAM", "time_zone": "America/New_York", "value": 1},
        "line": {"agencies": [{"name": "MTA New York City Transit", "phone": "1", "url": "u"}], "color": "#0039a6",
                 "name": "A Line", "text_color": "#ffffff",
                 "vehicle": {"icon": "i", "name": "Subway", "type": "SUBWAY"}}, "num_stops": 7}
    steps = [{"distance": {"text": "1 km", "value": 900}, "duration": {"text": "5 mins", "value": 300},
              "end_location": {"lat": 40.7, "lng": -73.9}, "start_location": {"lat": 40.6, "lng": -73.8},
              "html_instructions": "Go, then \"stop\"\nhere", "travel_mode": mode, "polyline": {"points": "x"},
              **({"steps": [{"travel_mode": "WALKING"}]} if mode == "WALKING" else {"transit_details": details})}
             for mode in modes]
    times = {"departure_time": {"text": "8:00 AM", "value": 0}, "arrival_time": {"text": "8:30 AM", "value": 1800}}
    return json.dumps([{"legs": [{**(times if legs_timed else {}), "steps": steps}]}])


def batch(spark, **options):
    rows = [("g1", "s1", response()), ("g1", "s2", "[]"), ("g2", "s1", response(False, ("WALKING",))),
            ("g2", "s2", response(False))]
    df = spark.createDataFrame(rows, "origin string, destination string, response string")
    df = df.withColumn("requested_at", F.lit("2023-01-05 14:00:00").cast("timestamp_ntz"))
    return finished_batch(df, arrival_time="01/05/2023 09:00:00 EST", **options)


def test_finished_batch_round_trip_and_transit_columns(spark, tmp_path):
    name = write_batch(batch(spark), str(tmp_path / "out"), "morning", "key", 0, 2)
    copy = spark.read.parquet(str(tmp_path / "out" / f"{name}.parquet"))
    stored = load_batches(spark, str(tmp_path / "out"))
    assert tuple(copy.columns) == BATCH_COLUMNS
    texts = [c for c in BATCH_COLUMNS[1:]]
    expected = sorted((tuple(None if v == "NA" else v for v in r) for r in copy.select(texts).collect()), key=str)
    assert sorted((tuple(r) for r in stored.select(texts).collect()), key=str) == expected
    assert {r["request_time"] for r in stored.collect()} == {"01/05/2023 09:00:00 EST"}
    legs = {r["l_mode"]: r for r in clean_legs(stored).collect()}
    ride = legs["TRANSIT"]
    assert (ride["l_line"], ride["l_agency"], ride["l_vehicle"], ride["l_num_stops"], ride["l_color"],
            ride["l_text_color"], ride["l_dep_stop"], ride["t_transfer"]) == (
        "A Line", "MTA - NYC Subway", "SUBWAY", 7, "#0039a6", "#ffffff", "Fulton St", 0)
    assert legs["WALKING"]["l_travelmins"] == 5.0 and len(legs) == 2


def test_walk_only_routes_are_kept_on_demand(spark):
    def modes(**options):
        return {(r["origin"], r["destination"]): r["travel_mode"] for r in batch(spark, **options).collect()
                if r["travel_mode"] != "TRANSIT"}
    assert modes() == {("g1", "s1"): "WALKING", ("g1", "s2"): "-999", ("g2", "s1"): "-999", ("g2", "s2"): "-999"}
    assert modes(keep_walk_only=True)[("g2", "s1")] == "WALKING"
    assert modes(keep_walk_only=True)[("g2", "s2")] == "-999"       # a ride without times stays an error


def test_request_plan_spreads_the_expansion_over_tasks(spark, monkeypatch):
    from transitreach.plans import acquire

    monkeypatch.setattr(acquire, "REQUESTS_PER_TASK", 100)
    points = spark.range(60).select(F.col("id"), F.col("id").cast("double").alias("lat"),
                                    F.col("id").cast("double").alias("lng"))
    plan = request_plan(points, points)
    assert plan.count() == 3600 and plan.select("request_id").distinct().count() == 3600
    by_task = plan.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(by_task) > 20 and max(r["count"] for r in by_task) < 1000


def test_a_task_of_the_request_plan_takes_few_origins(spark, monkeypatch):
    from transitreach.plans import acquire

    for name, value in (("REQUESTS_PER_TASK", 100), ("POSITION_BLOCK", 12), ("POSITION_RUN", 4)):
        monkeypatch.setattr(acquire, name, value)
    points = spark.range(50).select(F.col("id"), F.col("id").cast("double").alias("lat"), F.col("id").cast("double").alias("lng"))
    rows = request_plan(points, points).withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r["request_id"] for r in rows) == [*range(1, 2501)]
    assert all(r["request_id"] == r["destination"] * 50 + r["origin"] + 1 for r in rows)
    of = {}
    for r in rows:
        of.setdefault(r["task"], []).append(r["origin"] // 4)
    assert len(of) == 25 and max(map(len, of.values())) <= 200
    assert all(len(set(x)) <= 6 and x == sorted(x) for x in of.values())     # whole runs, one after the other
