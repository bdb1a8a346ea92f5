
import datetime as dt

from rows import DETAILS, raw_frame, raw_row
from transitreach.functions import parse as P
from transitreach.operators.legs import clean_legs, nullify_sentinels, parse_leg_rows

FIELDS = {
    "dep_stop": P.parse_dep_stop, "arr_stop": P.parse_arr_stop, "dep_time": P.parse_dep_time_text,
    "agency": P.parse_agency, "line": P.parse_line, "color": P.parse_color,
    "text_color": P.parse_text_color, "vehicle": P.parse_vehicle, "stops": P.parse_num_stops,
}


def parse_details(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, td string")
    out = df.select("i", *[fn("td").alias(name) for name, fn in FIELDS.items()]).orderBy("i")
    return [r.asDict() for r in out.collect()]


def test_full_details(spark):
    (r,) = parse_details(spark, [DETAILS])
    assert r["dep_stop"] == "Avenue J"
    assert r["arr_stop"] == "Canal St"
    assert r["dep_time"] == "8:10 AM"
    assert r["agency"] == "MTA - NYC Subway"          # recoded
    assert r["line"] == "Q Train"
    assert r["color"] == "#fccc0a"
    assert r["text_color"] == "#000000"
    assert r["vehicle"] == "SUBWAY"
    assert r["stops"] == 9


def test_missing_line_name_falls_through_to_vehicle_name(spark):
    (r,) = parse_details(spark, [DETAILS.replace("'name': 'Q Train', ", "")])
    assert r["line"] == "Subway"


def test_double_quoted_stop_name_runs_on_to_agency(spark):
    text = DETAILS.replace("'name': 'Avenue J'", "'name': \"St Mary's\"")
    (r,) = parse_details(spark, [text])
    assert r["dep_stop"] == "MTA New York City Transit"


def test_null_and_empty_details_give_null(spark):
    rows = parse_details(spark, [None, "", "[{'travel_mode': 'WALKING'}]"])
    for r in rows:
        assert all(r[k] is None for k in FIELDS), r


def test_line_suffix_removed_once(spark):
    text = DETAILS.replace("'Q Train'", "'Q, NYC Subway, NYC Subway'")
    (r,) = parse_details(spark, [text])
    assert r["line"] == "Q, NYC Subway"


def test_sentinels_text_and_float(spark):
    df = spark.createDataFrame([("-999",), ("-999.0",), ("-9990",), ("x",), (None,)], "v string")
    got = [r[0] for r in df.select(P.sentinel_to_null("v")).collect()]
    assert got == [None, None, "-9990", "x", None]


def test_coordinates_without_sign_or_decimals_are_null(spark):
    df = spark.createDataFrame([("{'lat': -33.86, 'lng': 151.2}",), ("{'lat': 40, 'lng': -73.9}",),
                                ("{'lat': 40.5, 'lng': -73.9}",)], "loc string")
    got = [tuple(r) for r in df.select(P.parse_lat("loc"), P.parse_lng("loc")).collect()]
    assert got == [(None, 151.2), (None, -73.9), (40.5, -73.9)]


def _legs(spark, rows, **kw):
    return parse_leg_rows(raw_frame(spark, rows), **kw)


def test_leg_values_and_trip_time(spark):
    (r,) = _legs(spark, [raw_row()]).collect()
    assert r["odid"] == "360470001001-190001"
    assert r["l_number"] == 1
    assert r["l_travelmins"] == 5.0
    assert r["l_distance"] == 1200
    assert r["t_departure"] == dt.datetime(2023, 1, 12, 8, 5)
    assert r["t_time"] == 45.0
    assert r["school_id"] == "190001" and r["geoid"] == "360470001001"
    assert r["l_dep_time"] == dt.datetime(2023, 1, 12, 8, 10)


def test_evening_swaps_odid_and_uses_depart_time(spark):
    row = raw_row(source_run="evening", origin="190001", destination="360470001001",
                  depart_time="01/12/2023 17:00:00 EST", arrival_time=None,
                  actual_departure="5:10 PM", actual_arrival="5:40 PM")
    (r,) = _legs(spark, [row]).collect()
    assert r["odid"] == "360470001001-190001"
    assert r["school_id"] == "190001" and r["geoid"] == "360470001001"
    assert r["t_time"] == 30.0


def test_real_narrow_space_before_am_pm(spark):
    (a, b) = _legs(spark, [raw_row(), raw_row(actual_departure="8:05 AM")]).collect()
    assert a["t_departure"] == b["t_departure"] == dt.datetime(2023, 1, 12, 8, 5)


def test_midnight_crossing_negative_unless_rolled(spark):
    row = raw_row(actual_departure="11:50 PM", actual_arrival="12:20 AM")
    (r,) = _legs(spark, [row]).collect()
    assert r["t_time"] == -(23 * 60 + 30)
    (r,) = _legs(spark, [row], roll_midnight=True).collect()
    assert r["t_time"] == 30.0


def test_null_run_gives_null_ids(spark):
    (r,) = _legs(spark, [raw_row(source_run=None)]).collect()
    assert r["odid"] is None and r["school_id"] is None and r["geoid"] is None


def test_failed_duration_is_null(spark):
    rows = [raw_row(duration="-999"), raw_row(l_number="1", total_time="-999.0")]
    got = _legs(spark, rows).orderBy("l_number").collect()
    assert got[0]["l_travelmins"] is None
    assert got[1]["total_time"] is None


def test_clean_legs_filters_and_transfers(spark):
    rows = [raw_row(l_number="0", travel_mode="WALKING", transit_details=None),
            raw_row(l_number="1"), raw_row(l_number="2"),
            # a second, walk-only pair
            raw_row(destination="190002", travel_mode="WALKING", transit_details=None),
            # a pair whose trip takes 100 minutes: dropped (strict < 100)
            raw_row(destination="190003", actual_arrival="9:45 AM")]
    legs = clean_legs(raw_frame(spark, rows))
    got = {(r["odid"], r["l_number"]): r for r in legs.collect()}
    assert len(got) == 4
    assert got[("360470001001-190001", 1)]["t_transfer"] == 1     # two TRANSIT legs
    assert got[("360470001001-190002", 1)]["t_transfer"] == -1    # walking only
    assert got[("360470001001-190001", 1)]["t_waiting"] == 45.0 - 15.0
    assert "l_instructions" not in legs.columns and "t_travelmins" not in legs.columns


def test_null_mode_makes_transfers_null(spark):
    rows = [raw_row(l_number="0", travel_mode=None), raw_row(l_number="1")]
    got = clean_legs(raw_frame(spark, rows)).select("t_transfer").distinct().collect()
    assert [r[0] for r in got] == [None]


def test_trip_minutes_round_half_even(spark):
    # 2 legs of 75 s = 1.25 min each -> 2.5 -> 2 (half-even), not 3
    rows = [raw_row(l_number="0", duration="{'text': '', 'value': 75}"),
            raw_row(l_number="1", duration="{'text': '', 'value': 75}")]
    legs = clean_legs(raw_frame(spark, rows), keep_helpers=True)
    assert {r["t_travelmins"] for r in legs.collect()} == {2.0}


def test_python_text_without_token_rendering_equals_repr(spark):
    """Both ways of rendering give Python's own text, whatever the spacing."""
    import json
    values = [{"a": 1, "b": "x, y: z", "c": [1, -2.5, {"d": ""}], "e": {}}, [], {}, ["a,b", ":"], "plain", {"k x": "9:05 AM", "n": "\xa0"},
              {"t": True, "f": False, "n": None}, {"it's": 'say "x"', "p": "a\\b", "nullable": "true"}, [[["[", "}"]], "{,"], {"u": "日本 é"}]
    texts = [json.dumps(v, ensure_ascii=e, separators=s) for v in values for e in (True, False)
             for s in ((",", ":"), (", ", ": "), (" ,\n", " :\t "))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i int, t string")
    got = {r["i"]: r["p"] for r in df.select("i", P.python_text("t").alias("p")).collect()}
    assert got.pop(-1) is None
    assert {i: got[i] for i in got} == {i: repr(json.loads(t)) for i, t in enumerate(texts) if i in got}


def test_agency_and_sentinels_are_read_once(spark):
    raw = raw_frame(spark, [raw_row(), raw_row(duration="-999.0", distance="-999 m", l_number="-999")])
    parsed = P.recode_agency("l_agency")
    df = parse_leg_rows(raw)
    assert {r["l_agency"] for r in df.select("l_agency").collect()} == {"MTA - NYC Subway"}
    plan = df.select("l_agency")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("agencies(") == 1                    # nested CASEs repeated the extraction
    names = ["MTA New York City Transit", "MTA", "NJ TRANSIT BUS", "MTA - NYC Bus", None, "LIRR"]
    got = spark.createDataFrame([(n,) for n in names], "l_agency string").select(parsed).collect()
    assert [r[0] for r in got] == ["MTA - NYC Subway", "MTA - NYC Bus", "NJ Transit Bus", "MTA - NYC Bus", None, "LIRR"]
    clean = nullify_sentinels(raw).select("duration", "distance", "l_number").collect()
    assert [tuple(r) for r in clean][1] == (None, "-999 m", None)
