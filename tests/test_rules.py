"""Canonicalisation rules on hand-made edge frames (FIXTURES section 2)."""

import datetime as dt

import pytest

from conftest import raw_frame

from burstlens.operators import canonical as C

T0 = dt.datetime(2024, 1, 1, 12, 0, 0)


def canon_rows(spark, rows):
    base = {"mac": "m", "utc_timestamp": T0, "sequence": 1}
    out = C.canonical(raw_frame(spark, [{**base, "id": str(i), **r} for i, r in enumerate(rows)]))
    return {r["id"]: r for r in out.collect()}


def test_class_ladder_precedence_and_stored_values(spark):
    rows = canon_rows(spark, [
        {"analysis": '{"summary": "a bear chasing a wolf"}'},         # wolf before bear
        {"analysis": '{"title": "old scar on a post"}'},              # plain substring: car
        {"subject_class": " Fox Coyote "},                             # stored, normalised
        {"analysis": '{"keywords": {"Threats": "threat seen"}}'},      # no class, threat category
        {},                                                            # nothing
        {"analysis": '{"details": {"main_subject": "Antler shed"}}'},  # deer via antler
        {"analysis_title": "no active subject", "analysis": '{"title": "still meadow"}'},
        {"ai_description": '  {"keywords": {"People": "two hikers"}}'},  # leading spaces parse
        {"ai_description": '{broken'},                                 # malformed -> null doc
    ])
    assert rows["0"]["subject_class"] == "wolf"
    assert rows["1"]["subject_class"] == "vehicle" and rows["1"]["category"] == "vehicle"
    assert rows["2"]["subject_class"] == "fox_coyote" and rows["2"]["category"] == "wildlife"
    assert rows["3"]["subject_class"] is None and rows["3"]["category"] == "threat"
    assert rows["4"]["subject_class"] is None and rows["4"]["category"] is None
    assert rows["4"]["subject_category"] == "unknown"
    assert rows["5"]["subject_class"] == "deer"
    assert rows["6"]["subject_class"] == "empty_landscape" and rows["6"]["category"] == "empty_scene"
    assert rows["7"]["subject_class"] == "hiker" and rows["7"]["category"] == "human"
    assert rows["8"]["subject_class"] is None and rows["8"]["analysis_title"] is None


def test_stored_category_wins_and_is_normalised(spark):
    rows = canon_rows(spark, [{"subject_category": "Empty Scene", "subject_class": "elk"}])
    assert rows["0"]["category"] == "empty_scene"


HOURS = [0, 4, 5, 6, 7, 8, 11, 12, 16, 17, 20, 21, 22, 23]
BUCKET = {0: "night", 4: "night", 5: "night", 6: "morning", 7: "morning", 8: "morning", 11: "morning",
          12: "afternoon", 16: "afternoon", 17: "evening", 20: "evening", 21: "evening", 22: "night", 23: "night"}
DAYPART = {0: "night", 4: "night", 5: "dawn", 6: "dawn", 7: "dawn", 8: "day", 11: "day", 12: "day", 16: "day",
           17: "dusk", 20: "dusk", 21: "night", 22: "night", 23: "night"}


def test_bucket_and_daypart_cut_points(spark):
    rows = canon_rows(spark, [{"timestamp": T0.replace(hour=h)} for h in HOURS])
    for i, h in enumerate(HOURS):
        r = rows[str(i)]
        assert r["time_of_day_bucket"] == BUCKET[h], h
        assert r["daypart"] == DAYPART[h], h


def test_stored_bucket_and_timestamp_fallbacks(spark):
    rows = canon_rows(spark, [
        {"time_of_day_bucket": " dusk ", "timestamp": T0},
        {"timestamp": None, "utc_timestamp_off": T0.replace(hour=3)},
        {"timestamp": None, "utc_timestamp": None, "created": T0.replace(hour=9)},
    ])
    assert rows["0"]["time_of_day_bucket"] == "dusk"
    assert rows["1"]["local_timestamp"].hour == 3
    assert rows["2"]["local_timestamp"] is not None


def test_lags_round_half_away_and_floor_at_zero(spark):
    rows = canon_rows(spark, [
        {"timestamp": T0, "created": None},
        {"timestamp": T0, "created": T0 - dt.timedelta(seconds=30)},
        {"timestamp": T0, "created": T0 + dt.timedelta(seconds=2, microseconds=500000)},
        {"timestamp": T0, "created": T0 + dt.timedelta(seconds=3601), "ai_timestamp": T0 + dt.timedelta(seconds=7201)},
        {"timestamp": T0, "json_timestamp": T0 + dt.timedelta(seconds=10)},
    ])
    assert rows["0"]["upload_lag_seconds"] is None and rows["0"]["processing_lag_seconds"] is None
    assert rows["1"]["upload_lag_seconds"] == 0
    assert rows["2"]["upload_lag_seconds"] == 3
    assert rows["3"]["upload_lag_seconds"] == 3601 and rows["3"]["processing_lag_seconds"] == 7201
    assert rows["4"]["processing_lag_seconds"] == 10 and rows["4"]["ai_lag_seconds"] is None


@pytest.mark.parametrize("col,lo,hi,typ", [
    ("voltage", 0, 18, float), ("temperature", -60, 160, float), ("humidity", 0, 100, float),
    ("pressure", 800, 1200, float), ("lux", 0, 200000, int), ("bearing", 0, 360, int),
    ("latitude", -90, 90, float), ("longitude", -180, 180, float),
])
def test_range_bounds(spark, col, lo, hi, typ):
    step = typ(1) if typ is int else 0.001
    vals = [lo, hi, lo - step, hi + step]
    rows = canon_rows(spark, [{col: typ(v)} for v in vals])
    assert rows["0"][col] == lo and rows["1"][col] == hi
    assert rows["2"][col] is None and rows["3"][col] is None


def test_camel_and_snake_twins(spark):
    rows = canon_rows(spark, [
        {"battery_percentage": 50.0, "batteryPercentage": 10.0, "heat_level": None, "heatLevel": 30},
        {"battery_percentage": None, "batteryPercentage": 150.0},
        {"file_type": " ", "fileType": "camera"},
    ])
    assert rows["0"]["battery_percentage"] == 50.0 and rows["0"]["heat_level"] == 30
    assert rows["1"]["battery_percentage"] is None and rows["1"]["raw_battery_percentage"] == 150.0
    assert rows["1"]["suspicious_numeric_flag"] is True
    assert rows["2"]["file_type"] == "camera"


def test_identity_and_text_defaults(spark):
    rows = canon_rows(spark, [
        {"camera_name": " ", "name": "alt", "event": " ", "upload": "", "uploaded": False, "timezone": "  "},
        {"camera_name": None, "name": None, "event": "e1", "uploaded": None, "analysis_summary": " ",
         "analysis": '{"summary": "from json"}'},
    ])
    r0, r1 = rows["0"], rows["1"]
    assert r0["camera_name"] == "alt" and r0["event_group"] == "0" and r0["upload"] == "false"
    assert r0["timezone"] == "America/Denver"
    assert r1["camera_name"] == "m" and r1["event_group"] == "e1" and r1["upload"] is None
    assert r1["analysis_summary"] == "from json"


def test_low_light_and_parse_success(spark):
    rows = canon_rows(spark, [{"lux": 14}, {"lux": 15}, {"lux": None}, {"lux": -3, "ai_description": "x"}])
    assert [rows[str(i)]["low_light_flag"] for i in range(4)] == [True, False, False, False]
    assert rows["3"]["parse_success"] is True and rows["0"]["parse_success"] is False
