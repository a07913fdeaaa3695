"""Scoring rules (R1-R5) against a direct Python statement of the rules."""

import math

from pyspark.sql import functions as F

from burstlens.functions import scoring as S


def js_round(x):
    return math.floor(x + 0.5)


def cam_health(up, ai, js, ul, pl, v, st):
    h = 100 - 18 * (up < 95) - 12 * (ai < 90) - 10 * (js < 90) - 12 * (ul is not None and ul > 3600) \
        - 14 * (pl is not None and pl > 7200) - 18 * (v is not None and v < 11.5) - 20 * (st is not None and st > 48)
    h = max(0, min(100, js_round(h)))
    a = ((98 - up) * 1.5 if up < 98 else 0) + ((95 - ai) * 0.8 if ai < 95 else 0) \
        + (min(18, ul / 900) if ul is not None else 0) + (min(18, pl / 1200) if pl is not None else 0) \
        + (16 if v is not None and v < 11.5 else 0) + (min(25, st / 2) if st is not None else 0)
    a = max(0, min(100, js_round(a)))
    status = "alert" if a >= 65 or h < 45 else "warning" if a >= 35 or h < 70 else "healthy"
    return h, a, status


CASES = [
    (100.0, 100.0, 100.0, None, None, None, None),
    (94.9, 89.9, 89.9, 3601.0, 7201.0, 11.4, 48.5),
    (95.0, 90.0, 90.0, 3600.0, 7200.0, 11.5, 48.0),
    (0.0, 0.0, 0.0, 100000.0, 100000.0, 1.0, 500.0),
    (97.5, 94.5, 99.0, 0.0, None, 12.0, 0.0),
]


def test_camera_health_scores(spark):
    schema = "up double, ai double, js double, ul double, pl double, v double, st double"
    df = spark.createDataFrame(CASES, schema)
    c = F.col
    out = df.select(
        S.camera_health_score(c("up"), c("ai"), c("js"), c("ul"), c("pl"), c("v"), c("st")).alias("h"),
        S.camera_anomaly_score(c("up"), c("ai"), c("ul"), c("pl"), c("v"), c("st")).alias("a"),
    ).collect()
    for case, row in zip(CASES, out):
        h, a, _ = cam_health(*case)
        assert (row["h"], row["a"]) == (h, a), case


def test_event_scores_and_flags(spark):
    schema = ("up boolean, ai boolean, js boolean, ul int, pl int, al int, v double, b double, ll boolean, "
              "s string, t string, lux int, tmp double, hum double, pres double")
    rows = [
        (False, False, False, 99999, 99999, 99999, 1.0, 1.0, True, None, None, 3, None, None, None),
        (True, True, True, 0, 0, 0, 12.0, 80.0, False, "ok", "t", 100, 1.0, 1.0, 900.0),
        (None, True, False, None, None, None, 11.45, None, False, None, "t", None, 1.0, None, 900.0),
    ]
    df = spark.createDataFrame(rows, schema)
    c = F.col
    out = df.select(
        S.event_health_score(c("up"), c("ai"), c("js"), c("ul"), c("pl"), c("v"), c("b")).alias("h"),
        S.event_anomaly_score(c("up"), c("ai"), c("js"), c("ul"), c("pl"), c("al"), c("v"), c("b"), c("ll"),
                              c("s")).alias("a"),
        S.quality_flags(c("s"), c("t"), c("ai"), c("js"), c("up"), c("v"), c("b"), c("lux"), c("tmp"), c("hum"),
                        c("pres")).alias("f"),
    ).collect()
    assert out[0]["h"] == 0 and out[0]["a"] == 100
    assert out[0]["f"] == ["missing_analysis", "upload_failed", "low_voltage", "low_battery", "low_light",
                           "missing_temperature", "missing_humidity", "missing_pressure"]
    assert out[1]["h"] == 100 and out[1]["a"] == 0 and out[1]["f"] == []
    # json false -10, voltage 11.45 < 11.5 -16; anomaly: json 10 + low voltage 14 + summary null & ai 8
    assert out[2]["h"] == 74 and out[2]["a"] == 32
    assert out[2]["f"] == ["json_pending", "missing_humidity"]
