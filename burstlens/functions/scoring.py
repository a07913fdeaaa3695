"""Scoring and rule operators (R1-R5) as ``Column`` expressions.

They evaluate per row of whatever frame carries the input columns (a camera
aggregate for R1, a canonical event for R2-R5), so they stay inside codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def _pen(cond: Column, points: float) -> Column:
    """``points`` when ``cond`` is true; a null comparison counts as false."""
    return F.when(cond, F.lit(points)).otherwise(F.lit(0))


def _js_round(x: Column) -> Column:
    return F.floor(x + F.lit(0.5))


def _capped(x: Column, div: float, cap: float) -> Column:
    """``min(cap, x / div)`` when ``x`` is present, else 0 (Spark's ``least``
    skips nulls, so the null case is spelled out)."""
    return F.when(x.isNotNull(), F.least(F.lit(float(cap)), x / F.lit(float(div)))).otherwise(F.lit(0.0))


def clamp(x: Column, lo: float = 0, hi: float = 100) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


# ------------------------------------------------------------- R1 (camera)
def camera_health_score(upload_pct: Column, ai_pct: Column, json_pct: Column, upload_lag: Column,
                        proc_lag: Column, volt: Column, stale_hours: Column) -> Column:
    p = K.CAM_HEALTH_PENALTIES
    score = (F.lit(100)
             - _pen(upload_pct < 95, p["upload_pct_below_95"])
             - _pen(ai_pct < 90, p["ai_pct_below_90"])
             - _pen(json_pct < 90, p["json_pct_below_90"])
             - _pen(upload_lag > K.UPLOAD_LAG_LIMIT, p["upload_lag_over_3600"])
             - _pen(proc_lag > K.PROCESSING_LAG_LIMIT, p["proc_lag_over_7200"])
             - _pen(volt < K.LOW_VOLTAGE, p["voltage_below_11_5"])
             - _pen(stale_hours > K.STALE_HOURS, p["stale_over_48h"]))
    return clamp(_js_round(score)).cast("int")


def camera_anomaly_score(upload_pct: Column, ai_pct: Column, upload_lag: Column, proc_lag: Column,
                         volt: Column, stale_hours: Column) -> Column:
    a = K.CAM_ANOMALY
    score = (F.when(upload_pct < a["upload_pct_ref"], (F.lit(a["upload_pct_ref"]) - upload_pct) * a["upload_weight"]).otherwise(0.0)
             + F.when(ai_pct < a["ai_pct_ref"], (F.lit(a["ai_pct_ref"]) - ai_pct) * a["ai_weight"]).otherwise(0.0)
             + _capped(upload_lag, a["upload_lag_div"], a["upload_lag_cap"])
             + _capped(proc_lag, a["proc_lag_div"], a["proc_lag_cap"])
             + _pen(volt < K.LOW_VOLTAGE, a["low_voltage"])
             + _capped(stale_hours, a["stale_div"], a["stale_cap"]))
    return clamp(_js_round(score)).cast("int")


def status(health: Column, anomaly: Column, uploaded: Column | None = None) -> Column:
    alert = (anomaly >= K.STATUS_ALERT_ANOMALY) | (health < K.STATUS_ALERT_HEALTH)
    if uploaded is not None:
        alert = (uploaded == F.lit(False)) | alert
    return (F.when(alert, F.lit("alert"))
            .when((anomaly >= K.STATUS_WARN_ANOMALY) | (health < K.STATUS_WARN_HEALTH), F.lit("warning"))
            .otherwise(F.lit("healthy")))


def alert_reason(stale_hours: Column, volt: Column, proc_lag: Column, ai_pct: Column) -> Column:
    stale, volts, lag, ai = K.ALERT_REASONS
    return (F.when(stale_hours > K.STALE_HOURS, F.lit(stale))
            .when(volt < K.LOW_VOLTAGE, F.lit(volts))
            .when(proc_lag > K.PROCESSING_LAG_LIMIT, F.lit(lag))
            .when(ai_pct < 90, F.lit(ai)))


# ------------------------------------------------------------ R2-R4 (event)
def event_health_score(uploaded: Column, ai: Column, js: Column, upload_lag: Column, proc_lag: Column,
                       volt: Column, batt: Column) -> Column:
    p = K.EVENT_HEALTH_PENALTIES
    score = (F.lit(100)
             - _pen(uploaded == F.lit(False), p["upload_failed"])
             - _pen(ai == F.lit(False), p["ai_false"])
             - _pen(js == F.lit(False), p["json_false"])
             - _pen(upload_lag > K.UPLOAD_LAG_LIMIT, p["upload_lag_over_3600"])
             - _pen(proc_lag > K.PROCESSING_LAG_LIMIT, p["proc_lag_over_7200"])
             - _pen(volt < K.LOW_VOLTAGE, p["voltage_below_11_5"])
             - _pen(batt < K.LOW_BATTERY, p["battery_below_20"]))
    return clamp(score).cast("int")


def event_anomaly_score(uploaded: Column, ai: Column, js: Column, upload_lag: Column, proc_lag: Column,
                        ai_lag: Column, volt: Column, batt: Column, low_light: Column,
                        summary: Column) -> Column:
    a = K.EVENT_ANOMALY
    score = (_pen(uploaded == F.lit(False), a["upload_failed"])
             + _pen(ai == F.lit(False), a["ai_false"])
             + _pen(js == F.lit(False), a["json_false"])
             + _capped(upload_lag, a["upload_lag_div"], a["upload_lag_cap"])
             + _capped(proc_lag, a["proc_lag_div"], a["proc_lag_cap"])
             + _capped(ai_lag, a["ai_lag_div"], a["ai_lag_cap"])
             + _pen(volt < K.LOW_VOLTAGE, a["low_voltage"])
             + _pen(batt < K.LOW_BATTERY, a["low_battery"])
             + _pen(summary.isNull() & (ai == F.lit(True)), a["ai_without_summary"])
             + _pen(low_light, a["low_light"]))
    return clamp(_js_round(score)).cast("int")


# ------------------------------------------------------------------ R5 flags
def quality_flags(summary: Column, title: Column, ai: Column, js: Column, uploaded: Column,
                  volt: Column, batt: Column, lux: Column, temp: Column, hum: Column,
                  pres: Column) -> Column:
    no_text = summary.isNull() & title.isNull()
    conds = [
        no_text,
        (ai == F.lit(True)) & no_text,
        (js == F.lit(False)) & (ai == F.lit(True)),
        uploaded == F.lit(False),
        volt < K.LOW_VOLTAGE_FLAG,
        batt < K.LOW_BATTERY,
        lux < K.LOW_LIGHT_LUX,
        temp.isNull(),
        hum.isNull(),
        pres.isNull(),
    ]
    arr = F.array(*[F.when(c, F.lit(name)) for c, name in zip(conds, K.QUALITY_FLAGS)])
    return F.filter(arr, lambda x: x.isNotNull())
