"""Operations reports: camera health, overview KPIs, funnel, anomalies, quality.

Per-camera distinct-group measures are computed in two explicit stages,
``(camera, group)`` then ``camera``, each a hash aggregate with map-side
partial aggregation.  This replaces the multi-``count(distinct ...) filter``
form, which Spark would execute by expanding every row once per distinct
aggregate.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import normalize as N
from ..functions import scoring as S


def _as_of(canon: DataFrame, as_of) -> Column:
    """A fixed reference time, or the newest event of the slice (scalar subquery)."""
    if as_of is None:
        return canon.agg(F.max("local_timestamp")).scalar()
    if isinstance(as_of, str):
        as_of = dt.datetime.fromisoformat(as_of)
    return N.literal(as_of)


def _pct(part: Column, whole: Column) -> Column:
    """``coalesce(100 * part / nullif(whole, 0), 0)`` in double precision."""
    return F.coalesce(F.lit(100.0) * part / F.nullif(whole, F.lit(0)), F.lit(0.0))


def camera_rollup(canon: DataFrame, as_of=None) -> DataFrame:
    """Per-camera aggregate shared by camera health (A11) and anomalies."""
    per_group = canon.groupBy("camera_name", "event_group").agg(
        F.max("local_timestamp").alias("_last"),
        F.bool_or("ai_processed").alias("_ai"),
        F.bool_or("json_processed").alias("_js"),
        F.bool_or("uploaded").alias("_up"),
        F.sum("upload_lag_seconds").alias("_ul_s"), F.count("upload_lag_seconds").alias("_ul_n"),
        F.sum("ai_lag_seconds").alias("_al_s"), F.count("ai_lag_seconds").alias("_al_n"),
        F.sum("processing_lag_seconds").alias("_pl_s"), F.count("processing_lag_seconds").alias("_pl_n"),
        F.sum("voltage").alias("_v_s"), F.count("voltage").alias("_v_n"),
        F.count(F.lit(1)).alias("_rows"),
        F.count_if(F.col("suspicious_numeric_flag")).alias("_susp"),
        F.count_if(F.col("voltage").isNotNull() & (F.col("voltage") < K.LOW_VOLTAGE)).alias("_lowv"),
        F.count_if((F.col("ai_processed") == F.lit(False)) | F.col("analysis_summary").isNull()).alias("_miss"),
    )
    has_group = F.col("event_group").isNotNull()
    groups = F.count("event_group")
    ref = _as_of(canon, as_of)
    out = per_group.groupBy("camera_name").agg(
        F.max("_last").alias("last_ts"),
        groups.alias("total_events"),
        _pct(F.count_if(has_group & F.col("_ai")), groups).alias("ai_processed_pct"),
        _pct(F.count_if(has_group & F.col("_js")), groups).alias("json_processed_pct"),
        _pct(F.count_if(has_group & F.col("_up")), groups).alias("upload_success_pct"),
        (F.sum("_ul_s") / F.sum("_ul_n")).alias("avg_upload_lag_seconds"),
        (F.sum("_al_s") / F.sum("_al_n")).alias("avg_ai_lag_seconds"),
        (F.sum("_pl_s") / F.sum("_pl_n")).alias("avg_processing_lag_seconds"),
        (F.sum("_v_s") / F.sum("_v_n")).alias("avg_voltage"),
        F.sum("_rows").alias("total_rows"),
        F.sum("_susp").alias("suspicious_telemetry_count"),
        _pct(F.sum("_lowv"), F.sum("_rows")).alias("low_voltage_rate_pct"),
        _pct(F.sum("_miss"), F.sum("_rows")).alias("missing_ai_rate_pct"),
    )
    return out.select(
        "*",
        N.iso_seconds(F.col("last_ts")).alias("last_seen"),
        (F.timestamp_diff("MICROSECOND", F.col("last_ts"), ref) / F.lit(3.6e9)).alias("last_seen_hours_ago"),
    )


def camera_health(canon: DataFrame, as_of=None) -> DataFrame:
    """A11 + R1: per-camera health and anomaly scores, status and alert reason."""
    r = camera_rollup(canon, as_of)
    c = F.col
    health = S.camera_health_score(c("upload_success_pct"), c("ai_processed_pct"), c("json_processed_pct"),
                                   c("avg_upload_lag_seconds"), c("avg_processing_lag_seconds"),
                                   c("avg_voltage"), c("last_seen_hours_ago"))
    anomaly = S.camera_anomaly_score(c("upload_success_pct"), c("ai_processed_pct"),
                                     c("avg_upload_lag_seconds"), c("avg_processing_lag_seconds"),
                                     c("avg_voltage"), c("last_seen_hours_ago"))
    scored = r.select("*", health.alias("health_score"), anomaly.alias("anomaly_score"))
    return scored.select(
        "camera_name", "last_seen", "last_seen_hours_ago", "total_events",
        N.js_round(c("ai_processed_pct")).alias("ai_processed_pct"),
        N.js_round(c("json_processed_pct")).alias("json_processed_pct"),
        N.js_round(c("upload_success_pct")).alias("upload_success_pct"),
        "avg_upload_lag_seconds", "avg_ai_lag_seconds", "avg_processing_lag_seconds", "avg_voltage",
        "health_score", "anomaly_score",
        S.status(c("health_score"), c("anomaly_score")).alias("status"),
        S.alert_reason(c("last_seen_hours_ago"), c("avg_voltage"), c("avg_processing_lag_seconds"),
                       c("ai_processed_pct")).alias("alert_reason"),
    ).orderBy(F.col("total_events").desc(), F.col("camera_name").asc())


def camera_anomalies(canon: DataFrame, as_of=None) -> DataFrame:
    """Camera anomaly table; R1 fed with ai% as json% and processing lag
    as upload lag (the specification's substitution, kept as is)."""
    r = camera_rollup(canon, as_of)
    c = F.col
    lag = c("avg_processing_lag_seconds")
    health = S.camera_health_score(c("upload_success_pct"), c("ai_processed_pct"), c("ai_processed_pct"),
                                   lag, lag, c("avg_voltage"), c("last_seen_hours_ago"))
    anomaly = S.camera_anomaly_score(c("upload_success_pct"), c("ai_processed_pct"), lag, lag,
                                     c("avg_voltage"), c("last_seen_hours_ago"))
    scored = r.select("*", health.alias("health_score"), anomaly.alias("anomaly_score"))
    return scored.select(
        "camera_name", "anomaly_score", "health_score",
        c("last_seen_hours_ago").alias("stale_hours"),
        lag.alias("avg_lag_seconds"),
        "low_voltage_rate_pct", "missing_ai_rate_pct", "suspicious_telemetry_count",
        S.status(c("health_score"), c("anomaly_score")).alias("status"),
        "total_events",
    ).orderBy(F.col("total_events").desc(), F.col("camera_name").asc())


def overview_kpis(groups: DataFrame, health: DataFrame) -> DataFrame:
    """A10: fleet KPIs over event groups plus the count of non-healthy cameras."""
    n = F.count(F.lit(1))
    alerts = health.filter(F.col("status") != F.lit("healthy")).agg(F.count(F.lit(1)))
    kpis = groups.agg(
        n.alias("total_events"),
        F.count_distinct("camera_name").alias("active_cameras"),
        _pct(F.count_if(F.col("subject_category") == "wildlife"), n).alias("wildlife_share_pct"),
        _pct(F.count_if(F.col("subject_category") == "human"), n).alias("human_share_pct"),
        _pct(F.count_if(F.col("ai_processed_any")), n).alias("ai_processed_pct"),
        _pct(F.count_if(F.col("json_processed_any")), n).alias("json_processed_pct"),
        _pct(F.count_if(F.col("uploaded_any")), n).alias("upload_success_pct"),
        F.avg("avg_upload_lag_seconds").alias("avg_upload_lag_seconds"),
        F.avg("avg_processing_lag_seconds").alias("avg_processing_lag_seconds"),
        F.avg("avg_voltage").alias("avg_voltage"),
        _pct(F.count_if(F.col("low_light_any")), n).alias("low_light_share_pct"),
    )
    return kpis.select("*", alerts.scalar().alias("cameras_with_alerts"))


def processing_funnel(groups: DataFrame) -> DataFrame:
    """Captured -> uploaded -> json -> ai, one aggregate pass + ``stack``."""
    counts = groups.agg(
        F.count(F.lit(1)).alias("captured"),
        F.count_if(F.col("uploaded_any")).alias("uploaded"),
        F.count_if(F.col("json_processed_any")).alias("json_processed"),
        F.count_if(F.col("ai_processed_any")).alias("ai_processed"),
    )
    return counts.selectExpr(
        "stack(4, 1, 'captured', captured, 2, 'uploaded', uploaded, "
        "3, 'json_processed', json_processed, 4, 'ai_processed', ai_processed) as (stage_order, stage, count)"
    ).orderBy("stage_order")


def stale_all(health: DataFrame) -> DataFrame:
    """K5 before the cut: every camera older than 48 h or not healthy."""
    return health.filter((F.coalesce(F.col("last_seen_hours_ago"), F.lit(0.0)) > K.STALE_HOURS)
                         | (F.col("status") != F.lit("healthy")))


def stale_cameras(health: DataFrame, top: int = K.STALE_CAMERAS) -> DataFrame:
    """K5: the displayed list, the first ``top`` stale cameras in health order."""
    return (stale_all(health).orderBy(F.col("total_events").desc(), F.col("camera_name").asc())
            .limit(top)
            .select("camera_name", "last_seen", "last_seen_hours_ago", "status", "anomaly_score"))


def data_quality(canon: DataFrame) -> DataFrame:
    """Twelve quality scalars in one aggregate pass."""
    n = F.count(F.lit(1))
    c = F.col
    no_text = c("analysis_summary").isNull() & c("analysis_title").isNull()
    return canon.agg(
        n.alias("total_rows"),
        _pct(F.count_if(no_text), n).alias("missing_analysis_rate_pct"),
        _pct(F.count_if(c("parse_success")), n).alias("parse_success_pct"),
        _pct(F.count_if(~no_text), n).alias("analysis_completeness_pct"),
        _pct(F.count_if(c("voltage").isNotNull()), n).alias("voltage_completeness_pct"),
        _pct(F.count_if(c("lux").isNotNull()), n).alias("lux_completeness_pct"),
        _pct(F.count_if(c("temperature").isNotNull()), n).alias("temperature_completeness_pct"),
        _pct(F.count_if(c("humidity").isNotNull()), n).alias("humidity_completeness_pct"),
        F.count_if(c("suspicious_numeric_flag")).alias("suspicious_numeric_count"),
        F.count_if(F.coalesce(c("uploaded"), F.lit(True)) == F.lit(False)).alias("upload_failures"),
        F.count_if((c("ai_processed") == F.lit(True)) & no_text).alias("ai_without_summary"),
        F.count_if((c("json_processed") == F.lit(False)) & (c("ai_processed") == F.lit(True))).alias("json_pending_after_ai"),
    )


def data_quality_items(quality: DataFrame) -> DataFrame:
    """A32 unpivoted into the three labelled lists (section, label, value)."""
    return quality.selectExpr(
        "stack(9, "
        "'field_completeness', 'analysis', analysis_completeness_pct, "
        "'field_completeness', 'voltage', voltage_completeness_pct, "
        "'field_completeness', 'lux', lux_completeness_pct, "
        "'field_completeness', 'temperature', temperature_completeness_pct, "
        "'field_completeness', 'humidity', humidity_completeness_pct, "
        "'suspicious_values', 'Suspicious numeric values', cast(suspicious_numeric_count as double), "
        "'suspicious_values', 'Upload failures', cast(upload_failures as double), "
        "'pipeline_consistency', 'AI processed without summary', cast(ai_without_summary as double), "
        "'pipeline_consistency', 'JSON pending after AI', cast(json_pending_after_ai as double)"
        ") as (section, label, value)"
    )


# ---------------------------------------------------------------- D3-D6
def reporting_recency(health: DataFrame) -> DataFrame:
    """D3: cameras seen within 24 h / 48 h, and the total."""
    h = F.col("last_seen_hours_ago")
    return health.agg(
        F.count_if(h <= 24).alias("seen_24h"),
        F.count_if(h <= 48).alias("seen_48h"),
        F.count(F.lit(1)).alias("total_cameras"),
    )


def pipeline_dropoff(funnel: DataFrame) -> DataFrame:
    """Conversion and drop between consecutive funnel stages (base 0 -> 0)."""
    wide = funnel.agg(*[F.max(F.when(F.col("stage") == s, F.col("count"))).alias(s)
                        for s in ["captured", "uploaded", "json_processed", "ai_processed"]])
    pairs = [("uploaded", "captured"), ("json_processed", "uploaded"), ("ai_processed", "json_processed")]
    items = []
    for i, (num, den) in enumerate(pairs, start=1):
        conv = F.when(F.col(den) > 0, F.lit(100.0) * F.col(num) / F.col(den)).otherwise(F.lit(0.0))
        items.append(F.struct(F.lit(i).alias("step"), F.lit(f"{den}->{num}").alias("transition"),
                              conv.alias("conversion_pct"),
                              F.when(F.col(den) > 0, F.lit(100.0) - conv).otherwise(F.lit(0.0)).alias("drop_pct")))
    return wide.select(F.inline(F.array(*items)))


def lowest_voltage_cameras(health: DataFrame) -> DataFrame:
    """Five cameras with the lowest non-null mean voltage."""
    return (health.filter(F.col("avg_voltage").isNotNull())
            .orderBy(F.col("avg_voltage").asc(), F.col("camera_name").asc())
            .limit(5).select("camera_name", "avg_voltage"))


def stale_unhealthy_count(health: DataFrame) -> DataFrame:
    """Number of cameras matching the stale-or-unhealthy predicate."""
    return health.agg(F.count_if((F.coalesce(F.col("last_seen_hours_ago"), F.lit(0.0)) > K.STALE_HOURS)
                                 | (F.col("status") != F.lit("healthy"))).alias("stale_or_unhealthy"))
