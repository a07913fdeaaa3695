"""The overview and analytics-lab bundles.

Each bundle is a dictionary of report DataFrames over one filtered slice.
The slice's event groups and camera roll-up feed most reports, so they are
persisted once (memory, spilling to disk; lost blocks are recomputed from
lineage) instead of being re-aggregated by every report.  Call ``release``
when the bundle is no longer needed.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from ..operators import canonical as C
from ..operators import explorer as X
from ..operators import lab as L
from ..operators import ops
from ..operators import reports as R


def overview(canon: DataFrame, as_of=None) -> dict[str, DataFrame]:
    groups = C.event_groups(canon).persist(StorageLevel.MEMORY_AND_DISK)
    health = ops.camera_health(canon, as_of).persist(StorageLevel.MEMORY_AND_DISK)
    kpis = ops.overview_kpis(groups, health)
    top = R.top_cameras(groups)
    stale = ops.stale_cameras(health)
    out = {
        "kpis": kpis, "camera_health": health, "processing_funnel": ops.processing_funnel(groups),
        "lag_trend": R.lag_trend(canon), "stale_cameras": stale,
        "category_distribution": R.category_distribution(groups), "category_trend": R.category_trend(groups),
        "top_cameras": top, "hourly_activity": R.hourly_activity(groups),
        "burst_distribution": R.burst_distribution(groups), "notable_events": X.notable_events(canon),
        "voltage_trend": R.voltage_trend(canon), "light_split": R.light_split(groups),
        "temperature_trend": R.temperature_trend(canon),
        "insights": L.overview_insights(health, kpis, top, ops.stale_all(health)),
    }
    out["_persisted"] = [groups, health]  # type: ignore[assignment]
    return out


def analytics_lab(canon: DataFrame, as_of=None) -> dict[str, DataFrame]:
    groups = C.event_groups(canon).persist(StorageLevel.MEMORY_AND_DISK)
    combo = L.with_totals(R.combo_daily(groups)).persist(StorageLevel.MEMORY_AND_DISK)
    cam_daily = R.camera_daily(groups)
    fc = L.camera_forecast(cam_daily)
    leaders = L.camera_forecast_leaders(fc)
    shifts = L.category_shift_all(combo)
    novel = L.novel_patterns(combo, shifts=shifts)
    anomalies = ops.camera_anomalies(canon, as_of)
    diversity = R.diversity_by_camera(groups)
    out = {
        "hour_category_heatmap": R.hour_category_heatmap(groups),
        "camera_category_heatmap": R.camera_category_heatmap(groups),
        "daily_seasonality": R.category_trend(groups), "burst_behavior": R.burst_behavior(groups),
        "diversity_by_camera": diversity, "category_ratio_by_camera": R.category_ratio_by_camera(groups),
        "environmental_context": R.environmental_context(canon), "camera_anomalies": anomalies,
        "anomaly_timeline": L.anomaly_timeline(canon, L.novelty_by_date(combo, novel)),
        "forecast": L.forecast(R.category_trend(groups)), "camera_forecast": fc.drop("i"),
        "camera_forecast_leaders": leaders, "novel_events": L.novel_events(novel),
        "novelty_timeline": L.novelty_timeline(combo), "category_shift_matrix": L.category_shift_matrix(combo),
        "advanced_insights": L.advanced_insights(leaders, novel, shifts),
        "camera_clusters": L.camera_clusters(diversity, anomalies),
        "data_quality": ops.data_quality(canon),
    }
    out["_persisted"] = [groups, combo]  # type: ignore[assignment]
    return out


def release(bundle: dict) -> None:
    for df in bundle.pop("_persisted", []):
        df.unpersist()
