"""Dashboard and analytics-lab reports over canonical rows and event groups.

Distinct-group counts are written as two hash aggregates ((key, group) then
key) so each shuffle carries partially aggregated rows; the headline KPIs
come from one grouping-sets pass; the 95th percentile of burst sizes is taken
exactly from a per-camera size histogram rather than by buffering every
group of a camera in one task.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from .ops import _pct

MAIN = K.MAIN_CATEGORIES


def _cat_counts(cat: Column) -> list[Column]:
    out = [F.count_if(cat == F.lit(c)).alias(c) for c in MAIN]
    out.append(F.count_if(~cat.isin(*MAIN)).alias("unknown"))
    return out


def _distinct_groups(canon: DataFrame, keys: list[Column], where: Column | None = None) -> DataFrame:
    """``count(distinct event_group)`` and ``count(*)`` per key (two stages)."""
    rows = canon if where is None else canon.filter(where)
    return rows.groupBy(*keys).agg(F.count_distinct("event_group").alias("unique_event_groups"),
                                   F.count(F.lit(1)).alias("raw_rows"))


# ------------------------------------------------------------- A3 KPIs
def kpis(kgroups: DataFrame) -> DataFrame:
    """A3: thirteen headline scalars in one grouping-sets aggregate."""
    h = F.hour("first_seen")
    flagged = kgroups.select(
        "camera_name", "subject_class", "row_count",
        h.alias("hour"), F.to_date("first_seen").alias("day"),
        (F.col("subject_category") == "wildlife").alias("_w"),
        (F.col("subject_category") == "human").alias("_h"),
        (F.col("subject_category") == "vehicle").alias("_v"),
        (h.between(22, 23) | h.between(0, 5)).alias("_night"),
        (h.between(6, 11) | h.between(17, 21)).alias("_dd"),
    )
    sets = [["camera_name"], ["hour"], ["subject_class"], ["day"], []]
    rolled = flagged.groupingSets(sets, "camera_name", "hour", "subject_class", "day").agg(
        F.grouping_id().alias("gid"),
        F.count(F.lit(1)).alias("groups"),
        F.sum("row_count").alias("rows"),
        F.count_if(F.col("_w")).alias("w"), F.count_if(F.col("_h")).alias("h"),
        F.count_if(F.col("_v")).alias("v"), F.count_if(F.col("_night")).alias("night"),
        F.count_if(F.col("_dd")).alias("dd"),
    )
    gid = F.col("gid")
    cam, hour, cls, day, tot = 0b0111, 0b1011, 0b1101, 0b1110, 0b1111

    def total(c: str) -> Column:
        return F.sum(F.when(gid == tot, F.col(c)))

    def top(value: str, in_set: int, extra: Column | None = None) -> Column:
        cond = gid == in_set if extra is None else (gid == in_set) & extra
        order = F.struct(-F.col("groups"), F.col(value).isNull(), F.col(value))
        return F.min_by(F.when(cond, F.col(value)), F.when(cond, order))

    n = total("groups")
    return rolled.agg(
        F.coalesce(total("rows"), F.lit(0)).alias("total_raw_rows"),
        F.coalesce(n, F.lit(0)).alias("total_unique_event_groups"),
        _pct(total("w"), n).alias("wildlife_share_pct"),
        _pct(total("h"), n).alias("human_share_pct"),
        _pct(total("v"), n).alias("vehicle_share_pct"),
        top("camera_name", cam).alias("most_active_camera"),
        top("hour", hour).cast("int").alias("peak_activity_hour"),
        F.coalesce(F.avg(F.when(gid == day, F.col("groups"))), F.lit(0.0)).alias("avg_daily_event_groups"),
        F.coalesce(total("rows") / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("avg_burst_length"),
        F.count_if((gid == cls) & F.col("subject_class").isNotNull() & (F.col("w") > 0)).alias("biodiversity_score"),
        F.coalesce(total("night") / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("nocturnality_score"),
        F.coalesce(total("dd") / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("dawn_dusk_preference"),
        top("subject_class", cls, F.col("subject_class").isNotNull()).alias("top_species"),
    )


# ------------------------------------------------- A4-A9 (row-level time)
def daily_activity(canon: DataFrame) -> DataFrame:
    return (_distinct_groups(canon, [F.col("event_date").alias("date"), F.col("camera_name")])
            .orderBy("date", "camera_name"))


def hourly_heatmap(canon: DataFrame) -> DataFrame:
    return (_distinct_groups(canon, [F.col("camera_name"), F.col("hour")])
            .orderBy("camera_name", "hour"))


def _category_distincts(canon: DataFrame, key: Column, key_name: str) -> DataFrame:
    """Distinct groups per main category within ``key`` (two-stage, no Expand)."""
    cat4 = F.when(F.col("category").isin(*MAIN), F.col("category"))
    stage = canon.select(key.alias(key_name), cat4.alias("_c"), "event_group").distinct()
    has = F.col("event_group").isNotNull()
    return stage.groupBy(key_name).agg(
        *[F.count_if(has & (F.col("_c") == F.lit(c))).alias(c) for c in MAIN])


def time_of_day_composition(canon: DataFrame) -> DataFrame:
    out = _category_distincts(canon, F.col("time_of_day_bucket"), "bucket")
    order = F.when(F.col("bucket") == "morning", 1).when(F.col("bucket") == "afternoon", 2) \
        .when(F.col("bucket") == "evening", 3).otherwise(4)
    return out.orderBy(order, "bucket")


def subject_by_camera(canon: DataFrame) -> DataFrame:
    return (canon.filter(F.col("subject_class").isNotNull())
            .groupBy("camera_name", "subject_class")
            .agg(F.count_distinct("event_group").alias("unique_event_groups"))
            .orderBy("camera_name", "subject_class"))


def monthly_activity(canon: DataFrame) -> DataFrame:
    month = F.date_format(F.col("local_timestamp"), K.MONTH_FORMAT)
    return _category_distincts(canon, month, "month").orderBy("month")


def composition(canon: DataFrame) -> DataFrame:
    return (canon.groupBy(F.col("subject_category").alias("category"))
            .agg(F.count_distinct("event_group").alias("unique_event_groups"))
            .orderBy(F.col("unique_event_groups").desc(), "category"))


# ------------------------------------------------- A13-A21 (overview)
def lag_trend(canon: DataFrame) -> DataFrame:
    return (canon.groupBy(F.col("event_date").alias("date"))
            .agg(F.avg("upload_lag_seconds").alias("avg_upload_lag_seconds"),
                 F.avg("ai_lag_seconds").alias("avg_ai_lag_seconds"),
                 F.avg("processing_lag_seconds").alias("avg_processing_lag_seconds"))
            .orderBy("date"))


def category_distribution(groups: DataFrame) -> DataFrame:
    return (groups.groupBy(F.col("subject_category").alias("category"))
            .agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), "category"))


def category_trend(groups: DataFrame) -> DataFrame:
    """A15 (also the lab's daily seasonality)."""
    return (groups.groupBy(F.to_date("first_seen").alias("date"))
            .agg(*_cat_counts(F.col("subject_category")))
            .orderBy("date"))


def top_cameras(groups: DataFrame) -> DataFrame:
    return (groups.groupBy("camera_name").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), F.col("camera_name").asc())
            .limit(K.TOP_CAMERAS))


def hourly_activity(groups: DataFrame) -> DataFrame:
    return (groups.groupBy(F.hour("first_seen").alias("hour"))
            .agg(F.count(F.lit(1)).alias("total"), *_cat_counts(F.col("subject_category")))
            .orderBy("hour"))


def burst_distribution(groups: DataFrame) -> DataFrame:
    return (groups.groupBy(F.least(F.col("event_group_size"), F.lit(K.BURST_CAP)).alias("burst_size"))
            .agg(F.count(F.lit(1)).alias("count")).orderBy("burst_size"))


def voltage_trend(canon: DataFrame) -> DataFrame:
    return (canon.filter(F.col("voltage").isNotNull())
            .groupBy(F.col("event_date").alias("date"), "camera_name")
            .agg(F.avg("voltage").alias("avg_voltage")).orderBy("date", "camera_name"))


def light_split(groups: DataFrame) -> DataFrame:
    bucket = F.when(F.col("low_light_any"), F.lit("low_light")).otherwise(F.lit("normal_light"))
    return groups.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("count")).orderBy("bucket")


def temperature_trend(canon: DataFrame) -> DataFrame:
    return (canon.groupBy(F.col("event_date").alias("date"))
            .agg(F.avg("temperature").alias("avg_temperature"), F.avg("heat_level").alias("avg_heat_level"))
            .orderBy("date"))


# ------------------------------------------------- A22-A29 (lab tables)
def hour_category_heatmap(groups: DataFrame) -> DataFrame:
    return (groups.groupBy(F.hour("first_seen").alias("row"), F.col("subject_category").alias("column"))
            .agg(F.count(F.lit(1)).alias("count")).orderBy("row", "column"))


def camera_category_heatmap(groups: DataFrame) -> DataFrame:
    return (groups.groupBy(F.col("camera_name").alias("row"), F.col("subject_category").alias("column"))
            .agg(F.count(F.lit(1)).alias("count")).orderBy("row", "column"))


def burst_behavior(groups: DataFrame, p: float = 0.95) -> DataFrame:
    """Mean burst size (2 places), exact continuous 95th percentile, count.

    The percentile is read off the (camera, size) histogram: with N sizes in
    order, position h = (N-1)p lies between ranks floor(h) and ceil(h), whose
    values are found from cumulative counts, then interpolated linearly.
    """
    hist = groups.groupBy("camera_name", F.col("event_group_size").alias("size")) \
        .agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("camera_name").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.select("*", F.sum("c").over(w).alias("cum"),
                       F.sum("c").over(Window.partitionBy("camera_name")).alias("n"))
    pos = (F.col("n") - 1) * F.lit(p)
    lo, hi = F.floor(pos), F.ceil(pos)
    prev = F.col("cum") - F.col("c")
    per = hist.groupBy("camera_name").agg(
        F.first("n").alias("n"),
        F.sum(F.col("size") * F.col("c")).alias("total"),
        F.max(F.when((prev <= lo) & (lo < F.col("cum")), F.col("size"))).alias("v_lo"),
        F.max(F.when((prev <= hi) & (hi < F.col("cum")), F.col("size"))).alias("v_hi"),
        F.first(pos).alias("pos"),
    )
    frac = F.col("pos") - F.floor(F.col("pos"))
    # mean rounded half-up at 2 places, exactly: floor((200 * total + n) / (2 n)) / 100
    mean2 = F.floor((F.col("total") * 200 + F.col("n")) / (F.col("n") * 2)) / F.lit(100.0)
    return per.select(
        "camera_name",
        mean2.alias("avg_burst_size"),
        (F.col("v_lo") + frac * (F.col("v_hi") - F.col("v_lo"))).cast("double").alias("p95_burst_size"),
        F.col("n").alias("event_count"),
    ).orderBy(F.col("event_count").desc(), "camera_name")


def camera_daily(groups: DataFrame) -> DataFrame:
    return (groups.groupBy(F.to_date("first_seen").alias("date"), "camera_name")
            .agg(F.count(F.lit(1)).alias("count")))


def combo_daily(groups: DataFrame) -> DataFrame:
    return (groups.groupBy(F.to_date("first_seen").alias("date"), "camera_name",
                           F.col("subject_category").alias("category"), F.hour("first_seen").alias("hour"))
            .agg(F.count(F.lit(1)).alias("count")))


def diversity_by_camera(groups: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return (groups.groupBy("camera_name").agg(
        F.count_distinct("subject_class").alias("diversity_score"),
        _pct(F.count_if(F.col("subject_category") == "wildlife"), n).alias("wildlife_ratio_pct"),
        _pct(F.count_if(F.col("subject_category") == "human"), n).alias("human_ratio_pct"),
        _pct(F.count_if(F.col("low_light_any")), n).alias("low_light_share_pct"),
        F.avg("avg_voltage").alias("avg_voltage"),
        n.alias("total_events"),
    ).orderBy(F.col("total_events").desc(), "camera_name"))


def category_ratio_by_camera(groups: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return (groups.groupBy("camera_name").agg(
        *[_pct(F.count_if(F.col("subject_category") == c), n).alias(f"{c}_pct") for c in ["wildlife", "human", "vehicle"]]
    ).orderBy("camera_name"))


def environmental_context(canon: DataFrame) -> DataFrame:
    return (canon.groupBy(F.col("subject_category").alias("category"))
            .agg(F.avg("lux").alias("avg_lux"), F.avg("temperature").alias("avg_temperature"),
                 F.avg("heat_level").alias("avg_heat_level")).orderBy("category"))


# ------------------------------------------------- A33 filter options
def filter_option_values(canon: DataFrame, devices: DataFrame) -> DataFrame:
    """A33 lists as one long table (kind, value, label)."""
    cams = devices.select(F.lit("camera").alias("kind"), F.col("camera_name").alias("value"),
                          F.col("camera_name").alias("label")).distinct()
    macs = devices.select(F.lit("mac").alias("kind"), F.col("mac").alias("value"),
                          F.concat(F.col("camera_name"), F.lit(" ("), F.col("mac"), F.lit(")")).alias("label"))
    vals = []
    for kind, c in [("time_of_day_bucket", "time_of_day_bucket"), ("subject_category", "category"),
                    ("subject_class", "subject_class")]:
        vals.append(canon.filter(F.col(c).isNotNull()).select(F.lit(kind).alias("kind"), F.col(c).alias("value"),
                                                              F.col(c).alias("label")).distinct())
    out = cams.unionByName(macs)
    for v in vals:
        out = out.unionByName(v)
    return out.orderBy("kind", "value")


def filter_option_ranges(canon: DataFrame) -> DataFrame:
    """A33 slider bounds; a column without values has the bounds 0 and 0."""
    bounds = {
        "min_lux": F.min("raw_lux"), "max_lux": F.max("raw_lux"),
        "min_temperature": F.floor(F.min("raw_temperature")), "max_temperature": F.ceil(F.max("raw_temperature")),
        "min_heat_level": F.min("heat_level"), "max_heat_level": F.max("heat_level"),
    }
    return canon.agg(*[F.coalesce(c.cast("int"), F.lit(0)).alias(name) for name, c in bounds.items()])


# ------------------------------------------------- A34/A35 day drill-down
def on_day(canon: DataFrame, day: str) -> DataFrame:
    d = dt.date.fromisoformat(day)
    return canon.filter(F.col("event_date") == F.lit(d))


def day_totals(day_rows: DataFrame) -> DataFrame:
    return day_rows.agg(F.count_distinct("event_group").alias("total_event_groups"),
                        F.count(F.lit(1)).alias("total_raw_rows"))


def day_hourly(day_rows: DataFrame) -> DataFrame:
    return _distinct_groups(day_rows, [F.col("hour")]).orderBy("hour")


def day_classes(day_rows: DataFrame) -> DataFrame:
    return (day_rows.filter(F.col("subject_class").isNotNull()).groupBy("subject_class")
            .agg(F.count_distinct("event_group").alias("unique_event_groups"))
            .orderBy(F.col("unique_event_groups").desc(), "subject_class"))


def day_cameras(day_rows: DataFrame) -> DataFrame:
    return (day_rows.groupBy("camera_name").agg(F.count_distinct("event_group").alias("unique_event_groups"))
            .orderBy(F.col("unique_event_groups").desc(), "camera_name"))


def count_events(canon: DataFrame) -> DataFrame:
    return canon.agg(F.count(F.lit(1)).alias("total"))
