"""Canonical event table (``base``) and burst roll-up (``event_groups``).

``canonical`` is one narrow projection over the raw fact (no shuffle).  The
subject signal is materialised as its own column first, then the class, then
the category, so the ~40 substring tests are evaluated once per row instead of
being re-expanded inside the category rule.

``event_groups`` is a single hash aggregate keyed by the event group; partial
(map-side) aggregation collapses even a group holding a large share of all
rows before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import normalize as N

# Output columns of ``base`` (event_group_size is added by ``with_group_size_full``).
BASE_COLUMNS = [
    "id", "camera_name", "name", "mac", "event_group", "sequence", "local_timestamp",
    "utc_timestamp", "utc_timestamp_off", "created", "ai_timestamp", "json_timestamp", "timezone",
    "subject_class", "subject_category", "time_of_day_bucket", "analysis_title", "analysis_summary",
    "analysis", "ai_description", "ai_processed", "json_processed", "uploaded", "upload", "lux",
    "temperature", "humidity", "pressure", "heat_level", "voltage", "battery_percentage",
    "raw_battery_percentage", "latitude", "longitude", "bearing", "file_type", "filename",
    "image_blob_url", "sensor", "location", "tag", "upload_lag_seconds", "ai_lag_seconds",
    "processing_lag_seconds", "low_light_flag", "daypart", "parse_success", "suspicious_numeric_flag",
]

# Extra canonical columns kept for filters, sorts and reports that use the
# un-defaulted category or raw telemetry (pruned away when unused).
EXTRA_COLUMNS = ["category", "raw_lux", "raw_temperature", "event_date", "hour"]


def canonical(raw: DataFrame) -> DataFrame:
    """Raw camera events -> every canonical column (one projection)."""
    ts = N.local_timestamp()
    step1 = raw.select(
        "*",
        N.analysis_fields(N.analysis_json()).alias("_doc"),
        ts.alias("_ts"),
    )
    doc = F.col("_doc")
    step2 = step1.select("*", N.subject_signal(doc).alias("_signal"))
    step3 = step2.select("*", N.subject_class(F.col("_signal")).alias("_class"))
    t = F.col("_ts")
    nlux = N.lux()
    category = N.subject_category(F.col("_class"), F.col("_signal"))
    return step3.select(
        N.col("id").alias("id"),
        N.camera_name().alias("camera_name"),
        N.col("name").alias("name"),
        N.col("mac").alias("mac"),
        N.event_group().alias("event_group"),
        N.col("sequence").alias("sequence"),
        t.alias("local_timestamp"),
        N.col("utc_timestamp").alias("utc_timestamp"),
        N.col("utc_timestamp_off").alias("utc_timestamp_off"),
        N.col("created").alias("created"),
        N.col("ai_timestamp").alias("ai_timestamp"),
        N.col("json_timestamp").alias("json_timestamp"),
        N.timezone().alias("timezone"),
        F.col("_class").alias("subject_class"),
        F.coalesce(category, F.lit(K.UNKNOWN_CATEGORY)).alias("subject_category"),
        N.time_bucket(t).alias("time_of_day_bucket"),
        N.analysis_title(doc).alias("analysis_title"),
        N.analysis_summary(doc).alias("analysis_summary"),
        N.col("analysis").alias("analysis"),
        N.col("ai_description").alias("ai_description"),
        N.col("ai_processed").alias("ai_processed"),
        N.col("json_processed").alias("json_processed"),
        N.col("uploaded").alias("uploaded"),
        N.upload_text().alias("upload"),
        nlux.alias("lux"),
        N.temperature().alias("temperature"),
        N.humidity().alias("humidity"),
        N.pressure().alias("pressure"),
        N.heat_level().alias("heat_level"),
        N.voltage().alias("voltage"),
        N.battery().alias("battery_percentage"),
        N.raw_battery().alias("raw_battery_percentage"),
        N.latitude().alias("latitude"),
        N.longitude().alias("longitude"),
        N.bearing().alias("bearing"),
        N.file_type().alias("file_type"),
        N.col("filename").alias("filename"),
        N.col("image_blob_url").alias("image_blob_url"),
        N.col("sensor").alias("sensor"),
        N.col("location").alias("location"),
        N.col("tag").alias("tag"),
        N.upload_lag(t).alias("upload_lag_seconds"),
        N.ai_lag(t).alias("ai_lag_seconds"),
        N.processing_lag(t).alias("processing_lag_seconds"),
        N.low_light(nlux).alias("low_light_flag"),
        N.daypart(t).alias("daypart"),
        N.parse_success().alias("parse_success"),
        N.suspicious_numeric().alias("suspicious_numeric_flag"),
        category.alias("category"),
        N.col("lux").alias("raw_lux"),
        N.col("temperature").alias("raw_temperature"),
        F.to_date(t).alias("event_date"),
        F.hour(t).alias("hour"),
    )


def base(raw: DataFrame, filters=None) -> DataFrame:
    """Filtered canonical events (the ``filtered`` -> ``base`` CTE chain)."""
    canon = canonical(raw)
    if filters is not None:
        canon = canon.filter(filters.predicate())
    return canon


def group_sizes(canon: DataFrame) -> DataFrame:
    """``count(*) over (partition by event_group)`` as an aggregate.

    A grouped count uses map-side partial aggregation, so a hot group costs one
    row per map task in the shuffle instead of routing all its rows to one
    window task.
    """
    return canon.groupBy("event_group").agg(F.count(F.lit(1)).cast("int").alias("event_group_size"))


def with_group_size_full(canon: DataFrame) -> DataFrame:
    """Burst size on every row (unbounded input: shuffle join, AQE splits skew)."""
    sizes = group_sizes(canon).withColumnRenamed("event_group", "_g")
    return canon.join(sizes, canon["event_group"].eqNullSafe(sizes["_g"]), "left").drop("_g")


def event_groups(canon: DataFrame) -> DataFrame:
    """A2: one row per event group over the (filtered) canonical rows."""
    def any_true(c: str) -> Column:
        return F.bool_or(F.coalesce(F.col(c), F.lit(False)))

    return canon.groupBy("event_group").agg(
        F.min("camera_name").alias("camera_name"),
        F.min("mac").alias("mac"),
        F.min("local_timestamp").alias("first_seen"),
        F.max("local_timestamp").alias("last_seen"),
        F.min("subject_category").alias("subject_category"),
        F.min("subject_class").alias("subject_class"),
        F.count(F.lit(1)).cast("int").alias("event_group_size"),
        F.avg("upload_lag_seconds").alias("avg_upload_lag_seconds"),
        F.avg("ai_lag_seconds").alias("avg_ai_lag_seconds"),
        F.avg("processing_lag_seconds").alias("avg_processing_lag_seconds"),
        F.avg("voltage").alias("avg_voltage"),
        F.avg("temperature").alias("avg_temperature"),
        F.avg("heat_level").alias("avg_heat_level"),
        F.avg("lux").alias("avg_lux"),
        any_true("ai_processed").alias("ai_processed_any"),
        any_true("json_processed").alias("json_processed_any"),
        any_true("uploaded").alias("uploaded_any"),
        any_true("low_light_flag").alias("low_light_any"),
        F.count_if(F.col("suspicious_numeric_flag")).cast("int").alias("suspicious_numeric_count"),
    )


def kpi_groups(canon: DataFrame) -> DataFrame:
    """Groups for the headline KPIs: category *without* the 'unknown' default (Q1)."""
    return canon.groupBy("event_group").agg(
        F.min("camera_name").alias("camera_name"),
        F.min("category").alias("subject_category"),
        F.min("subject_class").alias("subject_class"),
        F.min("local_timestamp").alias("first_seen"),
        F.count(F.lit(1)).alias("row_count"),
    )
