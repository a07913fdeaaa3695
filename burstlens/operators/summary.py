"""Daily camera summary (A1, rebuilt by S7) and post-load checks.

Both read the raw stored columns, not the canonical ones, as the rebuild job
does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K


def _mean2_int(c: str) -> Column:
    """Mean of an integer column rounded half up at 2 places, exactly."""
    s, n = F.sum(c), F.count(c)
    return F.when(n > 0, F.floor((s * 200 + n) / (n * 2)) / F.lit(100.0))


def round2_numeric(x: Column) -> Column:
    """``round(x::numeric, 2)``: snap float noise at 10 places, then round half
    away from zero in decimal arithmetic (ties do not depend on summation order)."""
    return F.round(F.round(x, 10).cast("decimal(38,10)"), 2).cast("double")


def daily_camera_summary(raw: DataFrame) -> DataFrame:
    """A1: per (date(timestamp), mac, camera_name) counts and rounded means."""
    c = F.col
    return raw.groupBy(F.to_date(c("`timestamp`")).alias("date"), "mac", "camera_name").agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_distinct("event").alias("unique_event_groups"),
        *[F.count_if(c("subject_category") == v).alias(f"{v}_rows") for v in K.MAIN_CATEGORIES],
        *[F.count_if(c("time_of_day_bucket") == v).alias(f"{v}_rows") for v in K.BUCKET_ORDER],
        round2_numeric(F.avg("temperature")).alias("avg_temperature"),
        _mean2_int("lux").alias("avg_lux"),
        _mean2_int("heat_level").alias("avg_heat_level"),
        round2_numeric(F.avg("battery_percentage")).alias("avg_battery_percentage"),
    )


def seed_totals(raw: DataFrame) -> DataFrame:
    return raw.agg(F.count(F.lit(1)).alias("total_rows"), F.count_distinct("event").alias("total_event_groups"))


def seed_by_camera(raw: DataFrame) -> DataFrame:
    return raw.groupBy("camera_name").agg(F.count(F.lit(1)).alias("rows")).orderBy("camera_name")


def seed_by_bucket(raw: DataFrame) -> DataFrame:
    b = F.col("time_of_day_bucket")
    order = F.when(b == "morning", 1).when(b == "afternoon", 2).when(b == "evening", 3) \
        .when(b == "night", 4).otherwise(5)
    return (raw.groupBy(b.alias("time_of_day_bucket")).agg(F.count(F.lit(1)).alias("rows"))
            .select("time_of_day_bucket", "rows", order.alias("bucket_order")).orderBy("bucket_order"))


def events_devices(events: DataFrame, devices: DataFrame) -> DataFrame:
    """Events with their device attributes (dimension joined on mac).

    No broadcast hint: the planner broadcasts the device table only while its
    size estimate stays under the broadcast threshold, else it shuffles.
    """
    d = devices.select("mac", F.col("camera_name").alias("device_camera_name"), "location_name",
                       "location_code", "camera_profile")
    return events.select("id", "mac", "camera_name", "event_group").join(d, "mac")


def summary_devices(summary: DataFrame, devices: DataFrame) -> DataFrame:
    """Daily summary rows with device attributes."""
    d = devices.select("mac", F.col("camera_name").alias("device_camera_name"), "location_name", "location_code")
    return summary.join(d, "mac")
