"""Event explorer: filtered, sorted, paged event records and the row mapping.

Pages and top-k lists are cut first (a bounded ``TakeOrderedAndProject``) and
held as one array of at most ``page_size`` rows, a scalar subquery that runs
once per query; the burst size of each listed row is then counted only for the
groups in that array, instead of a window over every filtered row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import normalize as N
from ..functions import scoring as S
from . import canonical as C
from .filters import SORT_KEYS, EventQuery


def _sized(top: DataFrame, rows: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Burst sizes for a cut list of bounded length (a page or a top-k list):
    counted over ``rows``, or read from ``sizes`` (event_group,
    event_group_size) where those of all events are at hand."""
    row = F.struct(*[F.col(f"`{c}`") for c in top.columns])
    page = top.agg(F.struct(F.collect_list(row).alias("rows"), F.collect_set("event_group").alias("keys"))).scalar()
    listed = F.array_contains(page.getField("keys"), F.col("event_group")) | F.col("event_group").isNull()
    sizes = (C.group_sizes(rows.filter(listed)) if sizes is None else sizes.filter(listed)).withColumnRenamed("event_group", "_g")
    cut = rows.sparkSession.range(1).select(F.inline(page.getField("rows")))
    return cut.join(sizes, F.col("event_group").eqNullSafe(F.col("_g")), "left").drop("_g")


def _pg_order(col: str, direction: str) -> Column:
    """Sort with PostgreSQL's null placement: asc -> nulls last, desc -> nulls first."""
    c = F.col(col)
    return c.asc_nulls_last() if direction == "asc" else c.desc_nulls_first()


def _text(c: str) -> Column:
    return N.blank_to_null(F.col(c))


def event_records(rows: DataFrame, category: str = "category") -> DataFrame:
    """R6 (+R2-R5): the per-row record shown by the explorer and lists.

    ``rows`` carries canonical columns and ``event_group_size``; ``category``
    names the category column to show (un-defaulted for explorer pages, the
    defaulted one for lists built from ``base``).
    """
    c = F.col
    health = S.event_health_score(c("uploaded"), c("ai_processed"), c("json_processed"), c("upload_lag_seconds"),
                                  c("processing_lag_seconds"), c("voltage"), c("battery_percentage"))
    anomaly = S.event_anomaly_score(c("uploaded"), c("ai_processed"), c("json_processed"), c("upload_lag_seconds"),
                                    c("processing_lag_seconds"), c("ai_lag_seconds"), c("voltage"),
                                    c("battery_percentage"), c("low_light_flag"), c("analysis_summary"))
    flags = S.quality_flags(c("analysis_summary"), c("analysis_title"), c("ai_processed"), c("json_processed"),
                            c("uploaded"), c("voltage"), c("battery_percentage"), c("lux"), c("temperature"),
                            c("humidity"), c("pressure"))
    scored = rows.select("*", health.alias("health_score"), anomaly.alias("anomaly_score"),
                         flags.alias("data_quality_flags"))
    return scored.select(
        "id",
        N.iso_seconds(c("local_timestamp")).alias("timestamp"),
        N.iso_seconds(c("utc_timestamp")).alias("utc_timestamp"),
        N.iso_seconds(c("utc_timestamp_off")).alias("utc_timestamp_off"),
        N.iso_seconds(c("created")).alias("created"),
        N.iso_seconds(c("ai_timestamp")).alias("ai_timestamp"),
        N.iso_seconds(c("json_timestamp")).alias("json_timestamp"),
        F.coalesce(_text("timezone"), F.lit(K.DEFAULT_TIMEZONE)).alias("timezone"),
        "camera_name", "mac", "event_group", "sequence", "subject_class",
        c(category).alias("subject_category"), "time_of_day_bucket", "daypart",
        "analysis_title", "analysis_summary", "analysis", "ai_description",
        F.coalesce(c("analysis_summary"), c("analysis_title"), F.lit(K.UNPROCESSED_SUMMARY)).alias("summary"),
        "lux", "temperature", "humidity", "pressure", "heat_level",
        F.coalesce(_text("sensor"), F.lit(K.UNKNOWN_SENSOR)).alias("sensor"),
        _text("location").alias("location"), "latitude", "longitude", "bearing", "battery_percentage",
        _text("filename").alias("filename"), _text("file_type").alias("file_type"),
        _text("image_blob_url").alias("image_blob_url"),
        "ai_processed", "json_processed", "uploaded", _text("upload").alias("upload"), "voltage",
        _text("tag").alias("tag"),
        F.coalesce(c("event_group_size"), F.lit(1)).alias("event_group_size"),
        "upload_lag_seconds", "ai_lag_seconds", "processing_lag_seconds", "low_light_flag",
        S.status(c("health_score"), c("anomaly_score"), c("uploaded")).alias("operational_status"),
        (c("anomaly_score") >= K.ANOMALY_FLAG).alias("anomaly_flag"),
        "anomaly_score", "health_score", "data_quality_flags",
    )


def events_page(canon: DataFrame, query: EventQuery, sizes: DataFrame | None = None) -> DataFrame:
    """K1: one page of filtered events, sorted by the chosen key then id.
    ``sizes``: burst sizes of all events, for a query without filters."""
    rows = canon.filter(query.predicate())
    order = [_pg_order(SORT_KEYS[query.sort_by], query.sort_dir), F.col("id").asc()]
    page = rows.orderBy(*order).offset((query.page - 1) * query.page_size).limit(query.page_size)
    return event_records(_sized(page, rows, sizes), "category")


def events_page_after(canon: DataFrame, query: EventQuery, after_value=None, after_id: str | None = None) -> DataFrame:
    """K1 for deep pages (keyset / seek pagination).

    ``offset`` paging makes every task keep ``offset + page_size`` rows; here
    the page starts right after the last row of the previous page, given by
    its sort value and id, so each task keeps at most ``page_size`` rows
    however deep the page is.  ``after_value=None`` with ``after_id`` set
    means the previous row had a null sort value.
    """
    key = SORT_KEYS[query.sort_by]
    rows = canon.filter(query.predicate())
    if after_id is not None:
        k, i = F.col(key), F.col("id")
        asc = query.sort_dir == "asc"
        if after_value is None:
            # nulls sort last ascending (nothing non-null follows) and first descending
            after = (k.isNull() & (i > after_id)) if asc else (k.isNotNull() | (k.isNull() & (i > after_id)))
        else:
            v = N.literal(after_value)
            beyond = (k > v) if asc else (k < v)
            after = beyond | ((k == v) & (i > after_id))
            if asc:
                after = after | k.isNull()
        rows_after = rows.filter(after)
    else:
        rows_after = rows
    order = [_pg_order(key, query.sort_dir), F.col("id").asc()]
    page = rows_after.orderBy(*order).limit(query.page_size)
    return event_records(_sized(page, rows), "category")


def notable_events(canon: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """K2: upload failures, then low voltage, then longest processing lag, newest."""
    c = F.col
    order = [
        F.when(c("uploaded") == F.lit(False), 0).otherwise(1).asc(),
        F.when(c("voltage").isNotNull() & (c("voltage") < K.LOW_VOLTAGE), 0).otherwise(1).asc(),
        c("processing_lag_seconds").desc_nulls_last(),
        c("local_timestamp").desc_nulls_first(),
        c("id").asc(),
    ]
    top = canon.orderBy(*order).limit(K.NOTABLE_EVENTS)
    return event_records(_sized(top, canon, sizes), "subject_category")


def day_events(day_rows: DataFrame) -> DataFrame:
    """The 50 newest events of one day (id breaks ties)."""
    top = day_rows.orderBy(F.col("local_timestamp").desc_nulls_first(), F.col("id").asc()).limit(K.DAY_EVENTS)
    return event_records(_sized(top, day_rows), "category")


def event_group_size(canon: DataFrame) -> DataFrame:
    """W1 on every row: id, group and the group's row count."""
    return C.with_group_size_full(canon.select("id", "event_group")).select("id", "event_group", "event_group_size")


def events_csv_frame(canon: DataFrame, query: EventQuery) -> DataFrame:
    """S8 rows: all filtered rows, sorted, the 14 export columns."""
    rows = canon.filter(query.predicate())
    order = [_pg_order(SORT_KEYS[query.sort_by], query.sort_dir), F.col("id").asc()]
    no_commas = lambda c: F.replace(F.coalesce(F.col(c), F.lit("")), F.lit(","), F.lit(" "))
    return rows.orderBy(*order).select(
        F.date_format("local_timestamp", K.CSV_SECONDS).alias("timestamp"),
        "camera_name", "mac", F.col("event_group").alias("event"), "sequence", "subject_class",
        F.col("category").alias("subject_category"), "time_of_day_bucket",
        no_commas("analysis_title").alias("analysis_title"),
        no_commas("analysis_summary").alias("analysis_summary"),
        F.col("raw_lux").alias("lux"), F.col("raw_temperature").alias("temperature"), "heat_level", "sensor",
    )
