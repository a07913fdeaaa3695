"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per key.

Every query reads the driver's tables (through the staged raw and canonical
tables derived from them) and runs over the whole table.  ``as_of`` replaces the wall clock where the specification calls
``now()``; filter keys use dates inside the test data's range.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import canonical as C
from ..operators import gold as G
from ..operators import ops
from ..sources import adapter, staging
from .shape import finish

AS_OF = "2024-02-01T00:00:00"
AS_OF_LATE = "2024-02-03T00:00:00"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def canon(spark: SparkSession, sf_dir: str, filters=None) -> DataFrame:
    """Canonical events of ``sf_dir`` (staged table), optionally filtered."""
    df = staging.canonical_table(spark, sf_dir)
    return df if filters is None else df.filter(filters.predicate())


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loaded raw events table of ``sf_dir``."""
    return staging.raw_table(spark, sf_dir)


def groups(spark: SparkSession, sf_dir: str, filters=None) -> DataFrame:
    """Event groups: of all events from the gold states, of a slice from its events."""
    if filters is None:
        return G.event_groups(staging.groups_table(spark, sf_dir))
    return C.event_groups(canon(spark, sf_dir, filters))


# ------------------------------------------------------------------ ops
@register("event_groups")
def q_event_groups(spark, d):
    return finish(groups(spark, d))


@register("camera_health")
def q_camera_health(spark, d):
    return finish(ops.camera_health(canon(spark, d), AS_OF))


@register("camera_health_late")
def q_camera_health_late(spark, d):
    return finish(ops.camera_health(canon(spark, d), AS_OF_LATE))


@register("overview_kpis")
def q_overview_kpis(spark, d):
    c = canon(spark, d)
    return finish(ops.overview_kpis(groups(spark, d), ops.camera_health(c, AS_OF)))


@register("processing_funnel")
def q_processing_funnel(spark, d):
    return finish(ops.processing_funnel(groups(spark, d)))


@register("stale_cameras")
def q_stale_cameras(spark, d):
    return finish(ops.stale_cameras(ops.camera_health(canon(spark, d), AS_OF_LATE)))


@register("camera_anomalies")
def q_camera_anomalies(spark, d):
    return finish(ops.camera_anomalies(canon(spark, d), AS_OF))


@register("data_quality")
def q_data_quality(spark, d):
    return finish(ops.data_quality(canon(spark, d)))


@register("data_quality_items")
def q_data_quality_items(spark, d):
    return finish(ops.data_quality_items(ops.data_quality(canon(spark, d))))


@register("reporting_recency")
def q_reporting_recency(spark, d):
    return finish(ops.reporting_recency(ops.camera_health(canon(spark, d), AS_OF)))


@register("pipeline_dropoff")
def q_pipeline_dropoff(spark, d):
    return finish(ops.pipeline_dropoff(ops.processing_funnel(groups(spark, d))))


@register("lowest_voltage_cameras")
def q_lowest_voltage(spark, d):
    return finish(ops.lowest_voltage_cameras(ops.camera_health(canon(spark, d), AS_OF)))


@register("stale_unhealthy_count")
def q_stale_unhealthy(spark, d):
    return finish(ops.stale_unhealthy_count(ops.camera_health(canon(spark, d), AS_OF)))


# -------------------------------------------------------------- reports
from ..operators import reports as R  # noqa: E402

DAY = "2024-01-15"


def _g(spark, d):
    return groups(spark, d)


@register("kpis")
def q_kpis(spark, d):
    return finish(R.kpis(G.kpi_groups(staging.groups_table(spark, d))))


for _name, _fn, _src, _dbl in [
    ("daily_activity", R.daily_activity, "canon", ()),
    ("hourly_heatmap", R.hourly_heatmap, "canon", ("hour",)),
    ("time_of_day_composition", R.time_of_day_composition, "canon", ()),
    ("subject_by_camera", R.subject_by_camera, "canon", ()),
    ("monthly_activity", R.monthly_activity, "canon", ()),
    ("composition", R.composition, "canon", ()),
    ("lag_trend", R.lag_trend, "canon", ()),
    ("category_distribution", R.category_distribution, "groups", ()),
    ("category_trend", R.category_trend, "groups", ()),
    ("top_cameras", R.top_cameras, "groups", ()),
    ("hourly_activity", R.hourly_activity, "groups", ("hour",)),
    ("burst_distribution", R.burst_distribution, "groups", ()),
    ("voltage_trend", R.voltage_trend, "canon", ()),
    ("light_split", R.light_split, "groups", ()),
    ("temperature_trend", R.temperature_trend, "canon", ()),
    ("hour_category_heatmap", R.hour_category_heatmap, "groups", ("row",)),
    ("camera_category_heatmap", R.camera_category_heatmap, "groups", ()),
    ("burst_behavior", R.burst_behavior, "groups", ()),
    ("camera_daily", R.camera_daily, "groups", ()),
    ("combo_daily", R.combo_daily, "groups", ("hour",)),
    ("diversity_by_camera", R.diversity_by_camera, "groups", ()),
    ("category_ratio_by_camera", R.category_ratio_by_camera, "groups", ()),
    ("environmental_context", R.environmental_context, "canon", ()),
    ("filter_option_ranges", R.filter_option_ranges, "canon", ()),
    ("count_events", R.count_events, "canon", ()),
]:
    def _make(fn=_fn, src=_src, dbl=_dbl):
        def run(spark, d):
            frame = canon(spark, d) if src == "canon" else groups(spark, d)
            return finish(fn(frame), as_double=dbl)
        return run
    QUERIES[_name] = _make()

daily_seasonality = QUERIES["category_trend"]
QUERIES["daily_seasonality"] = daily_seasonality


@register("filter_option_values")
def q_filter_option_values(spark, d):
    return finish(R.filter_option_values(canon(spark, d), adapter.devices(spark, d)))


@register("day_summary_totals")
def q_day_totals(spark, d):
    return finish(R.day_totals(R.on_day(canon(spark, d), DAY)))


@register("day_summary_hourly")
def q_day_hourly(spark, d):
    return finish(R.day_hourly(R.on_day(canon(spark, d), DAY)))


@register("day_summary_classes")
def q_day_classes(spark, d):
    return finish(R.day_classes(R.on_day(canon(spark, d), DAY)))


@register("day_summary_cameras")
def q_day_cameras(spark, d):
    return finish(R.day_cameras(R.on_day(canon(spark, d), DAY)))


# ------------------------------------------------------------------ lab
from ..operators import lab as L  # noqa: E402


def combo(spark, d):
    """Staged combinations with running totals."""
    return staging.combos_table(spark, d)


def lab_inputs(spark, d, novel: bool = False):
    """The combo table plus its analysis windows, uncut shifts (and scored
    patterns) as shared plan fragments: one definition each, so identical
    sub-plans are reused instead of being re-derived."""
    cb = combo(spark, d)
    win = L.analysis_windows(cb)
    sh = L.category_shift_all(cb, win)
    nv = L.novel_patterns(cb, win, sh) if novel else None
    return cb, win, sh, nv


def cam_daily(spark, d):
    return R.camera_daily(groups(spark, d))


@register("analysis_windows")
def q_windows(spark, d):
    return finish(L.analysis_windows(combo(spark, d)).drop("rdesc"))


@register("forecast")
def q_forecast(spark, d):
    return finish(L.forecast(R.category_trend(groups(spark, d))))


@register("camera_forecast")
def q_camera_forecast(spark, d):
    return finish(L.camera_forecast(cam_daily(spark, d)).drop("i"))


@register("camera_forecast_leaders")
def q_leaders(spark, d):
    return finish(L.camera_forecast_leaders(L.camera_forecast(cam_daily(spark, d))))


@register("category_shift_matrix")
def q_shift(spark, d):
    return finish(L.category_shift_matrix(combo(spark, d)))


@register("novel_events")
def q_novel(spark, d):
    return finish(L.novel_events(lab_inputs(spark, d, novel=True)[3]))


@register("novelty_by_date")
def q_novelty_by_date(spark, d):
    cb, win, _, nv = lab_inputs(spark, d, novel=True)
    return finish(L.novelty_by_date(cb, nv, win))


@register("novelty_timeline")
def q_novelty_timeline(spark, d):
    cb = combo(spark, d)
    return finish(L.novelty_timeline(cb, L.analysis_windows(cb)))


@register("anomaly_timeline")
def q_anomaly_timeline(spark, d):
    cb, win, _, nv = lab_inputs(spark, d, novel=True)
    return finish(L.anomaly_timeline(canon(spark, d), L.novelty_by_date(cb, nv, win)))


@register("camera_clusters")
def q_clusters(spark, d):
    return finish(L.camera_clusters(R.diversity_by_camera(groups(spark, d)), ops.camera_anomalies(canon(spark, d), AS_OF)))


@register("overview_insights")
def q_overview_insights(spark, d):
    cn = canon(spark, d)
    g = groups(spark, d)
    health = ops.camera_health(cn, AS_OF_LATE)
    return finish(L.overview_insights(health, ops.overview_kpis(g, health), R.top_cameras(g),
                                      ops.stale_all(health)))


@register("advanced_insights")
def q_advanced_insights(spark, d):
    _, _, sh, nv = lab_inputs(spark, d, novel=True)
    leaders = L.camera_forecast_leaders(L.camera_forecast(cam_daily(spark, d)))
    return finish(L.advanced_insights(leaders, nv, sh))


@register("daily_trend_pivot")
def q_daily_trend(spark, d):
    return finish(L.daily_trend(R.daily_activity(canon(spark, d))))


@register("heatmap_intensity")
def q_heatmap(spark, d):
    return finish(L.hour_heatmap_grid(R.hourly_heatmap(canon(spark, d))))


@register("forecast_residual_matrix")
def q_residual_matrix(spark, d):
    fc = L.camera_forecast(cam_daily(spark, d))
    return finish(L.forecast_residual_matrix(fc.drop("i"), L.camera_forecast_leaders(fc)))


# ------------------------------------------------------ explorer / records
from ..operators import explorer as X  # noqa: E402
from ..operators import paging as PG  # noqa: E402
from ..operators import search as TS  # noqa: E402
from ..operators import summary as SM  # noqa: E402
from ..operators.canonical import BASE_COLUMNS  # noqa: E402
from ..operators.filters import SORT_KEYS, EventQuery, Filters  # noqa: E402
from ..sources import ingest  # noqa: E402

RECORD_DOUBLE = ("lux", "heat_level", "bearing", "upload_lag_seconds", "ai_lag_seconds", "processing_lag_seconds")
RECORD_TEXT = ("json_processed", "uploaded")

PAGE_DEFAULT = EventQuery()
PAGE_FILTERED = EventQuery(camera_name=("cam-00", "cam-03", "alt-21"), time_of_day_bucket=("morning", "night"),
                           min_lux=5, page=2, page_size=25, sort_by="temperature", sort_dir="asc")
CSV_QUERY = EventQuery(subject_category=("wildlife", "human"), sort_by="lux", sort_dir="desc")

FILTERS = {
    "filter_camera": Filters(camera_name=("cam-00", "alt-21")),
    "filter_mac": Filters(mac=("mac-03", "mac-09")),
    "filter_dates": Filters(start_date="2024-01-10", end_date="2024-01-12"),
    "filter_bucket": Filters(time_of_day_bucket=("morning", "night")),
    "filter_category": Filters(subject_category=("wildlife", "unknown")),
    "filter_class": Filters(subject_class=("elk", "fox_coyote")),
    "filter_search": Filters(q="near the WOLF"),
    "filter_ranges": Filters(min_lux=10, max_lux=40, min_temperature=-50, max_temperature=100,
                             min_heat_level=20, max_heat_level=80),
}
COMBINED = Filters(start_date="2024-01-05", end_date="2024-01-25", subject_class=("elk", "hiker", "bird"),
                   min_temperature=-55)


def sizes(spark, d):
    """Burst sizes of all events, from the gold states."""
    return G.group_sizes(staging.groups_table(spark, d))


def _records(df):
    return finish(df, as_double=RECORD_DOUBLE, as_text=RECORD_TEXT)


@register("base")
def q_base(spark, d):
    c = canon(spark, d)
    return finish(C.with_group_size_full(c).select(*BASE_COLUMNS, "event_group_size"),
                  as_double=RECORD_DOUBLE, as_text=RECORD_TEXT)


@register("event_group_size")
def q_event_group_size(spark, d):
    return finish(X.event_group_size(canon(spark, d)))


@register("events_page")
def q_events_page(spark, d):
    return _records(X.events_page(canon(spark, d), PAGE_DEFAULT, sizes(spark, d)))


for _key in SORT_KEYS:
    for _dir in ("asc", "desc"):
        def _mkp(query=EventQuery(page=2, page_size=20, sort_by=_key, sort_dir=_dir)):
            def run(spark, d):
                return _records(X.events_page(canon(spark, d), query, sizes(spark, d)))
            return run
        QUERIES[f"events_page_{_key}_{_dir}"] = _mkp()


# Deep pages by the index, every sort form; page 31 lies inside the smallest table.
for _key in SORT_KEYS:
    for _dir in ("asc", "desc"):
        def _mkd(query=EventQuery(page=31, page_size=20, sort_by=_key, sort_dir=_dir)):
            def run(spark, d):
                return _records(PG.events_page_at(canon(spark, d), staging.pages_table(spark, d), staging.page_starts_table(spark, d),
                                                  query, sizes(spark, d)))
            return run
        QUERIES[f"deep_page_{_key}_{_dir}"] = _mkd()


@register("events_page_filtered")
def q_events_page_filtered(spark, d):
    return _records(X.events_page(canon(spark, d), PAGE_FILTERED))


@register("notable_events")
def q_notable(spark, d):
    return _records(X.notable_events(canon(spark, d), sizes(spark, d)))


@register("day_summary_events")
def q_day_events(spark, d):
    return _records(X.day_events(R.on_day(canon(spark, d), DAY)))


@register("events_csv")
def q_events_csv(spark, d):
    return finish(X.events_csv_frame(canon(spark, d), CSV_QUERY), as_double=("lux", "heat_level"))


for _name, _flt in FILTERS.items():
    def _mk(flt=_flt):
        def run(spark, d):
            return finish(canon(spark, d, flt).select("id", "event_group", "camera_name"))
        return run
    QUERIES[_name] = _mk()


SLICES = {
    "daily_activity": Filters(camera_name=("cam-00", "cam-03", "alt-21"), subject_category=("wildlife", "human")),
    "hourly_heatmap": Filters(start_date="2024-01-10", end_date="2024-01-20"),
    "time_of_day_composition": Filters(mac=("mac-03", "mac-09", "mac-11")),
    "subject_by_camera": Filters(time_of_day_bucket=("morning", "night"), start_date="2024-01-05"),
    "monthly_activity": Filters(subject_class=("elk", "fox_coyote", "hiker")),
    "composition": Filters(time_of_day_bucket=("evening",), end_date="2024-01-25", camera_name=("cam-00", "cam-01", "cam-02", "cam-04")),
}


def on_slice(spark: SparkSession, d: str, report: str, filters: Filters) -> DataFrame:
    """A4-A9 on a slice: from the group cells where they keep what the filter
    looks at, else from the events."""
    if filters.on_cells():
        return G.REPORTS[report](staging.cells_table(spark, d).filter(filters.predicate()))
    return getattr(R, report)(canon(spark, d, filters))


for _name, _flt in SLICES.items():
    def _mks(report=_name, flt=_flt):
        def run(spark, d):
            return finish(on_slice(spark, d, report, flt), as_double=("hour",))
        return run
    QUERIES[f"filtered_{_name}"] = _mks()


# F7 by posting lists: a phrase, wildcards kept, no usable gram, none that is known.
SEARCHES = {"search_phrase": "near the WOLF", "search_wildcards": "the w_LF%en", "search_short": "pu", "search_none": "no such words"}


def found(spark: SparkSession, d: str, q: str) -> DataFrame:
    return TS.events(canon(spark, d), *staging.search_tables(spark, d), q)


for _name, _q in SEARCHES.items():
    def _mkt(q=_q):
        def run(spark, d):
            return finish(found(spark, d, q).select("id", "event_group", "camera_name"))
        return run
    QUERIES[_name] = _mkt()


@register("search_composition")
def q_search_composition(spark, d):
    return finish(R.composition(found(spark, d, "the wolf").filter(COMBINED.predicate())))


@register("filtered_kpis")
def q_filtered_kpis(spark, d):
    return finish(R.kpis(C.kpi_groups(canon(spark, d, COMBINED))))


@register("filtered_overview_kpis")
def q_filtered_overview(spark, d):
    c = canon(spark, d, COMBINED)
    return finish(ops.overview_kpis(C.event_groups(c), ops.camera_health(c, AS_OF)))


# ------------------------------------------------------ normalisation keys
NORM_KEYS = {
    "norm_timestamp": ["local_timestamp", "event_date", "hour"],
    "norm_camera": ["camera_name"],
    "norm_event": ["event_group"],
    "norm_text": ["analysis_title", "analysis_summary", "upload", "file_type", "timezone"],
    "norm_telemetry": ["lux", "temperature", "humidity", "pressure", "heat_level", "voltage",
                       "battery_percentage", "raw_battery_percentage", "latitude", "longitude", "bearing"],
    "norm_subject": ["subject_class", "category", "subject_category"],
    "norm_time_buckets": ["time_of_day_bucket", "daypart"],
    "norm_lags": ["upload_lag_seconds", "ai_lag_seconds", "processing_lag_seconds"],
    "norm_flags": ["low_light_flag", "parse_success", "suspicious_numeric_flag"],
}
for _name, _cols in NORM_KEYS.items():
    def _mkn(cols=_cols):
        def run(spark, d):
            return finish(canon(spark, d).select("id", *cols),
                          as_double=tuple(c for c in cols if c in RECORD_DOUBLE or c == "hour"))
        return run
    QUERIES[_name] = _mkn()


@register("norm_analysis")
def q_norm_analysis(spark, d):
    from ..functions import normalize as N
    return finish(raw_events(spark, d).select("id", N.analysis_json().alias("analysis")))


# ------------------------------------------------------ sources and joins
RAW_DOUBLE = ("heat_level",)
RAW_TEXT = ("json_processed", "uploaded")


@register("scan_events")
def q_scan_events(spark, d):
    return finish(raw_events(spark, d), as_double=RAW_DOUBLE, as_text=RAW_TEXT)


@register("devices")
def q_devices(spark, d):
    return finish(adapter.devices(spark, d).orderBy("camera_name"))


@register("events_devices_join")
def q_events_devices(spark, d):
    return finish(SM.events_devices(canon(spark, d), adapter.devices(spark, d)))


@register("daily_camera_summary")
def q_daily_summary(spark, d):
    return finish(SM.daily_camera_summary(raw_events(spark, d)))


@register("summary_devices_join")
def q_summary_devices(spark, d):
    return finish(SM.summary_devices(SM.daily_camera_summary(raw_events(spark, d)), adapter.devices(spark, d)))


@register("seed_summary_totals")
def q_seed_totals(spark, d):
    return finish(SM.seed_totals(raw_events(spark, d)))


@register("seed_summary_by_camera")
def q_seed_by_camera(spark, d):
    return finish(SM.seed_by_camera(raw_events(spark, d)))


@register("seed_summary_by_bucket")
def q_seed_by_bucket(spark, d):
    return finish(SM.seed_by_bucket(raw_events(spark, d)))


@register("head_export")
def q_head_export(spark, d):
    return finish(ingest.head_export(raw_events(spark, d)), as_double=("heat_level",))


# ------------------------------------------------------ deliveries
# The store holds what came before; the whole delivery comes again.
REPLAY_FROM = "2024-01-16T00:00:00"


@register("ingest_raw_json")
def q_ingest_raw_json(spark, d):
    raw = ingest.read_raw_export(spark, staging.export_folder(spark, d))
    return finish(ingest.raw_to_events(raw), as_double=RAW_DOUBLE, as_text=RAW_TEXT)


@register("ingest_field_map")
def q_ingest_field_map(spark, d):
    raw = ingest.read_raw_export(spark, staging.export_folder(spark, d))
    return finish(ingest.export_projection(raw), as_double=("heat_level",))


@register("merge_insert_ignore")
def q_merge_insert_ignore(spark, d):
    held = raw_events(spark, d).filter(F.col("utc_timestamp") < F.lit(REPLAY_FROM).cast("timestamp_ntz"))
    come = raw_events(spark, d).withColumn("_order", F.col("utc_timestamp"))
    return finish(ingest.merge_insert_ignore(held, come, "_order"), as_double=RAW_DOUBLE, as_text=RAW_TEXT)


# ------------------------------------------------------ governed workspace
from . import builder as B  # noqa: E402

BUILDER_SPEC = B.BuilderSpec(
    relation="events",
    columns=("camera_name", "subject_category"),
    aggregates=(B.Aggregate("COUNT", "id", "events"), B.Aggregate("AVG", "voltage"),
                B.Aggregate("MAX", "temperature", "max_temp")),
    filters=(B.Filter("voltage", "IS NOT NULL"), B.Filter("sequence", "BETWEEN", 1, 2),
             B.Filter("camera_name", "IN", "cam-00, cam-03, cam-06")),
    sort=(B.Sort("events", "desc"), B.Sort("camera_name"), B.Sort("subject_category")),
    limit=100,
)


BUILDER_COMPARE = B.BuilderSpec(
    relation="events",
    columns=("camera_name", "sequence"),
    aggregates=(B.Aggregate("COUNT", "id", "events"), B.Aggregate("MIN", "temperature"), B.Aggregate("SUM", "voltage"),
                B.Aggregate("MAX", "lux"), B.Aggregate("AVG", "humidity")),
    filters=(B.Filter("temperature", ">", -58), B.Filter("temperature", "<=", 400), B.Filter("sequence", ">=", 1),
             B.Filter("lux", "<", 45), B.Filter("sequence", "!=", 2), B.Filter("camera_name", "ILIKE", "CAM-%"),
             B.Filter("ai_processed", "=", "true")),
    sort=(B.Sort("sequence", "desc"), B.Sort("camera_name")),
)
BUILDER_ROWS = B.BuilderSpec(
    relation="events",
    columns=("id", "camera_name", "sensor", "upload"),
    filters=(B.Filter("event", "LIKE", "grp-%1"), B.Filter("upload", "IS NULL"), B.Filter("sensor", "=", "B")),
    sort=(B.Sort("id"),),
    limit=500,
)


@register("builder_compare")
def q_builder_compare(spark, d):
    return finish(B.build(B.relations(spark, d), BUILDER_COMPARE), as_double=("max_lux",))


@register("builder_rows")
def q_builder_rows(spark, d):
    return finish(B.build(B.relations(spark, d), BUILDER_ROWS))


@register("builder_query")
def q_builder(spark, d):
    return finish(B.build(B.relations(spark, d), BUILDER_SPEC))


# Joins of the workspace: devices without activity, each side alone, events taken
# while an earlier one of the camera awaited analysis, positions near a device.
_WAIT = B.J.Band("utc_timestamp", "utc_timestamp", "ai_timestamp", step=60)
JOINS = {
    "join_left": B.JoinSpec("dim_devices", "daily_camera_summary", on=(("mac", "mac"),), how="left",
                            columns=(("left", "mac", "mac"), ("right", "date", "date"), ("right", "total_rows", "total_rows"))),
    "join_full": B.JoinSpec("dim_devices", "daily_camera_summary", on=(("mac", "mac"),), how="full",
                            left_filters=(B.Filter("location_code", "IN", "R1, R2"),),
                            columns=(("left", "mac", "device"), ("right", "mac", "active"), ("right", "date", "date"))),
    "join_band": B.JoinSpec("events", "events", on=(("mac", "mac"),), band=_WAIT,
                            columns=(("right", "camera_name", "camera_name"), ("right", "id", "waiting"), ("left", "id", "taken"))),
    "join_band_left": B.JoinSpec("events", "dim_devices", band=B.J.Band("latitude", "latitude", "latitude", slack=0.15, step=0.1), how="left",
                                 columns=(("left", "camera_name", "camera_name"), ("left", "id", "id"), ("right", "mac", "near"))),
    "join_band_full": B.JoinSpec("events", "events", on=(("mac", "mac"),), band=_WAIT, how="full",
                                 left_filters=(B.Filter("uploaded", "=", False),), right_filters=(B.Filter("sequence", "=", 1),),
                                 columns=(("left", "camera_name", "failed_at"), ("left", "id", "failed"),
                                          ("right", "camera_name", "waiting_at"), ("right", "id", "waiting"))),
}
JOIN_KEYS = {"join_left": ("mac",), "join_full": ("device", "active"), "join_band": ("camera_name",),
             "join_band_left": ("camera_name", "near"), "join_band_full": ("failed_at", "waiting_at")}

for _key in JOINS:
    def _mkj(key=_key):
        def run(spark, d):
            return finish(B.join(B.relations(spark, d), JOINS[key], JOIN_KEYS[key]))
        return run
    QUERIES[_key] = _mkj()


for _key in B.EXAMPLES:
    def _mke(key=_key):
        def run(spark, d):
            df = B.run_example(spark, B.relations(spark, d), key)
            return finish(df, as_double=("heat_level",) if key == "ex_select_star" else (),
                          as_text=("uploaded", "json_processed") if key == "ex_select_star" else ())
        return run
    QUERIES[_key] = _mke()


@register("events_page_seek")
def q_events_page_seek(spark, d):
    import datetime as _dt
    return _records(X.events_page_after(canon(spark, d), PAGE_DEFAULT, _dt.datetime(2024, 1, 20, 12, 0, 0), ""))
