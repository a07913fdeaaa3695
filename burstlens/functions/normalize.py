"""Canonicalisation rules as Spark ``Column`` expressions (no UDFs).

Every function takes nothing or a column name and returns a ``Column`` over
the raw ``events`` schema, so Catalyst can fuse all of them into one
projection inside whole-stage codegen.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def blank_to_null(c: Column) -> Column:
    """``nullif(btrim(x), '')``: strips spaces only, blank becomes null."""
    return F.nullif(F.btrim(c), F.lit(""))


def underscore_lower(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit(" "), F.lit("_"))


def in_range(c: Column, bounds) -> Column:
    lo, hi = bounds
    return F.when(c.between(lo, hi), c)


# ----------------------------------------------------------------- JSON
def analysis_json() -> Column:
    """Stored analysis, else ``ai_description`` when it looks like an object."""
    desc = col("ai_description")
    looks_json = desc.isNotNull() & (F.left(F.ltrim(desc), F.lit(1)) == F.lit("{"))
    return F.coalesce(col("analysis"), F.when(looks_json, desc))


# Top-level analysis fields read as text: one JSON parse per row; nested
# objects come back as their JSON text (same values as ``get_json_object``).
ANALYSIS_FIELDS = "title string, summary string, details string, keywords string"


def analysis_fields(doc: Column) -> Column:
    """Parse the analysis document once into a struct of text fields."""
    return F.from_json(doc, ANALYSIS_FIELDS)


def analysis_paths(fields: Column) -> dict[str, Column]:
    """The document paths the rules read, from the parsed struct."""
    details, keywords = fields.getField("details"), fields.getField("keywords")
    return {
        "title": fields.getField("title"),
        "summary": fields.getField("summary"),
        "main_subject": F.get_json_object(details, "$.main_subject"),
        "animals": F.get_json_object(keywords, "$.Animals"),
        "people": F.get_json_object(keywords, "$.People"),
        "threats": F.get_json_object(keywords, "$.Threats"),
    }


# ----------------------------------------------------------- identity
def local_timestamp() -> Column:
    return F.coalesce(col("timestamp"), col("utc_timestamp_off"), col("utc_timestamp"),
                      col("created"), col("ai_timestamp"), col("json_timestamp"))


def camera_name() -> Column:
    return F.coalesce(blank_to_null(col("camera_name")), blank_to_null(col("name")), col("mac"))


def event_group() -> Column:
    return F.coalesce(blank_to_null(col("event")), blank_to_null(col("id")))


def analysis_title(fields: Column | None = None) -> Column:
    fields = analysis_fields(analysis_json()) if fields is None else fields
    return F.coalesce(blank_to_null(col("analysis_title")), blank_to_null(fields.getField("title")))


def analysis_summary(fields: Column | None = None) -> Column:
    fields = analysis_fields(analysis_json()) if fields is None else fields
    return F.coalesce(blank_to_null(col("analysis_summary")), blank_to_null(fields.getField("summary")))


# ------------------------------------------------------------ telemetry
def raw_battery() -> Column:
    return F.coalesce(col("battery_percentage"), col("batteryPercentage"))


def battery() -> Column:
    return in_range(raw_battery(), K.RANGE_BATTERY)


def raw_heat() -> Column:
    return F.coalesce(col("heat_level"), col("heatLevel"))


def heat_level() -> Column:
    return in_range(raw_heat(), K.RANGE_HEAT)


def voltage() -> Column:
    return in_range(col("voltage"), K.RANGE_VOLTAGE)


def temperature() -> Column:
    return in_range(col("temperature"), K.RANGE_TEMPERATURE)


def humidity() -> Column:
    return in_range(col("humidity"), K.RANGE_HUMIDITY)


def pressure() -> Column:
    return in_range(col("pressure"), K.RANGE_PRESSURE)


def lux() -> Column:
    return in_range(col("lux"), K.RANGE_LUX)


def bearing() -> Column:
    return in_range(col("bearing"), K.RANGE_BEARING)


def latitude() -> Column:
    return in_range(col("latitude"), K.RANGE_LATITUDE)


def longitude() -> Column:
    return in_range(col("longitude"), K.RANGE_LONGITUDE)


def file_type() -> Column:
    return F.coalesce(blank_to_null(col("file_type")), blank_to_null(col("fileType")))


def timezone() -> Column:
    return F.coalesce(blank_to_null(col("timezone")), F.lit(K.DEFAULT_TIMEZONE))


def upload_text() -> Column:
    up = col("uploaded")
    return F.coalesce(blank_to_null(col("upload")),
                      F.when(up == F.lit(True), F.lit("true")).when(up == F.lit(False), F.lit("false")))


# -------------------------------------------------------- subject
def subject_signal(fields: Column | None = None) -> Column:
    fields = analysis_fields(analysis_json()) if fields is None else fields
    p = analysis_paths(fields)
    parts = [col("subject_class"), col("subject_category"), p["main_subject"], p["animals"],
             p["people"], p["threats"], p["title"], p["summary"]]
    return F.lower(F.concat_ws(" ", *[blank_to_null(p) for p in parts]))


def subject_class(signal: Column) -> Column:
    """Stored class (lower, spaces to underscores), else the keyword ladder."""
    stored = blank_to_null(col("subject_class"))
    expr = F.when(stored.isNotNull(), underscore_lower(stored))
    for label, words in K.CLASS_LADDER:
        hit = reduce(lambda a, b: a | b, [signal.contains(w) for w in words])
        expr = expr.when(hit, F.lit(label))
    return expr


def subject_category(cls: Column, signal: Column) -> Column:
    """Stored category, else derived from the class, else the threat keyword.

    ``cls`` must already be a column (computed once in an earlier projection)
    so the ladder is not expanded again inside this expression.
    """
    stored = blank_to_null(col("subject_category"))
    return (F.when(stored.isNotNull(), underscore_lower(stored))
            .when(cls.isin(*K.WILDLIFE_CLASSES), F.lit("wildlife"))
            .when(cls.isin(*K.HUMAN_CLASSES), F.lit("human"))
            .when(cls == F.lit(K.VEHICLE_CLASS), F.lit("vehicle"))
            .when(cls == F.lit(K.EMPTY_CLASS), F.lit("empty_scene"))
            .when(signal.contains(K.THREAT_KEYWORD), F.lit("threat")))


# ---------------------------------------------------------- time
def _hour_ladder(hour: Column, ladder, other: str) -> Column:
    expr = None
    for label, lo, hi in ladder:
        cond = hour.between(lo, hi)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(other))


def time_bucket(ts: Column) -> Column:
    return F.coalesce(blank_to_null(col("time_of_day_bucket")),
                      _hour_ladder(F.hour(ts), K.BUCKET_HOURS, K.BUCKET_OTHER))


def daypart(ts: Column) -> Column:
    return _hour_ladder(F.hour(ts), K.DAYPART_HOURS, K.DAYPART_OTHER)


def lag_seconds(later: Column, ts: Column) -> Column:
    """Whole seconds from ``ts`` to ``later``, floored at 0, null if ``later`` is.

    ``greatest`` skips nulls (so a null ``ts`` gives 0) and the int cast rounds
    half away from zero, as the specification's ``::int`` does.
    """
    secs = F.timestamp_diff("MICROSECOND", ts, later) / F.lit(1_000_000.0)
    return F.when(later.isNotNull(), F.round(F.greatest(secs, F.lit(0.0))).cast("int"))


def upload_lag(ts: Column) -> Column:
    return lag_seconds(col("created"), ts)


def ai_lag(ts: Column) -> Column:
    return lag_seconds(col("ai_timestamp"), ts)


def processing_lag(ts: Column) -> Column:
    return lag_seconds(F.coalesce(col("ai_timestamp"), col("json_timestamp"), col("created")), ts)


# ----------------------------------------------------------- flags
def low_light(norm_lux: Column) -> Column:
    return F.coalesce(norm_lux, F.lit(K.LOW_LIGHT_NULL_LUX)) < F.lit(K.LOW_LIGHT_LUX)


def parse_success() -> Column:
    return col("analysis").isNotNull() | col("ai_description").isNotNull()


def suspicious_numeric() -> Column:
    pairs = [(col("voltage"), voltage()), (raw_battery(), battery()), (col("temperature"), temperature()),
             (col("humidity"), humidity()), (col("pressure"), pressure())]
    return reduce(lambda a, b: a | b, [raw.isNotNull() & norm.isNull() for raw, norm in pairs])


def iso_seconds(ts: Column) -> Column:
    return F.date_format(ts, K.ISO_SECONDS)


def js_round(x: Column, digits: int = 1) -> Column:
    """Round half toward +infinity (the UI helper's rounding); null stays null."""
    p = 10 ** digits
    return F.floor(x * F.lit(float(p)) + F.lit(0.5)) / F.lit(float(p))


def r6(x: Column) -> Column:
    """Six-decimal rounding applied to reported doubles for stable comparison."""
    return F.round(x.cast("double"), 6)


def literal(value) -> "Column":
    """A literal; date-times become ``timestamp_ntz`` from their text so the
    value never depends on the session or process time zone."""
    import datetime as _dt
    if isinstance(value, _dt.datetime):
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(value)
