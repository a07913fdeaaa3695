"""Governed query workspace, re-aimed as a DataFrame builder.

* G1 ``catalog``: the three relations with logical column types derived from
  their Spark schemas, per-type operators and aggregates, defaults, limits.
* G2 ``build``: a ``BuilderSpec`` (relation, columns, aggregates, filters,
  group by, sort, limit) checked against the catalog and turned into
  ``select / filter / groupBy / agg / orderBy / limit``.
* J3 ``join``: a ``JoinSpec`` (two relations, equality keys, a band or both,
  inner, left, right or full form), checked the same way.
* G3/G4: the canned example statements and accepted workspace statements,
  run with ``spark.sql`` over the relations passed as DataFrame arguments.
* G5 ``register_views``: the relations as temp views for free ``spark.sql``.

Free SQL is parsed, analysed and optimised by Spark itself; no SQL text
guard is reimplemented (see README).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import joins as J
from ..operators import summary as SM
from ..sources import adapter, staging

# FIXED VALUES: per logical type, the allowed filter operators and aggregates.
OPERATORS = {
    "text": ["=", "!=", "IN", "LIKE", "ILIKE", "IS NULL", "IS NOT NULL"],
    "number": ["=", "!=", ">", ">=", "<", "<=", "IN", "BETWEEN", "IS NULL", "IS NOT NULL"],
    "date": ["=", "!=", ">", ">=", "<", "<=", "BETWEEN", "IS NULL", "IS NOT NULL"],
    "timestamp": ["=", "!=", ">", ">=", "<", "<=", "BETWEEN", "IS NULL", "IS NOT NULL"],
    "boolean": ["=", "!=", "IS NULL", "IS NOT NULL"],
    "json": ["IS NULL", "IS NOT NULL"],
}
AGGREGATES = {
    "text": ["COUNT", "MIN", "MAX"],
    "number": ["COUNT", "AVG", "MIN", "MAX", "SUM"],
    "date": ["COUNT", "MIN", "MAX"],
    "timestamp": ["COUNT", "MIN", "MAX"],
    "boolean": ["COUNT"],
    "json": ["COUNT"],
}
DEFAULT_LIMIT = 100
MAX_LIMIT = 1200
# FIXED VALUES: relations, their columns (in order), default columns and limits.
RELATIONS = {
    "daily_camera_summary": dict(
        category="preferred", default_limit=DEFAULT_LIMIT,
        default_columns=["date", "camera_name", "unique_event_groups", "avg_temperature", "avg_lux"],
        columns=["date", "mac", "camera_name", "total_rows", "unique_event_groups", "wildlife_rows", "human_rows",
                 "vehicle_rows", "empty_scene_rows", "morning_rows", "afternoon_rows", "evening_rows",
                 "night_rows", "avg_temperature", "avg_lux", "avg_heat_level", "avg_battery_percentage"]),
    "dim_devices": dict(
        category="preferred", default_limit=50,
        default_columns=["camera_name", "mac", "location_name", "camera_profile"],
        columns=["mac", "camera_name", "location_name", "location_code", "latitude", "longitude",
                 "camera_profile", "notes"]),
    "events": dict(
        category="advanced", default_limit=DEFAULT_LIMIT,
        default_columns=["timestamp", "camera_name", "event", "subject_category", "analysis_title"],
        columns=["id", "name", "camera_name", "mac", "event", "timestamp", "utc_timestamp", "sequence", "sensor",
                 "location", "latitude", "longitude", "temperature", "humidity", "pressure", "voltage", "bearing",
                 "battery_percentage", "lux", "heat_level", "file_type", "filename", "image_blob_url", "uploaded",
                 "upload", "created", "ai_processed", "ai_timestamp", "json_processed", "json_timestamp",
                 "utc_timestamp_off", "timezone", "tag", "analysis_title", "analysis_summary", "subject_class",
                 "subject_category", "time_of_day_bucket"]),
}


def relations(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The three workspace relations, derived from the given tables."""
    raw = staging.raw_table(spark, sf_dir)
    return {
        "daily_camera_summary": SM.daily_camera_summary(raw),
        "dim_devices": adapter.devices(spark, sf_dir),
        "events": raw.select(*[F.col(f"`{c}`") for c in RELATIONS["events"]["columns"]]),
    }


def register_views(spark: SparkSession, sf_dir: str, prefix: str = "") -> list[str]:
    """The relations as temp views (``prefix`` avoids clobbering names)."""
    names = []
    for name, df in relations(spark, sf_dir).items():
        df.createOrReplaceTempView(prefix + name)
        names.append(prefix + name)
    return names


def logical_type(dt: T.DataType) -> str:
    if isinstance(dt, T.StringType):
        return "text"
    if isinstance(dt, (T.IntegerType, T.LongType, T.ShortType, T.DoubleType, T.FloatType, T.DecimalType)):
        return "number"
    if isinstance(dt, T.DateType):
        return "date"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    if isinstance(dt, T.BooleanType):
        return "boolean"
    return "json"


def catalog(rels: dict[str, DataFrame]) -> dict[str, dict]:
    """G1: catalog entries validated against the relations' schemas."""
    out = {}
    for name, meta in RELATIONS.items():
        fields = {f.name: f.dataType for f in rels[name].schema.fields}
        missing = [c for c in meta["columns"] if c not in fields]
        if missing:
            raise ValueError(f"relation {name} lacks catalog columns {missing}")
        cols = {}
        for c in meta["columns"]:
            t = logical_type(fields[c])
            cols[c] = dict(type=t, label=c.replace("_", " "), operators=OPERATORS[t], aggregates=AGGREGATES[t],
                           groupable=t != "json", sortable=t != "json")
        out[name] = dict(meta, columns=cols, max_limit=MAX_LIMIT)
    return out


def catalog_frame(spark: SparkSession, cat: dict[str, dict]) -> DataFrame:
    """The catalog as a DataFrame (one row per relation column)."""
    rows = [(rel, i, col, m["type"], m["label"], m["operators"], m["aggregates"], m["groupable"], m["sortable"])
            for rel, meta in cat.items() for i, (col, m) in enumerate(meta["columns"].items())]
    schema = ("relation string, position int, column string, type string, label string, operators array<string>, "
              "aggregates array<string>, groupable boolean, sortable boolean")
    return spark.createDataFrame(rows, schema)


@dataclass(frozen=True)
class Aggregate:
    func: str
    column: str | None = None
    alias: str | None = None


@dataclass(frozen=True)
class Filter:
    column: str
    operator: str
    value: object = None
    second_value: object = None


@dataclass(frozen=True)
class Sort:
    column: str
    direction: str = "asc"


@dataclass(frozen=True)
class BuilderSpec:
    relation: str
    columns: tuple[str, ...] = ()
    aggregates: tuple[Aggregate, ...] = ()
    filters: tuple[Filter, ...] = ()
    group_by: tuple[str, ...] = ()
    sort: tuple[Sort, ...] = ()
    limit: int | None = None


@dataclass(frozen=True)
class JoinSpec:
    left: str
    right: str
    columns: tuple[tuple[str, str, str], ...]
    on: tuple[tuple[str, str], ...] = ()
    band: J.Band | None = None
    how: str = "inner"
    left_filters: tuple[Filter, ...] = ()
    right_filters: tuple[Filter, ...] = ()


def _predicate(c: Column, f: Filter, typ: str) -> Column:
    op = f.operator
    if op == "IS NULL":
        return c.isNull()
    if op == "IS NOT NULL":
        return c.isNotNull()
    if op == "IN":
        values = [v.strip() for v in str(f.value or "").split(",") if v.strip()] if isinstance(f.value, str) \
            else list(f.value or [])
        if not values:
            raise ValueError(f"IN without values on column {f.column!r}")
        return c.isin(values)
    if op == "BETWEEN":
        return c.between(f.value, f.second_value)
    if op == "LIKE":
        return c.like(str(f.value))
    if op == "ILIKE":
        return c.ilike(str(f.value))
    value = f.value
    if typ == "boolean" and isinstance(value, str):
        value = value.lower() == "true"
    return {"=": c == value, "!=": c != value, ">": c > value, ">=": c >= value,
            "<": c < value, "<=": c <= value}[op]


def _filtered(df: DataFrame, cols: dict[str, dict], filters: tuple[Filter, ...]) -> DataFrame:
    for f in filters:
        if f.column not in cols:
            raise ValueError(f"unknown column {f.column!r} in filter")
        m = cols[f.column]
        if f.operator not in m["operators"]:
            raise ValueError(f"operator {f.operator} not allowed on {m['type']} column {f.column!r}")
        df = df.filter(_predicate(F.col(f"`{f.column}`"), f, m["type"]))
    return df


def join(rels: dict[str, DataFrame], spec: JoinSpec, by: tuple[str, ...] | None = None) -> DataFrame:
    """Two relations joined on equality keys, a band or both (raises
    ``ValueError`` on bad specs); the result is open to any DataFrame step.
    With ``by`` its rows come counted by these columns of it: ``joined``, and
    ``n_<column>`` (not null) of the others; band joins make no pairs for that."""
    cat = catalog(rels)
    sides = {}
    for side, name, filters in (("left", spec.left, spec.left_filters), ("right", spec.right, spec.right_filters)):
        if name not in cat:
            raise ValueError(f"unknown relation {name!r}")
        sides[side] = (cat[name]["columns"], _filtered(rels[name], cat[name]["columns"], filters))

    def typed(side: str, col: str) -> str:
        if side not in sides or col not in sides[side][0]:
            raise ValueError(f"unknown column {col!r} of the {side} side in join")
        return sides[side][0][col]["type"]

    pairs = [*spec.on, *((spec.band.value, c) for c in ((spec.band.low, spec.band.high) if spec.band else ()))]
    for a, b in pairs:
        if typed("left", a) != typed("right", b):
            raise ValueError(f"columns {a!r} and {b!r} are of different types")
    if spec.band and typed("left", spec.band.value) not in ("number", "date", "timestamp"):
        raise ValueError(f"no band on {typed('left', spec.band.value)} column {spec.band.value!r}")
    if not spec.columns:
        raise ValueError("a join names its columns as (side, column, alias)")
    shown = []
    for side, col, alias in spec.columns:
        typed(side, col)
        shown.append(F.col(f"`{side[0]}_{col}`").alias(alias))
    used = {"left": {a for a, _ in pairs}, "right": {b for _, b in pairs}}
    for side, col, _ in spec.columns:
        used[side].add(col)
    left, right = (sides[s][1].select(*(F.col(f"`{c}`") for c in sorted(used[s]))) for s in ("left", "right"))
    if by is None or spec.band is None:
        rows = J.join(left, right, spec.on, spec.band, spec.how).select(*shown)
        rest = [alias for _, _, alias in spec.columns if alias not in (by or ())]
        return rows if by is None else rows.groupBy(*by).agg(F.count(F.lit(1)).alias("joined"), *(F.count(c).alias(f"n_{c}") for c in rest))
    name = {alias: f"{side[0]}_{col}" for side, col, alias in spec.columns}
    rest = [alias for alias in name if alias not in by]
    found = J.counts(left, right, spec.on, spec.band, spec.how, tuple(dict.fromkeys(name[c] for c in by)), tuple(dict.fromkeys(name[c] for c in rest)))
    return found.select(*(F.col(f"`{name[c]}`").alias(c) for c in by), "joined", *(F.col(f"`{name[c]}`").alias(f"n_{c}") for c in rest))


def build(rels: dict[str, DataFrame], spec: BuilderSpec) -> DataFrame:
    """A validated spec -> DataFrame (raises ``ValueError`` on bad specs)."""
    cat = catalog(rels)
    if spec.relation not in cat:
        raise ValueError(f"unknown relation {spec.relation!r}")
    meta = cat[spec.relation]
    cols = meta["columns"]

    def check(col: str, what: str) -> dict:
        if col not in cols:
            raise ValueError(f"unknown column {col!r} in {what}")
        return cols[col]

    df = _filtered(rels[spec.relation], cols, spec.filters)
    selected = list(spec.columns) or list(meta["default_columns"])
    for c in selected:
        check(c, "select")
    aggs = []
    for a in spec.aggregates:
        func = a.func.upper()
        if func == "COUNT":
            expr = F.count(F.lit(1))  # COUNT is always count(*)
        else:
            m = check(a.column or "", "aggregate")
            if func not in m["aggregates"]:
                raise ValueError(f"aggregate {func} not allowed on {m['type']} column {a.column!r}")
            expr = {"AVG": F.avg, "MIN": F.min, "MAX": F.max, "SUM": F.sum}[func](F.col(f"`{a.column}`"))
        aggs.append(expr.alias(_alias_of(a)))
    if aggs:
        keys = list(spec.group_by) or selected
        for c in keys:
            if not check(c, "group by")["groupable"]:
                raise ValueError(f"column {c!r} is not groupable")
        names = [_alias_of(a) for a in spec.aggregates]
        df = df.groupBy(*[F.col(f"`{c}`") for c in keys]).agg(*aggs) \
            .select(*[F.col(f"`{c}`") for c in selected + names])
    elif spec.group_by:
        df = df.groupBy(*[F.col(f"`{c}`") for c in spec.group_by]).agg(F.count(F.lit(1)).alias("_n")) \
            .select(*[F.col(f"`{c}`") for c in selected])
    else:
        df = df.select(*[F.col(f"`{c}`") for c in selected])
    if spec.sort:
        order = []
        grouped = bool(aggs or spec.group_by)
        for s in spec.sort:
            if s.column not in df.columns and (grouped or s.column not in cols):
                raise ValueError(f"unknown column {s.column!r} in sort")
            if s.column in cols and not cols[s.column]["sortable"]:
                raise ValueError(f"column {s.column!r} is not sortable")
            c = F.col(f"`{s.column}`")
            order.append(c.desc_nulls_first() if s.direction.lower() == "desc" else c.asc_nulls_last())
        df = df.orderBy(*order)
    if spec.limit is None:
        return df
    if not 0 < spec.limit <= meta["max_limit"]:
        raise ValueError(f"limit {spec.limit} is not between 1 and {meta['max_limit']}")
    return df.limit(spec.limit)


def _alias_of(a: Aggregate) -> str:
    func = a.func.lower()
    return (a.alias or "").strip() or (f"{func}_{a.column}" if a.column else func)


# --------------------------------------------------------------- G3 / G4
# Statements over {s} = daily_camera_summary, {d} = dim_devices, {e} = events.
# Dates are moved into the test data's range; top-k lists get a tiebreak.
EXAMPLES = {
    "ex_daily_rollups": """select date, camera_name, unique_event_groups, avg_temperature, avg_lux from {s}
        order by date desc nulls first, camera_name asc limit 30""",
    "ex_recent_events": """select `timestamp`, camera_name, event, subject_category, analysis_title, id from {e}
        order by `timestamp` desc nulls first, id asc limit 50""",
    "ex_top_cameras": """select camera_name, sum(unique_event_groups) as total_event_groups from {s}
        group by camera_name order by total_event_groups desc nulls first, camera_name asc limit 10""",
    "ex_category_counts": """select subject_category, count(*) as event_count from {e}
        where subject_category is not null group by subject_category
        order by event_count desc nulls first, subject_category asc limit 20""",
    "ex_avg_voltage": """select camera_name,
          cast(round(cast(round(avg(voltage), 10) as decimal(38, 10)), 2) as double) as avg_voltage from {e}
        where voltage is not null group by camera_name
        order by avg_voltage desc nulls first, camera_name asc limit 20""",
    "ex_alias_diff": """select d.camera_name, s.total_rows, s.unique_event_groups,
          s.total_rows - s.unique_event_groups as diff, s.date
        from {s} s join {d} d on d.mac = s.mac
        where s.date >= '2024-01-18' and s.date <= '2024-01-30'
        order by diff desc nulls first, s.date asc, d.camera_name asc limit 20""",
    "ex_aggregate_alias": """select d.camera_name, sum(s.unique_event_groups) as total_event_groups
        from {s} s join {d} d on d.mac = s.mac
        where s.date >= date '2024-01-31' - interval '30 days'
        group by d.camera_name order by total_event_groups desc nulls first, d.camera_name limit 10""",
    "ex_repeated_expression": """select d.camera_name, s.total_rows, s.unique_event_groups,
          s.total_rows - s.unique_event_groups as diff, s.date
        from {s} s join {d} d on d.mac = s.mac
        order by s.total_rows - s.unique_event_groups desc nulls first, s.date asc, d.camera_name asc limit 20""",
    "ex_ordinal": """select d.camera_name, sum(s.unique_event_groups) as total_event_groups
        from {s} s join {d} d on d.mac = s.mac group by d.camera_name order by 2 desc nulls first, 1 limit 10""",
    "ex_select_star": """select * from {e} order by `timestamp` desc nulls first, id asc limit 10""",
    "ex_ratio": """select camera_name, date, cast(wildlife_rows as double) / nullif(total_rows, 0) as wildlife_ratio
        from {s} order by wildlife_ratio desc nulls first, date asc nulls last, camera_name asc limit 20""",
    "ex_case_band": """select camera_name, date, case when coalesce(avg_lux, 0) < 20 then 'dark' else 'bright' end
          as light_band from {s} order by light_band asc, date asc nulls last, camera_name asc limit 20""",
    "ex_with_union": """with busy as (select camera_name, sum(total_rows) as n from {s} group by camera_name),
          quiet as (select camera_name, sum(total_rows) as n from {s} where night_rows > 0 group by camera_name)
        select 'all' as slice, camera_name, n from busy
        union all select 'night', camera_name, n from quiet
        union select 'all', camera_name, n from busy""",
}


def run_example(spark: SparkSession, rels: dict[str, DataFrame], key: str) -> DataFrame:
    return spark.sql(EXAMPLES[key], s=rels["daily_camera_summary"], d=rels["dim_devices"], e=rels["events"])
