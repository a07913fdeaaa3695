"""Dashboard filter (F1-F8) as an immutable value turned into one ``Column``.

Predicates are expressed over canonical columns.  Those on stored columns
(``mac``, raw ``lux``/``temperature``) reach the parquet scan as pushed
filters; those on derived columns are evaluated right after the projection,
inside the same codegen stage.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, fields

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import constants as K


@dataclass(frozen=True)
class Filters:
    camera_name: tuple[str, ...] = ()
    mac: tuple[str, ...] = ()
    start_date: str | None = None
    end_date: str | None = None
    time_of_day_bucket: tuple[str, ...] = ()
    subject_category: tuple[str, ...] = ()
    subject_class: tuple[str, ...] = ()
    q: str | None = None
    min_lux: float | None = None
    max_lux: float | None = None
    min_temperature: float | None = None
    max_temperature: float | None = None
    min_heat_level: float | None = None
    max_heat_level: float | None = None

    def on_cells(self) -> bool:
        """Whether the filter only looks at values that the group cells keep."""
        bounds = (self.min_lux, self.max_lux, self.min_temperature, self.max_temperature, self.min_heat_level, self.max_heat_level)
        return not self.q and all(x is None for x in bounds)

    def narrows(self) -> bool:
        """Whether any filter is set."""
        return any(getattr(self, f.name) != f.default for f in fields(Filters))

    def predicate(self) -> Column:
        conds: list[Column] = []
        if self.camera_name:
            conds.append(F.col("camera_name").isin(list(self.camera_name)))
        if self.mac:
            conds.append(F.col("mac").isin(list(self.mac)))
        if self.start_date:
            conds.append(F.col("event_date") >= F.lit(dt.date.fromisoformat(self.start_date)))
        if self.end_date:
            conds.append(F.col("event_date") <= F.lit(dt.date.fromisoformat(self.end_date)))
        if self.time_of_day_bucket:
            conds.append(F.col("time_of_day_bucket").isin(list(self.time_of_day_bucket)))
        if self.subject_category:
            # The un-defaulted category: 'unknown' only matches a stored 'unknown'.
            conds.append(F.col("category").isin(list(self.subject_category)))
        if self.subject_class:
            conds.append(F.col("subject_class").isin(list(self.subject_class)))
        if self.q:
            pattern = f"%{self.q}%"
            conds.append(F.coalesce(F.col("analysis_title"), F.lit("")).ilike(pattern)
                         | F.coalesce(F.col("analysis_summary"), F.lit("")).ilike(pattern))
        bounds = [("raw_lux", self.min_lux, self.max_lux),
                  ("raw_temperature", self.min_temperature, self.max_temperature),
                  ("heat_level", self.min_heat_level, self.max_heat_level)]
        for name, lo, hi in bounds:
            if lo is not None:
                conds.append(F.col(name) >= F.lit(lo))
            if hi is not None:
                conds.append(F.col(name) <= F.lit(hi))
        out = F.lit(True)
        for c in conds:
            out = out & c
        return out


@dataclass(frozen=True)
class EventQuery(Filters):
    page: int = 1
    page_size: int = K.EVENT_PAGE_SIZE
    sort_by: str = "timestamp"
    sort_dir: str = "desc"

    def __post_init__(self):
        if self.page < 1:
            raise ValueError("page must be >= 1")
        if not 1 <= self.page_size <= K.EVENT_PAGE_MAX:
            raise ValueError(f"page_size must be within 1..{K.EVENT_PAGE_MAX}")
        if self.sort_by not in SORT_KEYS:
            raise ValueError(f"unknown sort_by {self.sort_by!r}")
        if self.sort_dir not in ("asc", "desc"):
            raise ValueError("sort_dir must be asc or desc")


# Sort key -> canonical column (lux and temperature sort on raw values).
SORT_KEYS = {
    "timestamp": "local_timestamp",
    "camera_name": "camera_name",
    "event": "event_group",
    "sequence": "sequence",
    "subject_class": "subject_class",
    "subject_category": "category",
    "lux": "raw_lux",
    "temperature": "raw_temperature",
    "heat_level": "heat_level",
}
