"""Deep explorer pages by an order-statistic index.

The index holds (sort value, id, date) of every event once for each sort form
(nine keys, two directions), in the order of the form, cut into ranges with a
count each.  A page at any offset is found from the counts, so it opens the one
or two ranges that hold it and the dates its rows fall on; no task sorts or
keeps the rows before it.  All forms are one range sort: a form fills one of
the value columns and leaves the others null, and a value that a third of all
rows share is split by id like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import explorer as X
from .filters import SORT_KEYS, EventQuery

FORMS = tuple(f"{k}_{d}" for k in SORT_KEYS for d in ("asc", "desc"))
KINDS = ("time", "text", "number")
ROW_BITS = 33  # low bits of monotonically_increasing_id: the row in its range


def _kind(dt: T.DataType) -> str:
    return "time" if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)) else "text" if isinstance(dt, T.StringType) else "number"


def index(canon: DataFrame, parts: int, forms: tuple[str, ...] = FORMS) -> DataFrame:
    """(form, part, n, id, event_date): ``n`` ascends in the order of the form.
    Its numbers belong to one run: write it, and read counts and pages from that."""
    entries = []
    for form in forms:
        key, way = form.rsplit("_", 1)
        kind = _kind(canon.schema[SORT_KEYS[key]].dataType)
        value = F.col(SORT_KEYS[key]).cast("double") if kind == "number" else F.col(SORT_KEYS[key])
        none = {"time": F.lit(None).cast("timestamp_ntz"), "text": F.lit(None).cast("string"), "number": F.lit(None).cast("double")}
        cells = {f"{w}_{k}": value if (w, k) == (way, kind) else none[k] for w in ("asc", "desc") for k in KINDS}
        entries.append(F.struct(F.lit(form).alias("form"), *(c.alias(n) for n, c in cells.items())))
    rows = canon.select("id", "event_date", F.inline(F.array(*entries)))
    order = [F.col("form"), *(X._pg_order(f"{w}_{k}", w) for w in ("asc", "desc") for k in KINDS), F.col("id").asc()]
    return (rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
            .select("form", F.monotonically_increasing_id().alias("n"), "id", "event_date")
            .withColumn("part", F.shiftright("n", ROW_BITS)))


def starts(indexed: DataFrame) -> DataFrame:
    """One row a range: (form, part, first, rows, start), ``start`` being the
    offset of its first row in the form."""
    ranges = indexed.groupBy("form", "part").agg(F.min("n").alias("first"), F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("form").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    return ranges.withColumn("start", F.coalesce(F.sum("rows").over(before), F.lit(0)))


def page_keys(indexed: DataFrame, ranges: DataFrame, query: EventQuery) -> DataFrame:
    """(id, event_date) of the page's rows."""
    form, offset = f"{query.sort_by}_{query.sort_dir}", (query.page - 1) * query.page_size
    c = F.col
    held = ranges.filter((c("form") == form) & (c("start") < offset + query.page_size) & (c("start") + c("rows") > offset))
    span = held.agg(F.struct(
        F.min(c("first") + F.greatest(F.lit(offset) - c("start"), F.lit(0))).alias("low"),
        F.max(c("first") + F.least(c("rows"), F.lit(offset + query.page_size) - c("start")) - 1).alias("high"),
        F.min("part").alias("from"), F.max("part").alias("to"))).scalar()
    return indexed.filter((c("form") == form) & c("part").between(span.getField("from"), span.getField("to"))
                          & c("n").between(span.getField("low"), span.getField("high"))).select("id", "event_date")


def events_page_at(canon: DataFrame, indexed: DataFrame, ranges: DataFrame, query: EventQuery, sizes: DataFrame) -> DataFrame:
    """K1 without filters, at any depth.  Ids are unique, as the event store
    keeps them; a page beyond the last row is empty."""
    if query.narrows():
        raise ValueError("the index covers all events; filtered pages go on from the last one (events_page_after)")
    found = page_keys(indexed, ranges, query).agg(F.struct(
        F.collect_list("id").alias("ids"), F.collect_set("event_date").alias("dates"))).scalar()  # at most a page
    on_dates = F.array_contains(found.getField("dates"), F.col("event_date")) | F.col("event_date").isNull()
    rows = canon.filter(on_dates & F.array_contains(found.getField("ids"), F.col("id")))
    return X.event_records(X._sized(rows, canon, sizes), "category")
