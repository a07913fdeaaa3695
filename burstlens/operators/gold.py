"""Gold tables: mergeable event-group states, the daily combination table and
the group-number cells that answer exact distinct counts on any slice.

* **Group states** hold what an event group's roll-up needs in a form that can
  be merged: minima and maxima, sum and count pairs, flag counts.  They are kept
  a (date, group), so new events touch only the dates they fall on; the merged
  state of a group gives its roll-up without reading events again.
* **Combinations** count groups by (date, camera, category, hour) with the
  running total of each combination, and a small table a date.  The lab's
  windows read the dates they cover; totals over all history are the last
  running totals.
* **Cells** hold, for every combination of filter values, the numbers of the
  groups seen there.  Groups are numbered once, in order of date and camera, so
  a cell's numbers fall into few 32 768-bit buckets.  A bucket with few numbers
  keeps them as an array, a fuller one as a bitmap; a distinct count on a slice
  is a bitwise or of its cells, whatever the slice, and shuffles bitmaps of
  (report key, bucket), never events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K

MEANS = ("upload_lag_seconds", "ai_lag_seconds", "processing_lag_seconds", "voltage", "temperature", "heat_level", "lux")
FLAGS = {"ai_processed": "ai_processed", "json_processed": "json_processed", "uploaded": "uploaded", "low_light": "low_light_flag"}
LEAST = ("camera_name", "mac", "subject_category", "category", "subject_class")
DIMS = ("event_date", "hour", "camera_name", "mac", "time_of_day_bucket", "category", "subject_class")
SPARSE = 512  # numbers of a bucket from which its bitmap (4 KB) is the smaller form


# ------------------------------------------------------------- group states
def group_states(canon: DataFrame, *keys: str) -> DataFrame:
    """One mergeable state a (event group, *keys)."""
    flag = {n: F.count_if(F.coalesce(F.col(c), F.lit(False))) for n, c in FLAGS.items()}
    return canon.groupBy("event_group", *keys).agg(
        *(F.min(c).alias(f"min_{c}") for c in LEAST),
        F.min("local_timestamp").alias("first_seen"), F.max("local_timestamp").alias("last_seen"),
        F.count(F.lit(1)).alias("n"),
        *(F.sum(F.col(c).cast("double")).alias(f"sum_{c}") for c in MEANS),
        *(F.count(c).alias(f"n_{c}") for c in MEANS),
        *(e.alias(f"flag_{n}") for n, e in flag.items()),
        F.count_if(F.col("suspicious_numeric_flag")).alias("suspicious"),
    )


def merged(states: DataFrame, *keys: str) -> DataFrame:
    """States of the same (event group, *keys) as one state."""
    added = ("n", *(f"{p}_{c}" for c in MEANS for p in ("sum", "n")), *(f"flag_{n}" for n in FLAGS), "suspicious")
    out = states.groupBy("event_group", *keys).agg(
        *(F.min(f"min_{c}").alias(f"min_{c}") for c in LEAST),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        *(F.sum(c).alias(c) for c in added))
    return out.select(*states.columns) if set(out.columns) == set(states.columns) else out


def ingest(path: str, canon: DataFrame) -> None:
    """Merge new canonical events into the states table at ``path``: only the
    dates they fall on are read and written again.  Rows are merged as given,
    so insert-if-absent must have dropped repeated ids before."""
    spark = canon.sparkSession
    new = group_states(canon, "event_date")
    old = spark.read.parquet(path)
    # the observed dates of one delivery, a calendar-bounded list
    days = [r[0] for r in canon.select("event_date").distinct().collect()]
    touched = F.col("event_date").isin([x for x in days if x is not None])
    if None in days:
        touched = touched | F.col("event_date").isNull()
    both = old.filter(touched).unionByName(new)
    (merged(both, "event_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("event_date").parquet(path))


def event_groups(states: DataFrame) -> DataFrame:
    """A2 from one state a group."""
    c = F.col
    return states.select(
        "event_group", c("min_camera_name").alias("camera_name"), c("min_mac").alias("mac"), "first_seen", "last_seen",
        c("min_subject_category").alias("subject_category"), c("min_subject_class").alias("subject_class"),
        c("n").cast("int").alias("event_group_size"),
        *((c(f"sum_{m}") / F.nullif(c(f"n_{m}"), F.lit(0))).alias(f"avg_{m}") for m in MEANS),
        *((c(f"flag_{n}") > 0).alias(f"{n}_any") for n in FLAGS),
        c("suspicious").cast("int").alias("suspicious_numeric_count"))


def group_sizes(states: DataFrame) -> DataFrame:
    return states.select("event_group", F.col("n").cast("int").alias("event_group_size"))


def kpi_groups(states: DataFrame) -> DataFrame:
    """Groups for the headline KPIs, category without the 'unknown' default."""
    c = F.col
    return states.select("event_group", c("min_camera_name").alias("camera_name"), c("min_category").alias("subject_category"),
                         c("min_subject_class").alias("subject_class"), "first_seen", c("n").alias("row_count"))


# ------------------------------------------------------------- combinations
def combinations(groups: DataFrame) -> DataFrame:
    """(date, camera_name, category, hour, count, total): groups of the
    combination on the date, and on all dates up to it."""
    daily = (groups.groupBy(F.to_date("first_seen").alias("date"), "camera_name", F.col("subject_category").alias("category"),
                            F.hour("first_seen").alias("hour")).agg(F.count(F.lit(1)).alias("count")))
    running = Window.partitionBy("camera_name", "category", "hour").orderBy("date")  # a row a date
    return daily.withColumn("total", F.sum("count").over(running))


# ------------------------------------------------------------- cells
def cells(canon: DataFrame, numbers: DataFrame) -> DataFrame:
    """(*DIMS, bucket, rows, places, bits): rows counts events; the groups seen
    are ``places`` in the bucket while they are few, else the bitmap ``bits``.
    ``numbers``: (event_group, number).  Events without a group have no bucket."""
    once = canon.groupBy(*DIMS, "event_group").agg(F.count(F.lit(1)).alias("rows"))
    seen = once.join(numbers, "event_group", "left")
    place = F.bitmap_bit_position("number")
    # at most 32 768 places a bucket
    made = seen.groupBy(*DIMS, F.bitmap_bucket_number("number").alias("bucket")).agg(
        F.sum("rows").alias("rows"), F.sort_array(F.collect_list(place)).alias("places"), F.bitmap_construct_agg(place).alias("bits"))
    few = F.size("places") < SPARSE
    return made.select(*DIMS, "bucket", "rows", F.when(few, F.col("places")).alias("places"), F.when(~few, F.col("bits")).alias("bits"))


def distinct_groups(slice_: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Distinct groups and events of the cells of a slice, by report keys."""
    own = slice_.select(*(c.alias(k) for k, c in keys.items()), "bucket", "rows", "places", "bits")
    names = list(keys)
    few = (own.select(*names, "bucket", F.explode("places").alias("place")).groupBy(*names, "bucket")
           .agg(F.bitmap_construct_agg("place").alias("bits")).withColumn("rows", F.lit(0).cast("long")))
    many = own.filter(F.col("bits").isNotNull()).select(*names, "bucket", "bits", F.lit(0).cast("long").alias("rows"))
    events = own.groupBy(*names).agg(F.sum("rows").alias("rows")).select(
        *names, F.lit(None).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("bits"), "rows")
    ored = few.select(*names, "bucket", "bits", "rows").unionAll(many).unionAll(events).groupBy(*names, "bucket").agg(
        F.bitmap_or_agg("bits").alias("bits"), F.sum("rows").alias("rows"))
    return ored.groupBy(*names).agg(F.sum(F.bitmap_count("bits")).alias("unique_event_groups"), F.sum("rows").alias("raw_rows"))


def _by_category(slice_: DataFrame, name: str, key: Column) -> DataFrame:
    """Distinct groups in each main category within a key."""
    main = F.when(F.col("category").isin(*K.MAIN_CATEGORIES), F.col("category"))
    counted = distinct_groups(slice_, {name: key, "_c": main})
    return counted.groupBy(name).agg(*(F.coalesce(F.sum(F.when(F.col("_c") == c, F.col("unique_event_groups"))), F.lit(0)).alias(c)
                                       for c in K.MAIN_CATEGORIES))


def daily_activity(slice_: DataFrame) -> DataFrame:
    return distinct_groups(slice_, {"date": F.col("event_date"), "camera_name": F.col("camera_name")}).orderBy("date", "camera_name")


def hourly_heatmap(slice_: DataFrame) -> DataFrame:
    return distinct_groups(slice_, {"camera_name": F.col("camera_name"), "hour": F.col("hour")}).orderBy("camera_name", "hour")


def time_of_day_composition(slice_: DataFrame) -> DataFrame:
    order = F.when(F.col("bucket") == "morning", 1).when(F.col("bucket") == "afternoon", 2).when(F.col("bucket") == "evening", 3).otherwise(4)
    return _by_category(slice_, "day_part", F.col("time_of_day_bucket")).withColumnRenamed("day_part", "bucket").orderBy(order, "bucket")


def monthly_activity(slice_: DataFrame) -> DataFrame:
    return _by_category(slice_, "month", F.date_format("event_date", K.MONTH_FORMAT)).orderBy("month")


def subject_by_camera(slice_: DataFrame) -> DataFrame:
    return distinct_groups(slice_.filter(F.col("subject_class").isNotNull()), {
        "camera_name": F.col("camera_name"), "subject_class": F.col("subject_class")}).drop("raw_rows").orderBy("camera_name", "subject_class")


def composition(slice_: DataFrame) -> DataFrame:
    return distinct_groups(slice_, {"category": F.coalesce("category", F.lit(K.UNKNOWN_CATEGORY))}).drop("raw_rows").orderBy(
        F.col("unique_event_groups").desc(), "category")


REPORTS = {f.__name__: f for f in (daily_activity, hourly_heatmap, time_of_day_composition, monthly_activity, subject_by_camera, composition)}
