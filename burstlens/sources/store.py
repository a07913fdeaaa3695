"""Event store with an id index: insert-if-absent that reads little.

* ``events``: one folder a (day of the local clock, delivery), so what a delivery
  touches is a few days' folders and readers of a day prune all others.
* ``ids``: the ids seen, one folder a (hash bucket, delivery).  The existing-id
  test of a delivery reads only the buckets its ids fall into, and only the id
  column, never events.

A delivery has a name, and its folders are overwritten when it comes again under
that name; its own index entries do not count as seen then.  So a delivery that
failed half-way, or is replayed, ends in the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ingest import first_by_id
from .staging import statuses

BUCKETS = 64
IDS = "id string, bucket int, delivery string"


def day_of(events: DataFrame):
    return F.to_date(F.col("`timestamp`"))


def _exists(spark: SparkSession, path: str) -> bool:
    return bool(statuses(spark, path, pattern=True))


def bucket(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("int")


def seen(spark: SparkSession, root: str, buckets: list[int], delivery: str) -> DataFrame:
    """(id) already held in these buckets by other deliveries."""
    if not _exists(spark, f"{root}/ids"):
        return spark.createDataFrame([], "id string")
    index = spark.read.schema(IDS).parquet(f"{root}/ids")
    return index.filter(F.col("bucket").isin(buckets) & (F.col("delivery") != delivery)).select("id")


def merge(incoming: DataFrame, root: str, order_col: str, delivery: str) -> list:
    """Insert the rows of a delivery whose id is new (first per id by
    ``order_col``, rows without an id are left out) and return the days that
    got rows.  Days and buckets of one delivery are short lists."""
    spark = incoming.sparkSession
    first = first_by_id(incoming, order_col)
    touched = sorted(r[0] for r in incoming.filter("id is not null").select(bucket("id").alias("b")).distinct().collect())
    new = first.join(seen(spark, root, touched, delivery), "id", "left_anti").select(*first.columns)
    stamp = F.lit(delivery).alias("delivery")
    (new.select("*", day_of(new).alias("day"), stamp).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("day", "delivery").parquet(f"{root}/events"))
    added = of_delivery(spark, root, incoming.drop(order_col).schema, delivery)
    (added.select("id", bucket("id").alias("bucket"), stamp).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "delivery").parquet(f"{root}/ids"))
    return [r[0] for r in added.select("day").distinct().collect()]


def _typed(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("day", T.DateType()), T.StructField("delivery", T.StringType())])


def of_delivery(spark: SparkSession, root: str, schema: T.StructType, delivery: str) -> DataFrame:
    return spark.read.schema(_typed(schema)).parquet(f"{root}/events").filter(F.col("delivery") == delivery)


def of_days(spark: SparkSession, root: str, schema: T.StructType, days: list) -> DataFrame:
    """The events of some days; the other folders are not read."""
    day = F.col("day")
    wanted = day.isin([d for d in days if d is not None])
    if None in days:
        wanted = wanted | day.isNull()
    return spark.read.schema(_typed(schema)).parquet(f"{root}/events").filter(wanted).drop("day", "delivery")
