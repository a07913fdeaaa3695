"""Incremental summary stream equals the batch rebuild."""

import os

from conftest import SMALL

from burstlens.operators import summary as SM
from burstlens.sources import staging
from burstlens.streaming.incremental_summary import start_incremental_summary


def test_available_now_stream_equals_batch(spark, scratch):
    raw = staging.raw_table(spark, SMALL)
    src = os.path.join(scratch, "landing")
    first = raw.filter("utc_timestamp < timestamp '2024-01-16 00:00:00'")
    second = raw.filter("utc_timestamp >= timestamp '2024-01-16 00:00:00'")
    first.write.parquet(os.path.join(src, "part1"))
    events, summary, ckpt = (os.path.join(scratch, n) for n in ("events", "summary", "ckpt"))
    q = start_incremental_summary(spark, os.path.join(src, "*"), events, summary, ckpt, raw.schema)
    q.awaitTermination()
    second.write.parquet(os.path.join(src, "part2"))
    # the second file repeats some ids already loaded: they must be ignored
    raw.limit(20).write.parquet(os.path.join(src, "part3"))
    q = start_incremental_summary(spark, os.path.join(src, "*"), events, summary, ckpt, raw.schema)
    q.awaitTermination()
    assert spark.read.parquet(f"{events}/events").count() == raw.count()
    got = spark.read.parquet(summary)
    exp = SM.daily_camera_summary(raw)
    cols = [c for c in exp.columns]
    assert got.select(*cols).exceptAll(exp.select(*cols)).count() == 0
    assert exp.select(*cols).exceptAll(got.select(*cols)).count() == 0


def test_late_rows_are_kept(spark, scratch):
    raw = staging.raw_table(spark, SMALL)
    src = os.path.join(scratch, "landing")
    events, summary, ckpt = (os.path.join(scratch, n) for n in ("events", "summary", "ckpt"))
    late = "utc_timestamp < timestamp '2024-01-10 00:00:00'"
    for part, rows in (("new", raw.filter(f"not ({late})")), ("old", raw.filter(late))):
        rows.write.parquet(os.path.join(src, part))
        start_incremental_summary(spark, os.path.join(src, "*"), events, summary, ckpt, raw.schema).awaitTermination()
    assert spark.read.parquet(f"{events}/events").count() == raw.count()


def test_store_merge_reads_touched_buckets_and_days(spark, scratch):
    from pyspark.sql import functions as F

    from burstlens.sources import store
    raw = staging.raw_table(spark, SMALL).withColumn("_order", F.col("utc_timestamp"))
    schema = raw.drop("_order").schema
    old = raw.filter("utc_timestamp < timestamp '2024-01-16 00:00:00'")
    store.merge(old, scratch, "_order", "one")
    few = raw.filter("utc_timestamp >= timestamp '2024-01-30 00:00:00'").limit(5).unionAll(old.limit(5)).persist()
    buckets = [r[0] for r in few.select(store.bucket("id")).distinct().collect()]
    text = store.seen(spark, scratch, buckets, "two")._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001
    assert "PartitionFilters" in text and "bucket#" in text.split("PartitionFilters: ")[1].split("]")[0] and "struct<id:string>" in text
    days = store.merge(few, scratch, "_order", "two")
    n = spark.read.parquet(f"{scratch}/events").count()
    assert n == old.count() + 5 and len(days) <= 2
    text = store.of_days(spark, scratch, schema, days)._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001
    assert "day#" in text.split("PartitionFilters: ")[1].split("]")[0]
    # the same delivery again, and one that died after its events were written
    assert store.merge(few, scratch, "_order", "two") == days
    few.select("*").drop("_order").limit(3).withColumn("day", F.lit(None).cast("date")).withColumn("delivery", F.lit("three")) \
        .write.mode("append").partitionBy("day", "delivery").parquet(f"{scratch}/events")
    store.merge(raw, scratch, "_order", "three")
    held = spark.read.parquet(f"{scratch}/events")
    assert spark.read.parquet(f"{scratch}/ids").select("id").distinct().count() == raw.count()
    assert held.filter("delivery <> 'three' or day is not null").select("id").distinct().count() >= raw.filter("`timestamp` is not null").count()
    few.unpersist()
