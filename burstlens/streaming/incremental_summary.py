"""Incremental daily summary: new raw event files -> event store -> summary.

The batch job rebuilds the whole daily summary.  This Structured Streaming
job does the same work incrementally: each micro-batch of newly landed raw
event files is merged into the event store (insert-if-absent by id, which also
drops repeats; no watermark, so a camera's late backlog is kept however old it
is), and the summary is recomputed for just the days that got new rows.  A
micro-batch reads the id buckets its ids fall into and the folders of those
days, nothing else.

A micro-batch is a delivery named by its epoch.  Replaying one after a failure
is harmless: its folders are overwritten with the same rows, and the summary's
date partitions with the same values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.summary import daily_camera_summary
from ..sources import store
from ..sources.sinks import write_daily_summary


def summary_batch_writer(events_root: str, summary_path: str):
    """``foreachBatch`` body: merge the batch into the store, refresh touched days."""
    def write(batch: DataFrame, epoch_id: int) -> None:
        batch = batch.persist()  # one delivery, read for its buckets and for its rows
        try:
            days = store.merge(batch, events_root, "_order", f"epoch-{epoch_id}")
            if days:
                schema = batch.drop("_order").schema
                write_daily_summary(daily_camera_summary(store.of_days(batch.sparkSession, events_root, schema, days)), summary_path)
        finally:
            batch.unpersist()
    return write


def start_incremental_summary(spark: SparkSession, source_dir: str, events_root: str, summary_path: str,
                              checkpoint: str, schema, available_now: bool = True) -> StreamingQuery:
    """Stream raw event parquet files from ``source_dir`` into the event store
    and the daily summary.  ``checkpoint`` must be on shared storage."""
    stream = spark.readStream.schema(schema).parquet(source_dir).withColumn("_order", F.col("utc_timestamp"))
    writer = (stream.writeStream.foreachBatch(summary_batch_writer(events_root, summary_path))
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
