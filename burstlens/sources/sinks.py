"""Sinks: daily summary table (S7), event CSV export (S8), query CSV.

CSV results are part files in row order, each with its own header line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_daily_summary(summary: DataFrame, path: str) -> None:
    """Replace only the dates present in ``summary`` (dynamic partition overwrite)."""
    (summary.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("date").parquet(path))


def write_events_csv(rows: DataFrame, path: str) -> None:
    """Every cell quoted, quotes doubled, nulls as empty quoted cells.

    Spark also quotes the header line (the specification leaves it bare).
    """
    text = rows.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in rows.columns])
    (text.write.mode("overwrite").option("header", True).option("quoteAll", True)
     .option("escape", '"').option("emptyValue", '""').csv(path))


def write_query_csv(result: DataFrame, path: str) -> None:
    """Quote only when needed; nested values JSON-encoded."""
    cols = []
    for f in result.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            c = F.to_json(c)
        cols.append(c.alias(f.name))
    (result.select(*cols).write.mode("overwrite").option("header", True)
     .option("escape", '"').csv(path))
