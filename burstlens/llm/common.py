"""Shared pieces: staging in the cluster's shared folder, Arrow text access."""

from __future__ import annotations

import contextlib
import gc
import math
import time
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exactly (doc_id long, text string); whatever else the frame has is left behind."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared checkpoint folder
    (``spark.checkpoint.dir``) and read it back.  Survives executor loss."""
    from ..sources.staging import shared_dir

    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{uuid.uuid4().hex}/{tag}"
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.__dict__["staged"] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove tables made by ``stage`` that nothing will read again."""
    for table in tables:
        spark = table.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(table.__dict__["staged"]).getParent()  # noqa: SLF001
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)  # noqa: SLF001


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of finished, unreferenced jobs
    now instead of at the driver's next garbage collection.  The second round
    finds what the first one's clean-up let go of."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()  # noqa: SLF001
        time.sleep(0.4)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---- inside tasks -------------------------------------------------------------------------------


def trimmed(run):
    """``run`` for mapInArrow, after which the worker, which waits for other
    tasks, hands freed memory back to the system."""
    def wrapped(batches):
        import ctypes

        import pyarrow as pa

        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # a C library without it
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def utf8(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary column; null counts as empty."""
    import pyarrow as pa

    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    kind = np.int64 if wide else np.int32
    _, off, data = col.buffers()
    if len(col) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offsets = np.frombuffer(off, kind, len(col) + 1, col.offset * kind().itemsize).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int):
    """(from, to) row ranges of at most ``limit`` bytes each, one row at least."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def ids(col) -> list:
    return col.to_pylist()


def whole(x: float, scale: int) -> int:
    """floor(scale * x), also where the product is no finite double."""
    return int(x) * scale if abs(x) >= 2.0 ** 53 else math.floor(x * scale)
