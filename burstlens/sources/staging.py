"""Canonical ("silver") event table, written once and read by every report.

Canonicalisation is a wide projection whose cost (JSON parse, keyword ladder,
range checks) and analysis time would otherwise be paid by every report.  The
staging job runs it once over the time-clustered bronze table, without a
shuffle, and writes parquet partitioned by ``event_date`` (sorted by camera
inside).  Reports then prune columns at the scan and date predicates prune
whole folders.

The raw (bronze) ``events`` table is staged the same way: it is what the
ingest job loads, and reports over stored columns (daily summary, exports,
workspace relations) read it instead of re-deriving rows per query.

The tables live under the cluster's shared ``spark.checkpoint.dir``; their
location is keyed by the source path, the version of its files (names, lengths,
modification times) and a digest of the rule code with its constants, so a
changed source or rule is never served from an older table.  Every write goes to
a folder of its own below that location and counts once the committer's
``_SUCCESS`` file is there; the newest complete one is read.  So builders in two
processes never overwrite each other, a refresh leaves readers of the older
version alone, and an unfinished write is simply redone.  Older versions are
left for the owner of the folder to remove.
"""

from __future__ import annotations

import contextlib
import hashlib
import inspect
import math
import sys
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants, normalize
from ..operators import canonical as C
from ..operators import gold as G
from ..operators import paging as P
from ..operators import search as S
from . import adapter, json_array

_MEMO: dict[tuple, tuple[SparkSession, DataFrame]] = {}
# One builder at a time per process: concurrent first calls must not write
# the same table twice.
_LOCK = threading.RLock()
# FIXED VALUES: keys of one raw export record, in export order.
EXPORT_KEYS = (
    "name", "mac", "utc_timestamp", "sequence", "sensor", "location", "filename", "fileType", "id",
    "timestamp", "utc_timestamp_off", "timezone", "event", "tag", "upload", "ai_description", "analysis",
    "ai_processed", "ai_timestamp", "json_processed", "json_timestamp", "image_blob_url", "uploaded",
    "created", "heatLevel", "latitude", "longitude", "temperature", "humidity", "pressure", "bearing",
    "voltage", "batteryPercentage", "lux", "analysis_title", "analysis_summary", "subject_class",
    "subject_category", "time_of_day_bucket", "camera_name",
)
# Source bytes behind one task of the bronze sort, and staged bytes one task reads:
# a row takes 16 to 35 bytes there, but about 1.2 KB as a canonical row in a sort.
TASK_BYTES = 8 << 20
# Settings of the staging writes.  The wide projections make methods beyond 8000
# bytes of code, which the JVM only interprets; Spark then splits them up instead.
WRITING = {"spark.sql.codegen.hugeMethodLimit": "8000", "spark.sql.files.maxPartitionBytes": str(TASK_BYTES)}


def _memo_get(spark: SparkSession, key: tuple) -> DataFrame | None:
    """A staged DataFrame read earlier by this same, still running session."""
    hit = _MEMO.get(key)
    if hit is None or hit[0] is not spark or spark.sparkContext._jsc is None:  # noqa: SLF001
        return None
    return hit[1]


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``), else the context's."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    from ..session import ensure_checkpoint_dir
    return ensure_checkpoint_dir(spark).rstrip("/")


def _digest(*modules) -> str:
    text = "".join(inspect.getsource(m) for m in modules)
    return hashlib.sha1(text.encode()).hexdigest()[:12]


def statuses(spark: SparkSession, path: str, pattern: bool = False) -> list[tuple[str, int, int]]:
    """(path, length, modification time) of the files under ``path``, or of those
    that match it, as any Hadoop file system lists them (no job runs)."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())  # noqa: SLF001
    found = []
    if pattern:
        found = list(fs.globStatus(where) or [])
    else:
        listed = fs.listFiles(where, True)
        while listed.hasNext():
            found.append(listed.next())
    return sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in found)


def source_version(spark: SparkSession, path: str) -> str:
    """Digest of the names, lengths and modification times of the files under ``path``."""
    return hashlib.sha1("\n".join(f"{p} {n} {t}" for p, n, t in statuses(spark, path)).encode()).hexdigest()[:16]


def table_path(spark: SparkSession, sf_dir: str, kind: str = "canonical") -> str:
    this = sys.modules[__name__]  # the layout code is part of the key too
    mods = (adapter, this) if kind == "raw" else (constants, normalize, C, adapter, this)
    if kind.startswith("page"):
        mods = (*mods, P)
    elif kind.startswith("search"):
        mods = (*mods, P, S)
    elif kind not in ("raw", "canonical"):
        mods = (*mods, G, json_array)
    root = sf_dir.rstrip("/")
    key = hashlib.sha1(f"{root}|{source_version(spark, f'{root}/events.parquet')}|{_digest(*mods)}".encode()).hexdigest()[:16]
    return f"{shared_dir(spark)}/burstlens/{kind}/{key}"


def latest(spark: SparkSession, path: str) -> str | None:
    """The newest complete version of a staged table."""
    done = [(t, p) for p, _, t in statuses(spark, f"{path}/*/_SUCCESS", pattern=True)]
    return max(done)[1].rsplit("/", 1)[0] if done else None


def _version(path: str) -> str:
    return f"{path}/{uuid.uuid4().hex}"


@contextlib.contextmanager
def _writing(spark: SparkSession):
    """The settings of a staging write; the session's own come back after it."""
    before = {k: spark.conf.get(k, None) for k in WRITING}
    try:
        for k, v in WRITING.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _parts(spark: SparkSession, source: str, times: int = 1) -> int:
    """Tasks of the bronze sort (``times`` as many for wider tables): by the
    source's bytes, at least one a slot."""
    size = sum(n for _, n, _ in statuses(spark, source))
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism,
               math.ceil(times * size / TASK_BYTES))


def write_canonical(raw: DataFrame, path: str) -> None:
    """Silver write without a shuffle: the bronze table is already clustered
    by capture time, so each task sorts its own split by (date, camera, id)
    and writes one folder per ``event_date``.  No sampling pass (a range
    partitioner would evaluate the whole canonical projection twice) and no
    shuffle for a hot key to skew; date filters prune whole folders."""
    canon = C.canonical(raw)
    (canon.sortWithinPartitions("event_date", "camera_name", "id")
     .write.partitionBy("event_date").parquet(path))


def write_raw(rows: DataFrame, path: str, parts: int, order=("utc_timestamp", "id"), made=lambda rows: rows) -> None:
    """Bronze events table: the loaded raw rows, clustered by capture time and
    id.  ``made`` turns rows into raw ones after they are sampled, shuffled and
    sorted, so it runs once and the narrow rows travel."""
    made(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)).write.parquet(path)


def raw_table(spark: SparkSession, sf_dir: str, refresh: bool = False) -> DataFrame:
    """The loaded raw ``events`` table for ``sf_dir`` (the ingest job's output)."""
    path = table_path(spark, sf_dir, "raw")
    memo_key = (id(spark), path)
    cached = None if refresh else _memo_get(spark, memo_key)
    if cached is not None:
        return cached
    with _LOCK:
        cached = None if refresh else _memo_get(spark, memo_key)
        if cached is not None:
            return cached
        if refresh or not latest(spark, path):
            with _writing(spark):
                write_raw(adapter.read_table(spark, sf_dir, "events"), _version(path), _parts(spark, f"{sf_dir.rstrip('/')}/events.parquet"),
                          (F.col("ts"), F.col("event_id").cast("string")), lambda rows: adapter.camera_events_from(spark, rows))
        df = spark.read.parquet(latest(spark, path))
        _MEMO[memo_key] = (spark, df)
        return df


def _staged(spark: SparkSession, path: str, write, refresh: bool) -> DataFrame:
    """The newest complete version below ``path``, written first if there is none."""
    memo_key = (id(spark), path)
    cached = None if refresh else _memo_get(spark, memo_key)
    if cached is not None:
        return cached
    with _LOCK:
        cached = None if refresh else _memo_get(spark, memo_key)
        if cached is not None:
            return cached
        if refresh or not latest(spark, path):
            with _writing(spark):
                write(_version(path))
        df = spark.read.parquet(latest(spark, path))
        _MEMO[memo_key] = (spark, df)
        return df


def canonical_table(spark: SparkSession, sf_dir: str, refresh: bool = False) -> DataFrame:
    """The staged canonical events for ``sf_dir`` (built on first use, or
    rebuilt when ``refresh`` is set)."""
    return _staged(spark, table_path(spark, sf_dir), lambda path: write_canonical(raw_table(spark, sf_dir, refresh), path), refresh)


def states_table(spark: SparkSession, sf_dir: str, refresh: bool = False) -> DataFrame:
    """Mergeable event-group states, one folder a date."""
    def write(path):
        G.group_states(canonical_table(spark, sf_dir), "event_date").write.partitionBy("event_date").parquet(path)

    return _staged(spark, table_path(spark, sf_dir, "states"), write, refresh)


def groups_table(spark: SparkSession, sf_dir: str, refresh: bool = False) -> DataFrame:
    """One merged state a group, numbered in order of date and camera."""
    def write(path):
        order = ("first_day", "min_camera_name", "event_group")
        states = G.merged(states_table(spark, sf_dir).drop("event_date")).withColumn("first_day", F.to_date("first_seen"))
        parts = _parts(spark, f"{sf_dir.rstrip('/')}/events.parquet")
        (states.repartitionByRange(parts, *order).sortWithinPartitions(*order)
         .withColumn("number", F.monotonically_increasing_id()).write.parquet(path))

    return _staged(spark, table_path(spark, sf_dir, "groups"), write, refresh)


def combos_table(spark: SparkSession, sf_dir: str, refresh: bool = False) -> DataFrame:
    """Groups by (date, camera, category, hour) with running totals, one folder a date."""
    def write(path):
        combos = G.combinations(G.event_groups(groups_table(spark, sf_dir)))
        combos.repartition("date").sortWithinPartitions("date", "camera_name").write.partitionBy("date").parquet(path)

    return _staged(spark, table_path(spark, sf_dir, "combos"), write, refresh)


def cells_table(spark: SparkSession, sf_dir: str, refresh: bool = False) -> DataFrame:
    """Group numbers by every combination of filter values, one folder a date."""
    def write(path):
        made = G.cells(canonical_table(spark, sf_dir), groups_table(spark, sf_dir).select("event_group", "number"))
        made.repartition("event_date", "camera_name").sortWithinPartitions("event_date", "camera_name").write.partitionBy("event_date").parquet(path)

    return _staged(spark, table_path(spark, sf_dir, "cells"), write, refresh)


def pages_table(spark: SparkSession, sf_dir: str, refresh: bool = False) -> DataFrame:
    """The explorer's order-statistic index, one folder a range of a sort form."""
    def write(path):
        parts = max(len(P.FORMS), _parts(spark, f"{sf_dir.rstrip('/')}/events.parquet", 4))  # 18 entries an event
        P.index(canonical_table(spark, sf_dir), parts).write.partitionBy("form", "part").parquet(path)

    return _staged(spark, table_path(spark, sf_dir, "pages"), write, refresh)


def page_starts_table(spark: SparkSession, sf_dir: str, refresh: bool = False) -> DataFrame:
    """Counts and offsets of the index's ranges, one row a range."""
    def write(path):
        P.starts(pages_table(spark, sf_dir)).coalesce(1).write.parquet(path)

    return _staged(spark, table_path(spark, sf_dir, "page_starts"), write, refresh)


def search_tables(spark: SparkSession, sf_dir: str, refresh: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The text index: texts, posting lists, their lengths, places."""
    def staged(kind, write):
        return _staged(spark, table_path(spark, sf_dir, f"search_{kind}"), write, refresh)

    canon, parts = canonical_table(spark, sf_dir), _parts(spark, f"{sf_dir.rstrip('/')}/events.parquet")
    texts = staged("texts", lambda path: S.texts(canon, parts).write.parquet(path))
    lists = staged("postings", lambda path: S.postings(texts).repartitionByRange(parts, "bucket", "gram", "text_no")
                   .sortWithinPartitions("bucket", "gram", "text_no").write.partitionBy("bucket").parquet(path))
    lengths = staged("counts", lambda path: S.counts(lists).repartitionByRange(parts, "bucket", "gram")
                     .sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(path))
    where = staged("places", lambda path: S.places(canon, texts).repartitionByRange(parts, "part", "text_no", "event_date", "id")
                   .sortWithinPartitions("part", "text_no").write.partitionBy("part").parquet(path))
    return texts, lists, lengths, where


def export_folder(spark: SparkSession, sf_dir: str, refresh: bool = False) -> str:
    """The raw rows as a delivery: a folder of JSON-array files."""
    def write(path):
        raw = raw_table(spark, sf_dir)
        keys = [k for k in EXPORT_KEYS if k in raw.columns]
        record = F.to_json(F.struct(*(F.col(f"`{k}`").cast("string").alias(k) if "timestamp" in raw.schema[k].dataType.typeName() else F.col(f"`{k}`")
                                      for k in keys)), {"ignoreNullFields": "false"})
        raw.select(record.alias("record")).mapInArrow(json_array.as_array, "value string").write.text(path)

    path = table_path(spark, sf_dir, "export")
    with _LOCK:
        if refresh or not latest(spark, path):
            with _writing(spark):
                write(_version(path))
    return latest(spark, path)


def stage_all(spark: SparkSession, sf_dir: str, refresh: bool = False) -> None:
    """Every staged table of ``sf_dir``, in order of derivation."""
    for table in (canonical_table, states_table, groups_table, combos_table, cells_table, pages_table, page_starts_table, search_tables):
        table(spark, sf_dir, refresh)
    export_folder(spark, sf_dir, refresh)
