"""Splittable reading of JSON-array exports.

An array of records is one stream for Spark's JSON reader.  Here a file is cut
into byte ranges, and two passes over them find the records:

1. every range counts its unescaped quotes and how far it opens or closes
   brackets, both for the case that it begins inside a string and that it does
   not; a running sum over a file's ranges tells which case holds and at which
   depth the range begins;
2. every range emits the records that begin in it, reading on past its end
   until its last record closes.

Only scanning bytes is done in Python tasks (numpy on one range at a time);
fields are parsed by Spark from the record texts.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RANGE_BYTES = 8 << 20
QUOTE, ESCAPE, OPEN, CLOSE = 34, 92, (91, 123), (93, 125)
STEP = np.zeros(256, np.int8)  # by byte: +1 for a bracket that opens, -1 for one that closes
STEP[[*OPEN]], STEP[[*CLOSE]] = 1, -1
LOCAL = re.compile(r"^file:/+")


def _open(path: str):
    """A random-access file: local, or of any store that Arrow reads."""
    if LOCAL.match(path) or "://" not in path:
        return open(LOCAL.sub("/", path), "rb")
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def reachable(path: str) -> bool:
    """Whether tasks can open the file by ranges."""
    if LOCAL.match(path) or "://" not in path:
        return True
    from pyarrow import fs

    try:
        fs.FileSystem.from_uri(path)
    except (ValueError, OSError):  # a scheme Arrow does not know
        return False
    return True


def as_array(batches):
    """Lines of (record) as one JSON array a partition."""
    begun = False
    for batch in batches:
        lines = [("," if begun or i else "[") + text for i, text in enumerate(batch.column(0).to_pylist())]
        begun = begun or bool(lines)
        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
    if begun:
        yield pa.RecordBatch.from_arrays([pa.array(["]"], pa.string())], ["value"])


def _escaped(file, start: int) -> bool:
    """Whether the byte at ``start`` follows an odd run of backslashes."""
    at, run = start, 0
    while at > 0:
        low = max(0, at - 4096)
        file.seek(low)
        part = file.read(at - low)
        bare = part.rstrip(b"\\")
        run += len(part) - len(bare)
        if bare:
            break
        at = low
    return run % 2 == 1


def quotes(data: np.ndarray, escaped: bool) -> np.ndarray:
    """Where the unescaped quotes are; ``escaped``: the first byte is."""
    found = np.flatnonzero(data == QUOTE)
    odd = np.zeros(len(found), bool)
    # only a quote right after a backslash can be escaped: by an odd run of them
    after = np.flatnonzero((found > 0) & (data[np.maximum(found, 1) - 1] == ESCAPE)) if len(found) else found
    if len(after):
        slashes = np.flatnonzero(data == ESCAPE)
        first = np.ones(len(slashes), bool)
        first[1:] = slashes[1:] != slashes[:-1] + 1
        begin = slashes[first]
        at = found[after]
        run = at - begin[np.searchsorted(begin, at) - 1]
        run += escaped & (run == at)  # the run goes on in the range before
        odd[after] = run % 2 == 1
    if escaped and len(found) and found[0] == 0:
        odd[0] = True
    return found[~odd]


def depths(data: np.ndarray, marks: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """(positions, steps): brackets outside strings, +1 for one that opens."""
    steps = STEP[data]
    at = np.flatnonzero(steps)
    out = (np.searchsorted(marks, at, "right") + inside) % 2 == 0
    at = at[out]
    return at, steps[at].astype(np.int64)


def _scan(batches):
    """First pass: (quotes are odd, depth change if outside, if inside) of a range."""
    for batch in batches:
        out = []
        for path, start, stop in zip(*(batch.column(i).to_pylist() for i in range(3))):
            with _open(path) as file:
                escaped = _escaped(file, start)
                file.seek(start)
                data = np.frombuffer(file.read(stop - start), np.uint8)
            marks = quotes(data, escaped)
            out.append((path, start, stop, len(marks) % 2, *(int(depths(data, marks, x)[1].sum()) for x in (False, True))))
        cols = list(zip(*out)) or [()] * 6
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))],
            ["path", "start", "stop", "odd", "outside", "inside"])


def records(file, start: int, stop: int, inside: bool, depth: int, step: int):
    """Texts of the records (objects at depth 1) that begin in [start, stop)."""
    escaped, at, begun = _escaped(file, start), start, None
    held: list[bytes] = []
    while True:
        file.seek(at)
        raw = file.read((stop if at < stop else at + step) - at)
        if not raw:
            return
        data = np.frombuffer(raw, np.uint8)
        marks = quotes(data, escaped)
        places, steps = depths(data, marks, inside)
        level = depth + np.cumsum(steps)
        taken = 0
        for p, s, d in zip(places.tolist(), steps.tolist(), level.tolist()):
            if s == 1 and d == 2 and begun is None:
                if at + p >= stop:
                    return
                begun, taken = p, p
            elif s == -1 and d == 1 and begun is not None:
                held.append(raw[taken:p + 1])
                yield b"".join(held).decode("utf-8", "replace")
                held, begun = [], None
                if at >= stop:
                    return
        if begun is not None:
            held.append(raw[taken:])
        elif at + len(raw) >= stop:
            return
        tail = len(raw) - len(raw.rstrip(b"\\"))
        escaped = (tail + (escaped and tail == len(raw))) % 2 == 1
        inside = bool((inside + len(marks)) % 2)
        depth = int(level[-1]) if len(level) else depth
        at += len(raw)


def _emit(step: int):
    def run(batches):
        for batch in batches:
            for path, start, stop, inside, depth in zip(*(batch.column(i).to_pylist() for i in range(5))):
                with _open(path) as file:
                    part: list[str] = []
                    size = 0
                    for text in records(file, start, stop, bool(inside), depth, step):
                        part.append(text)
                        size += len(text)
                        if size > 1 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string())], ["record"])
                            part, size = [], 0
                    if part:
                        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string())], ["record"])

    return run


def split_files(spark: SparkSession, files: list[tuple[str, int]], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(record string) of every object in the JSON arrays ``files`` (path, length),
    a task a few byte ranges.  Empty arrays and empty files have no record."""
    table = spark.createDataFrame([f for f in files if f[1]], "path string, size long")
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))).alias("start")
    ranges = table.select("path", "size", start).select("path", "start", F.least(F.col("start") + range_bytes, "size").alias("stop"))
    count = sum(-(-n // range_bytes) for _, n in files) or 1
    parts = min(count, max(spark.sparkContext.defaultParallelism, count // 4))
    scanned = ranges.repartition(parts, "path", "start").mapInArrow(
        _scan, "path string, start long, stop long, odd int, outside long, inside long")
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    within = (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).alias("within")
    entered = scanned.select("*", within).select("*", F.when(F.col("within") == 1, F.col("inside")).otherwise(F.col("outside")).alias("_d"))
    placed = entered.select("path", "start", "stop", F.col("within").cast("int"), F.coalesce(F.sum("_d").over(before), F.lit(0)).alias("depth"))
    return placed.repartition(parts, "path", "start").mapInArrow(_emit(range_bytes), "record string")
