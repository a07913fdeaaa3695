"""Shuffling numpy columns: records are dealt into buckets, one binary row a
task and bucket, and each bucket is reduced on its own.

Rows are (bucket, code, doc, tag, data).  Code 0 holds records for the bucket's
reducer; other codes are results for a document (doc, tag) that pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import trimmed

SCHEMA = "bucket int, code int, doc long, tag long, data binary"
RESULT = "doc long, tag long, code int, data binary"
NO_ID = (1 << 63) - 1  # stands for a null doc_id: after every other


def to_blob(*columns: np.ndarray) -> bytes:
    """Columns byte plane by byte plane (the high bytes of sorted or small
    numbers then shrink to nothing), compressed."""
    head = np.array([len(columns), *(x for c in columns for x in (ord(c.dtype.char), len(c)))], np.int64)
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.dtype.itemsize).T.tobytes() if len(c) else b"" for c in columns]
    return head.tobytes() + zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def from_blob(blob: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    head = np.frombuffer(blob, np.int64, 2 * n, 8)
    raw = zstandard.ZstdDecompressor().decompress(blob[8 + 16 * n:])
    out, at = [], 0
    for kind, size in zip(head[::2].tolist(), head[1::2].tolist()):
        kind = np.dtype(chr(kind))
        planes = np.frombuffer(raw, np.uint8, size * kind.itemsize, at).reshape(kind.itemsize, size)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += size * kind.itemsize
    return out


def batch(bucket, code, doc, tag, data) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket, pa.int32()), pa.array(code, pa.int32()), pa.array(doc, pa.int64()), pa.array(tag, pa.int64()),
         pa.array(data, pa.binary())], ["bucket", "code", "doc", "tag", "data"])


def through(columns, buckets: int) -> pa.RecordBatch:
    """Result rows that pass a bucket; copies of a text go to different ones."""
    code, doc, tag, data = columns
    return batch([(d ^ t) % buckets for d, t in zip(doc, tag)], code, doc, tag, data)


def result(code, doc, tag, data) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(doc, pa.int64()), pa.array(tag, pa.int64()), pa.array(code, pa.int32()), pa.array(data, pa.binary())],
        ["doc", "tag", "code", "data"])


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    mixed = key ^ (key >> np.uint64(31))
    mixed = mixed * np.uint64(0xD6E8FEB86659FD93)
    return ((mixed >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)


def deal(key: np.ndarray, buckets: int, docs: tuple[np.ndarray, np.ndarray], owner: np.ndarray, *columns: np.ndarray):
    """Record rows for each bucket: its columns, the row of each record's
    document in a small table, and that table (doc, tag)."""
    bucket = bucket_of(key, buckets)
    order = np.lexsort((key, bucket))
    bucket = bucket[order]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else []
    rows = []
    for a, b in zip(cuts, [*cuts[1:], len(bucket)]):
        own = order[a:b]
        used, local = np.unique(owner[own], return_inverse=True)
        rows.append((int(bucket[a]), to_blob(*(c[own] for c in columns), local.astype(np.uint32), docs[0][used], docs[1][used])))
    return batch([r[0] for r in rows], [0] * len(rows), [None] * len(rows), [None] * len(rows), [r[1] for r in rows])


def gathered(blobs: list[bytes]) -> list[np.ndarray]:
    """The records of several rows of one bucket: columns, then the rank of
    each record's document, then the documents (doc, tag) in rank order."""
    parts = [from_blob(b) for b in blobs]
    doc, tag = (np.concatenate([p[i] for p in parts]) for i in (-2, -1))
    order = np.lexsort((tag, doc))
    new = np.concatenate([[True], (doc[order][1:] != doc[order][:-1]) | (tag[order][1:] != tag[order][:-1])])
    rank = np.empty(len(doc), np.int64)
    rank[order] = np.cumsum(new) - 1
    shift = np.cumsum([0, *(len(p[-1]) for p in parts)])
    owner = np.concatenate([rank[p[-3].astype(np.int64) + s] for p, s in zip(parts, shift)])
    return [np.concatenate([p[i] for p in parts]) for i in range(len(parts[0]) - 3)] + [owner, doc[order][new], tag[order][new]]


def per_document(code: int, docs: tuple[np.ndarray, np.ndarray], owner: np.ndarray, values: np.ndarray):
    """(codes, docs, tags, data): the values of each document as one row."""
    order = np.argsort(owner, kind="stable")
    owner, values = owner[order], values[order]
    cuts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(owner))
    who = owner[cuts]
    return ([code] * len(cuts), docs[0][who].tolist(), docs[1][who].tolist(),
            [values[a:b].tobytes() for a, b in zip(cuts.tolist(), ends.tolist())])


def exchange(rows: DataFrame, partitions: int, reduce_bucket, trim: bool = False) -> DataFrame:
    """``reduce_bucket(blobs)`` yields result batches; one bucket is held at a time.
    ``trim``: a worker hands freed memory back after its task."""
    def run(batches):
        now, blobs = None, []
        for part in batches:
            bucket, code = part.column(0).to_numpy(), part.column(1).to_numpy()
            through = np.flatnonzero(code)
            if len(through):
                kept = part.take(pa.array(through))
                yield pa.RecordBatch.from_arrays([kept.column(2), kept.column(3), kept.column(1), kept.column(4)], ["doc", "tag", "code", "data"])
            for i in np.flatnonzero(code == 0).tolist():
                if bucket[i] != now:
                    if blobs:
                        yield from reduce_bucket(blobs)
                    now, blobs = bucket[i], []
                blobs.append(part.column(4)[i].as_py())
        if blobs:
            yield from reduce_bucket(blobs)

    return rows.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(trimmed(run) if trim else run, RESULT)


def document_table(doc: np.ndarray, tag: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Documents in (doc, tag) order without repeats, and the rank of each row."""
    order = np.lexsort((tag, doc))
    d, t = doc[order], tag[order]
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (t[1:] != t[:-1])]) if len(d) else np.zeros(0, bool)
    rank = np.empty(len(doc), np.int64)
    rank[order] = np.cumsum(new) - 1
    return (d[new], t[new]), rank
