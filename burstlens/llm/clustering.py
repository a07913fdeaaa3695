"""Centroid clustering of integer vectors with exact arithmetic.

A vector finds its nearest centroid by a bisector tournament: for centroids i < j
the integer normal 2 (cj - ci) and the threshold |cj|^2 - |ci|^2 are computed
once, and j beats i exactly if normal . x > threshold, so k - 1 sign tests leave
the winner and a zero leaves the smaller number.  Only the winner's distance is
computed.  A task sends sums and counts of its clusters, never vectors.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, whole

CHUNK = 8192
SMALL = 1 << 24  # below it a product of 4096 dimensions stays inside 64 bits
LIMB = 32
LONG = (1 << 63) - 1


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as int64 where all are small, else as Python integers."""
    if np.abs(x).max(initial=0) * scale < SMALL:
        return np.floor(x * scale).astype(np.int64)
    return np.array([[whole(v, scale) for v in row] for row in x.tolist()], object).reshape(x.shape)


class Bisectors:
    """Normals and thresholds of all pairs of centroids."""

    def __init__(self, centroids: list[list[int]]):
        big = max((abs(v) for c in centroids for v in c), default=0) >= SMALL
        c = np.array(centroids, object if big else np.int64).reshape(len(centroids), -1)
        self.centroids, norm = c, (c * c).sum(1)
        self.normals = 2 * (c[None, :, :] - c[:, None, :])
        self.thresholds = norm[None, :] - norm[:, None]

    def winners(self, x: np.ndarray) -> np.ndarray:
        if x.dtype == object or self.centroids.dtype == object:
            x = x.astype(object)
        best = np.zeros(len(x), np.int64)
        for j in range(1, len(self.centroids)):
            side = (x * self.normals[best, j]).sum(1) - self.thresholds[best, j]
            best[(side > 0).astype(bool)] = j
        return best

    def distances(self, x: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        away = x - self.centroids[cluster]
        return (away * away).sum(1)


def limbs(value: int) -> list[tuple[int, int]]:
    """(index, signed 32-bit limb) of a number of any size, zeros left out."""
    sign, value, out, i = (-1 if value < 0 else 1), abs(value), [], 0
    while value:
        if low := value & ((1 << LIMB) - 1):
            out.append((i, sign * low))
        value, i = value >> LIMB, i + 1
    return out


def _vectors(batch: pa.RecordBatch, scale: int, dims: int):
    """(ids column, integer matrix) in chunks."""
    for at in range(0, batch.num_rows, CHUNK):
        part = batch.slice(at, CHUNK)
        flat = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dims)
        yield part.column("vec_id"), integers(flat, scale)


def _sums(centroids, scale, dims):
    def run(batches):
        plane, k = Bisectors(centroids), len(centroids)
        total = [[0] * (dims + 1) for _ in range(k)]  # the last one counts
        for batch in batches:
            for _, x in _vectors(batch, scale, dims):
                cluster = plane.winners(x)
                for c in np.unique(cluster).tolist():
                    own = x[cluster == c]
                    for d, v in enumerate([*own.sum(0).tolist(), len(own)]):
                        total[c][d] += int(v)
        rows = [(c, d, i, v) for c in range(k) for d in range(dims + 1) for i, v in limbs(total[c][d])]
        c, d, i, v = zip(*rows) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(d, pa.int32()), pa.array(i, pa.int32()), pa.array(v, pa.int64())],
                                         ["cluster", "dim", "limb", "value"])

    return run


def _assigned(centroids, scale, dims):
    def run(batches):
        plane = Bisectors(centroids)
        for batch in batches:
            for ids, x in _vectors(batch, scale, dims):
                cluster = plane.winners(x)
                far = [min(v, LONG) for v in plane.distances(x, cluster).tolist()]
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(far, pa.int64())],
                                                 ["vec_id", "cluster", "distance"])

    return run


def usable(vectors: DataFrame, dims: int, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, x) of the vectors with exactly ``dims`` components, none null or non-finite."""
    x = F.col(vec_col).cast("array<double>")
    fine = (F.size(x) == dims) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.filter(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))


def seeds(kept: DataFrame, k: int, seed: int, scale: int) -> list[list[int]]:
    """The k vectors with the smallest sha256 of ``seed:vec_id``, in that order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.select(digest.alias("digest"), "x").orderBy(F.asc_nulls_last("digest"), "x").limit(k).collect()
    return [[whole(v, scale) for v in r["x"]] for r in first]


def refined(kept: DataFrame, centroids: list[list[int]], scale: int, dims: int) -> list[list[int]]:
    """Centroids after one round: componentwise floor of the exact mean, empty
    ones as they were.  At most k * (dims + 1) * 35 numbers reach the driver."""
    sums = (kept.mapInArrow(_sums(centroids, scale, dims), "cluster int, dim int, limb int, value long")
            .groupBy("cluster", "dim", "limb").agg(F.sum("value").alias("value")).collect())
    total = [[0] * (dims + 1) for _ in centroids]
    for r in sums:
        total[r["cluster"]][r["dim"]] += r["value"] << (LIMB * r["limb"])
    return [[v // t[-1] for v in t[:-1]] if t[-1] else c for c, t in zip(centroids, total)]


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, dims: int = 64, seed: int = 1,
            id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """((vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), centroids).

    Vectors of another length, null ones and ones with a null or non-finite
    component take no part.  Repeated rows count as often as they occur; a row
    without an id is assigned like any other and becomes a first centroid only
    if the others are too few.  With fewer than ``k`` vectors there are as many
    centroids.  Components of any finite size are exact; a distance or inertia
    beyond a long is given as the largest long.  An empty table gives an empty result.
    """
    kept = usable(vectors, dims, id_col, vec_col)
    centroids = seeds(kept, k, seed, scale)
    for _ in range(rounds if centroids else 0):
        centroids = refined(kept, centroids, scale, dims)
    if not centroids:
        return kept.sparkSession.createDataFrame(
            [], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"), []
    found = stage(kept.mapInArrow(_assigned(centroids, scale, dims), "vec_id long, cluster int, distance long"), "assigned")
    sums = {r["cluster"]: int(r["far"]) for r in found.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("far")).collect()}  # k rows
    facts = [(c, min(far, LONG), min(sum(sums.values()), LONG), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest())
             for c, far in sums.items()]
    facts = found.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select(  # k rows
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), centroids
