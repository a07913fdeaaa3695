"""Exact top-k inner-product search, exhaustive and term at a time.

Queries and candidates are dealt into blocks by a hash of their id; each
(query block, candidate block) pair is one group of bounded size.  Inside a
group every dimension of the candidates is a posting list (row, weight); the
nonzero weights of the query rows scatter weight * posting into dense score
arrays, whose k best are taken by partition selection.  A window keeps the k
best over the candidate blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import whole

CANDIDATES, QUERIES, CHUNK = 8192, 1024, 64
LONG = (-(1 << 63), (1 << 63) - 1)


def _matrix(col) -> np.ndarray:
    """Rows of unequal lengths as one dense matrix (missing dimensions are 0)."""
    rows = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    off = rows.offsets.to_numpy().astype(np.int64)
    flat = rows.values.to_numpy(zero_copy_only=False)
    size = np.diff(off)
    out = np.zeros((len(size), int(size.max()) if len(size) else 0))
    r = np.repeat(np.arange(len(size)), size)
    out[r, np.arange(off[0], off[-1]) - np.repeat(off[:-1], size)] = flat[off[0]:off[-1]]
    return out


def _integers(a: np.ndarray, b: np.ndarray, scale: int):
    """floor(scale * x) of both, as int64 where no score can overflow, else as Python integers."""
    with np.errstate(over="ignore", invalid="ignore"):
        x, y = (np.abs(m).max(0, initial=0) * scale + 1 for m in (a, b))
        bound = max(float((x * y).sum()), x.max(initial=0), y.max(initial=0))
    if bound < 2.0 ** 62:
        return np.floor(a * scale).astype(np.int64), np.floor(b * scale).astype(np.int64)
    exact = np.vectorize(lambda v: whole(v, scale), otypes=[object])
    return exact(a), exact(b)


def scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Dense scores by scattering each term's posting list into them."""
    out = np.zeros((len(queries), len(candidates)), queries.dtype)
    for d in range(candidates.shape[1]):
        asked = np.flatnonzero(queries[:, d])
        posting = np.flatnonzero(candidates[:, d])
        if len(asked) == 0 or len(posting) == 0:
            continue
        add = np.multiply.outer(queries[asked, d], candidates[posting, d])
        if len(posting) == len(candidates):
            out[asked] += add
        else:
            out[np.ix_(asked, posting)] += add
    return out


def best(query_ids, queries, ids, candidates, k: int, scale: int):
    """(query, candidate, score) triples of the k best per query; ties to the smaller id."""
    width = max(queries.shape[1], candidates.shape[1])
    queries = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
    candidates = np.pad(candidates, ((0, 0), (0, width - candidates.shape[1])))
    queries, candidates = _integers(queries, candidates, scale)
    for at in range(0, len(queries), CHUNK):
        dense = scores(queries[at:at + CHUNK], candidates)
        for q, row in zip(query_ids[at:at + CHUNK].tolist(), dense):
            other = ids != q
            own, vec = row[other], ids[other]
            if len(own) > k:
                bound = np.partition(own, len(own) - k)[len(own) - k]
                keep = np.flatnonzero(own >= bound)
                own, vec = own[keep], vec[keep]
            for j in np.lexsort((vec, -own))[:k]:
                yield q, int(vec[j]), min(max(int(own[j]), LONG[0]), LONG[1])


def prepared(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, weights) as doubles; rows with a null id, a null vector or a
    null or non-finite component take no part."""
    x = F.col(vec_col).cast("array<double>")
    usable = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    return vectors.filter(F.col(id_col).isNotNull() & usable).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("weights"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, id_col: str = "vec_id",
          vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of
    every query against every row but its own (all, if fewer), ties to the
    smaller vec_id.  A query id that occurs twice is asked once; candidates
    that repeat an id count as often as they occur.  Components of any finite
    size are exact; a score beyond a long is given as the nearest long."""
    every = prepared(vectors, id_col, vec_col)
    asked = prepared(queries, id_col, vec_col).dropDuplicates(["vec_id"])
    n_cand = max(1, math.ceil(vectors.count() / CANDIDATES))
    n_query = max(1, math.ceil(queries.count() / QUERIES))

    def dealt(n):
        return F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")

    def numbers(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    cands = every.select(F.lit(0).alias("asked"), "vec_id", "weights", dealt(n_cand).alias("cb"), numbers(n_query).alias("qb"))
    quers = asked.select(F.lit(1).alias("asked"), "vec_id", "weights", numbers(n_cand).alias("cb"), dealt(n_query).alias("qb"))

    def run(table: pa.Table) -> pa.Table:
        kind = table.column("asked").to_numpy()
        ids, weights = table.column("vec_id").to_numpy(), _matrix(table.column("weights"))
        rows = list(best(ids[kind == 1], weights[kind == 1], ids[kind == 0], weights[kind == 0], k, scale)) if (kind == 0).any() else []
        q, v, s = zip(*rows) if rows else ((), (), ())
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.int64())})

    found = cands.unionAll(quers).groupBy("cb", "qb").applyInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
