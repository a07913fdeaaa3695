"""Exact deduplication by deterministic block naming.

Every normalised text is cut into blocks of ``block`` bytes.  All blocks of all
documents are sorted; equal blocks get one integer name.  Then adjacent pairs
of names (an odd last one alone) are sorted and named in the same way, until a
document has one name left.  A document's identity is (level, name): names are
given by comparing whole blocks and whole pairs, never by a hash, so two
documents share an identity exactly if their bytes are equal.

A level is one range sort: rows are dealt by (hash, row, position) and sorted
by (hash, block or pair, row, position).  Copies differ in row, so a block that
a third of the table holds is spread over as many partitions as its share, and
the sampler of the sort sees numbers, never blocks.  Inside a partition a name
is the partition's number and the rank of the value.  Values that stand in
several partitions have their first or last hash; those few records are grouped
by whole value and take the earliest partition's name.
"""

from __future__ import annotations

import math
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, partitions, stage

BLOCK = 1024
PART_BYTES = 128 << 20
RANK_BITS = 33  # ranks inside a partition; its number stands above them
RANKED = "part int, row long, n long, pos long, rank long, hash long, value binary"
EDGE = pa.schema([("part", pa.int32()), ("row", pa.int64()), ("n", pa.int64()), ("pos", pa.int64()), ("rank", pa.int64()),
                  ("hash", pa.int64()), ("value", pa.binary())])


def _value(batch: pa.RecordBatch, keys: list[str], i: int) -> bytes:
    """One row's key as bytes, for comparing it with others of the same kind."""
    values = [batch.column(k)[i].as_py() for k in keys]
    return values[0] if len(values) == 1 else np.array(values, np.int64).tobytes()


def _ranked(keys: list[str]):
    """Ranks the values of a sorted partition.  At its end come records without
    a ``row``: the values that have its first or its last hash."""
    def run(batches):
        part = TaskContext.get().partitionId()
        rank, last, hashes, edges = -1, None, [None, None], [{}, {}]  # rank -> value, of the first and the last hash
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            h = batch.column("hash").to_numpy()
            new = np.zeros(size, bool)
            new[1:] = h[1:] != h[:-1]
            for k in keys:
                column = batch.column(k)
                new[1:] |= pc.not_equal(column.slice(1), column.slice(0, size - 1)).to_numpy(zero_copy_only=False)
            new[0] = h[0] != hashes[1] or _value(batch, keys, 0) != last
            ranks = rank + np.cumsum(new)
            hashes[0] = h[0] if hashes[0] is None else hashes[0]
            if h[-1] != hashes[1]:
                hashes[1], edges[1] = h[-1], {}
            for side in (0, 1):
                for i in np.flatnonzero(new & (h == hashes[side])).tolist():
                    edges[side][int(ranks[i])] = _value(batch, keys, i)
            rank, last = int(ranks[-1]), _value(batch, keys, size - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(size, part, np.int32)), batch.column("row"), batch.column("n"), batch.column("pos"), pa.array(ranks),
                 pa.nulls(size, pa.int64()), pa.nulls(size, pa.binary())], schema=EDGE)
        found = {(r, int(hashes[side])): v for side in (0, 1) for r, v in edges[side].items()}
        if found:
            yield pa.RecordBatch.from_pylist([{"part": part, "rank": r, "hash": h, "value": v} for (r, h), v in found.items()], schema=EDGE)

    return run


def _name(part, rank):
    return F.shiftleft(part.cast("long"), RANK_BITS).bitwiseOR(rank)


def named(items: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """(row, n, pos, name) of (row, n, pos, *keys): equal keys, equal names."""
    items = items.select("*", F.xxhash64(*keys).alias("hash"))
    ranked = stage(items.repartitionByRange(parts, "hash", "row", "pos").sortWithinPartitions("hash", *keys, "row", "pos")
                   .mapInArrow(_ranked(keys), RANKED), "ranked")
    edges = ranked.filter("row is null").select("part", "rank", "hash", "value")
    first = edges.groupBy("hash", "value").agg(F.min(F.struct("part", "rank")).alias("first"), F.count("*").alias("times"))
    moved = edges.join(first.filter("times > 1"), ["hash", "value"]).select(
        "part", "rank", _name(F.col("first.part"), F.col("first.rank")).alias("earlier"))
    return (ranked.filter("row is not null").join(F.broadcast(moved), ["part", "rank"], "left")  # a few rows a partition
            .select("row", "n", "pos", F.coalesce("earlier", _name(F.col("part"), F.col("rank"))).alias("name")))


def identities(texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """(row, level, name) of (row, bytes); no text is moved but in the first sort."""
    spark = texts.sparkSession
    n = F.greatest(F.ceil(F.octet_length("bytes") / block), F.lit(1)).cast("long")
    total = texts.agg(F.max(n).alias("most"), F.sum(F.octet_length("bytes").cast("long") + 32).alias("size")).first()
    most, parts = total["most"] or 1, max(partitions(spark), math.ceil((total["size"] or 0) / PART_BYTES))
    cut = F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: F.substring(F.col("bytes"), i * block + 1, F.lit(block)))
    items = texts.select("row", n.alias("n"), F.posexplode(cut).alias("pos", "item")).withColumn("pos", F.col("pos").cast("long"))
    keys, done = ["item"], []
    for level in range(max(most - 1, 0).bit_length() + 1):
        now = named(items, keys, parts)
        done.append(now.filter("n = 1").select("row", F.lit(level).alias("level"), "name"))
        place = F.col("pos") % 2
        items = now.filter("n > 1").groupBy("row", "n", F.expr("pos div 2").alias("half")).agg(
            F.max(F.when(place == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(place == 1, F.col("name"))), F.lit(-1)).alias("b"),
        ).select("row", F.expr("(n + 1) div 2").alias("n"), F.col("half").alias("pos"), "a", "b")
        keys = ["a", "b"]
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    return out


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, level, name) for every row.

    Texts are equal if identical after lower-casing A-Z only; a null text counts
    as empty.  Of equal texts the row with the largest doc_id stays.  Rows
    without a doc_id stay only if no equal text has one (keep_id is then null);
    of rows that tie, repeated rows included, exactly one stays.  An empty table
    gives an empty result; other columns are left behind.
    """
    low = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    rows = stage(docs.select(F.col(id_col).cast("long").alias("doc_id"), low.alias("low")).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2("low", 256).alias("text_sha256"),
        F.col("low").cast("binary").alias("bytes")), "rows")
    own = stage(identities(rows.select("row", "bytes"), block), "identities")
    every = stage(own.join(rows.select("row", "doc_id", "text_sha256"), "row"), "documents")
    discard(rows, own)
    best = F.max(F.struct("doc_id", (-F.col("row")).alias("row")))
    # staged, so that both sides of the join are plain shuffles that adaptive execution can split at a hot group
    groups = stage(every.groupBy("level", "name").agg(best.alias("best"), F.count("*").alias("group_size")), "groups")
    return every.join(groups, ["level", "name"]).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == -F.col("best.row")).alias("kept"),
        "text_sha256", "level", "name")
