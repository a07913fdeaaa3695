"""SimHash near-duplicates with pigeonring candidate filtering.

A 64-bit fingerprint has a bit set where more than half of the shingle hashes
have it.  Two fingerprints within ``distance`` bits are linked.  The ring of
``distance + 1`` segments must contain a start from which every chain of l
consecutive segments differs in at most l * distance / (distance + 1) bits: the
first segment agrees, the first two differ in at most one bit, and so on.

The chain of length two is the join key: a fingerprint is indexed under each
(segment, next segment) and probes the same pair with no or one flipped bit of
the next segment, so a key is 43 bits wide for distance 2.  Longer chains and
the full Hamming distance are checked on the joined rows.  Only different
fingerprints are joined (each has at most a constant number of neighbours);
equal ones are grouped first, so a group of copies never forms pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, release, stage, utf8
from .components import components

BITS = 64
SEED = 42
BLOCK = 1 << 16


def fingerprint(text: bytes, words_per_shingle: int = 3) -> int:
    """Signed 64-bit fingerprint of a UTF-8 text; 0 if it has no words."""
    words = text.lower().split()  # ASCII letters and ASCII space only, on bytes
    if not words:
        return 0
    line = b" ".join(words)
    k = min(words_per_shingle, len(words))
    size = np.fromiter(map(len, words), np.int64, len(words))
    stop = np.cumsum(size + 1) - 1
    start = stop - size
    begin, end = start[:len(words) - k + 1], stop[k - 1:]
    digest = xxhash.xxh64_digest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(begin), BLOCK):
        hashed = b"".join([digest(line[a:b], SEED) for a, b in zip(begin[at:at + BLOCK].tolist(), end[at:at + BLOCK].tolist())])
        ones += np.unpackbits(np.frombuffer(hashed, np.uint8)).reshape(-1, BITS).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(begin)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, words_per_shingle: int = 3, id_col: str = "doc_id", text_col: str = "text",
                 text_key: bool = False) -> DataFrame:
    """(doc_id, fp long[, tag]) for every row; a null text counts as empty.
    ``text_key`` adds a 64-bit hash of the text, to find a row again."""
    def run(batches):
        for batch in batches:
            data, off = utf8(batch.column(1))
            raw = data.tobytes()
            fps = [fingerprint(raw[a:b], words_per_shingle) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64()), *batch.columns[2:]],
                                             ["doc_id", "fp"] + ["tag"] * text_key)

    rows = id_text(docs, id_col, text_col)
    rows = rows.withColumn("tag", F.xxhash64("text")) if text_key else rows
    return rows.mapInArrow(run, "doc_id long, fp long" + ", tag long" * text_key)


def _segments(distance: int) -> list[tuple[int, int]]:
    """(shift, width) of the distance + 1 segments of a fingerprint."""
    m = distance + 1
    widths = [BITS // m + (i < BITS % m) for i in range(m)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def _part(fp: Column, segment: tuple[int, int]) -> Column:
    shift, width = segment
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))


def links(nodes: DataFrame, distance: int) -> DataFrame:
    """(u, v, bits) for every pair of different fingerprints of ``nodes``
    (node long, fp long; one row a fingerprint) within ``distance`` bits."""
    ring = _segments(distance)
    m = len(ring)
    fp = F.col("fp")
    index, probe = [], []
    for i in range(m):
        first, second = _part(fp, ring[i]), _part(fp, ring[(i + 1) % m])
        width = ring[(i + 1) % m][1]
        flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << b).cast("long") for b in range(width)))
        index.append(F.struct(F.lit(i).alias("i"), first.alias("a"), second.alias("b")))
        probe.append(F.transform(flips, _flipped(i, first, second)))
    keyed = nodes.select(F.col("node").alias("v"), fp.alias("g"), F.explode(F.array(*index)).alias("k")).select("v", "g", "k.*")
    asked = nodes.select(F.col("node").alias("u"), fp, F.explode(F.concat(*probe)).alias("k")).select("u", "fp", "k.*")
    joined = asked.join(keyed, ["i", "a", "b"])
    differ = F.bit_count(F.col("fp").bitwiseXOR(F.col("g")))
    close = (F.col("u") < F.col("v")) & (differ <= distance)
    for i in range(m):  # chains of three and more segments from the start that the key stands for
        spent = F.lit(0)
        for length in range(1, m):
            segment = ring[(i + length - 1) % m]
            spent = spent + F.bit_count(_part(F.col("fp"), segment).bitwiseXOR(_part(F.col("g"), segment)))
            if length > 2:
                close = close & ((F.col("i") != i) | (spent <= length * distance // m))
    return joined.filter(close).select("u", "v", differ.alias("bits")).distinct()


def _flipped(i: int, first: Column, second: Column):
    return lambda x: F.struct(F.lit(i).alias("i"), first.alias("a"), second.bitwiseXOR(x).alias("b"))


def near_duplicates(docs: DataFrame, distance: int = 2, words_per_shingle: int = 3, id_col: str = "doc_id",
                    text_col: str = "text", text_key: bool = False) -> DataFrame:
    """(doc_id, fp, component_id[, tag]) for every row.

    component_id is the smallest doc_id that can be reached over links of at
    most ``distance`` differing bits.  Empty and null texts have fingerprint 0
    and are linked like any other.  Repeated rows share a component; rows with
    a null doc_id get the component of their fingerprint, null if no row with
    an id shares or reaches it.
    """
    spark = docs.sparkSession
    fps = stage(fingerprints(docs, words_per_shingle, id_col, text_col, text_key), "fps")
    nodes = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    found = components(links(nodes.filter("node is not null"), distance)) if distance else None
    release(spark)
    if found is not None:
        nodes = nodes.join(stage(found, "roots"), "node", "left")
        nodes = nodes.select("fp", F.coalesce("root", "node").alias("component_id"))
    else:
        nodes = nodes.withColumnRenamed("node", "component_id")
    return fps.join(stage(nodes, "classes"), "fp").select(
        "doc_id", "fp", "component_id", *(["tag"] if text_key else []))


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), BITS // 4, "0")
