"""Line deduplication by a segment-partition edit join.

A line with a word is removed when an earlier line (by document, then line
number) is equal to it or, from ``MIN_CHARS`` characters on, within ``EDITS``
edits; of a repeated text only its first line can be the partner, and everything
is judged on the input.  Lines without a word stay.

* Equal lines meet in a bucket of their two line hashes; each task sends only
  its first line of a text.
* Different lines within k edits share one of k+1 segments.  Every line is
  indexed under its k+1 segments and its length, and probes the lengths from
  its own down to k less with the substrings that the position of a segment
  and the difference of lengths allow.
* Pairs that share a segment and whose character counts differ by at most 2k
  are verified on their texts with a banded bit-parallel automaton.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .common import blocks, partitions, release, stage, trimmed, utf8
from .pretoken import gather, prefix_hash, span_hash

MIN_CHARS = 20
EDITS = 2
BLOCK_BYTES = 1 << 20
UNIT_BYTES = 8 << 20
PAIRS_AT_ONCE = 1 << 21
EXACT, LINE, PAIR, NEAR = 1, 2, 3, 4  # result codes
NEWLINE = 10


def segments(size: np.ndarray, edits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(begin, length) of each of the edits + 1 segments of lines of these sizes:
    the last size % (edits + 1) segments are one character longer."""
    m = edits + 1
    short, longer = size // m, size % m
    out, at = [], np.zeros_like(size)
    for i in range(m):
        n = short + (i >= m - longer)
        out.append((at, n))
        at = at + n
    return out


def probes(size: np.ndarray, edits: int):
    """(indexed length, segment, begin, length) of every substring that a line
    of these sizes must look up."""
    for less in range(edits + 1):
        other = size - less
        for i, (at, n) in enumerate(segments(other, edits)):
            low = max(-i, less - (edits - i))
            high = min(i, less + (edits - i))
            for move in range(low, high + 1):
                yield other, i, at + move, n


def within(a: str, b: str, edits: int) -> bool:
    """Whether two strings are at most ``edits`` insertions, deletions or
    substitutions apart.  Bit r of state[d] says that b[:j] is d edits from
    a[:j - edits + r]; only the 2 * edits + 1 bits of the diagonal band are kept."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > edits:
        return False
    head = 0
    while head < len(a) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < len(a) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head:len(a) - tail], b[head:len(b) - tail]
    n, band = len(a), (1 << 2 * edits + 1) - 1
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i + edits + 1  # place i + 1, moved up by edits
    # places below 0 or above n must never be set
    state = [sum(1 << edits + i for i in range(min(d, n) + 1)) & band for d in range(edits + 1)]
    for j, c in enumerate(b, 1):
        match = where.get(c, 0) >> j & band
        real = band
        if j < edits:
            real &= band << edits - j
        if j + edits > n:
            real &= (1 << max(0, n - j + edits + 1)) - 1
        old, state = state, []
        for d in range(edits + 1):
            now = old[d] & match  # same place in the shifted band: i-1, j-1 -> i, j
            if d:
                now |= old[d - 1]  # substitution
                now |= old[d - 1] >> 1  # insertion: place i of the last column
                now |= state[d - 1] << 1  # deletion: place i-1 of this column
            state.append(now & real)
        if not state[-1]:
            return False
    last = n - len(b) + edits
    return bool(state[-1] >> last & 1)


COUNTERS = 16


@lru_cache(maxsize=1)
def _sketch_table() -> np.ndarray:
    """Which counter a byte adds to."""
    return (np.arange(256) * 37 % 251 % COUNTERS).astype(np.int64)


def sketches(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sixteen 4-bit counters (modulo 16) of the characters' first bytes, as
    uint64.  One edit changes at most two counters, each by one."""
    size = end - begin
    at = gather(begin, size)
    owner = np.repeat(np.arange(len(begin)), size)
    own = data[at]
    first = (own & 0xC0) != 0x80
    counts = np.bincount(owner[first] * COUNTERS + _sketch_table()[own[first]], minlength=COUNTERS * len(begin))
    counts = counts.reshape(-1, COUNTERS).astype(np.uint64) % np.uint64(16)
    return (counts << (np.uint64(4) * np.arange(COUNTERS, dtype=np.uint64))).sum(1, dtype=np.uint64)


def sketch_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.zeros(len(a), np.int64)
    for i in range(COUNTERS):
        d = ((a >> np.uint64(4 * i)) - (b >> np.uint64(4 * i))) & np.uint64(15)
        total += np.minimum(d, np.uint64(16) - d).astype(np.int64)
    return total


def find_lines(data: np.ndarray, off: np.ndarray):
    """(text, line number, first byte, end byte, characters) of every line."""
    newline = np.flatnonzero(data == NEWLINE)
    begin = np.sort(np.concatenate([off[:-1], newline + 1]), kind="stable")
    end = np.sort(np.concatenate([off[1:], newline]), kind="stable")
    lines = np.bincount(np.searchsorted(off[1:], newline, "right"), minlength=len(off) - 1) + 1
    text = np.repeat(np.arange(len(off) - 1), lines)
    first = np.cumsum(lines) - lines
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return text, np.arange(len(text)) - first[text], begin, end, chars[end] - chars[begin]


def _map(buckets: int, edits: int, least: int):
    def of_block(data, off):
        text, number, begin, end, size = find_lines(data, off)
        worded = np.concatenate([[0], np.cumsum((data != 32) & ((data < 9) | (data > 13)))])
        mine = np.flatnonzero(worded[end] > worded[begin])
        text, number, begin, end, size = (x[mine] for x in (text, number, begin, end, size))
        long = size >= least
        hashed = prefix_hash(data, 0), prefix_hash(data, 1)
        one, two = (span_hash(h, begin, end) for h in hashed)
        # the byte of every character, to cut segments between characters
        start = np.flatnonzero((data & 0xC0) != 0x80)
        rank = np.searchsorted(start, begin)
        byte_of = np.append(start, len(data))

        def key(other, i, at, n):
            a, b = byte_of[rank + at], byte_of[rank + at + n]
            salt = (other.astype(np.uint64) * np.uint64(8) + np.uint64(i + 1)) * np.uint64(0x9FB21C651E98DF25)
            return span_hash(hashed[0], a, np.minimum(b, end)) ^ salt

        index = [np.where(long, key(size, i, at, n), 0) for i, (at, n) in enumerate(segments(size, edits))]
        asked = []
        for other, i, at, n in probes(size, edits):
            fits = long & (other >= least) & (at >= 0) & (at + n <= size)
            k = key(other, i, np.where(fits, at, 0), np.where(fits, n, 0))
            asked.append(np.where(fits, k, 0))
        return text, number, one, two, sketches(data, begin, end), np.stack(index, 1), np.stack(asked, 1)

    def send(doc, tag, columns):
        docs, rank = X.document_table(np.concatenate(doc), np.concatenate(tag))
        text, number, one, two, sketch, index, asked = (np.concatenate(c) for c in zip(*columns))
        if not len(text):
            return
        owner = rank[text]
        order = np.lexsort((number, owner, two, one))
        one, two, owner, number = one[order], two[order], owner[order], number[order]
        new = np.ones(len(one), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        again = ~new
        lead = np.flatnonzero(new)[np.cumsum(new) - 1]
        again &= (owner != owner[lead]) | (number != number[lead])  # a repeated row repeats its own lines
        yield X.through(X.per_document(EXACT, docs, owner[again], _entry(one[again], number[again])), buckets)
        yield X.deal(one[new], buckets, docs, owner[new], one[new], two[new], number[new].astype(np.uint32))
        own = order[new]
        line, sketch, index, asked = one[new], sketch[own], index[own], asked[own]
        keys = np.concatenate([index.ravel(), asked.ravel()])
        lines = np.concatenate([np.repeat(line, index.shape[1]), np.repeat(line, asked.shape[1])])
        marks = np.concatenate([np.repeat(sketch, index.shape[1]), np.repeat(sketch, asked.shape[1])])
        kinds = np.repeat(np.array([0, 1], np.uint8), [index.size, asked.size])
        used = keys != 0
        keys, lines, marks, kinds = keys[used], lines[used], marks[used], kinds[used]
        bucket = X.bucket_of(keys, buckets)
        by = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
        rows = [(b, X.to_blob(*(c[by[cuts[b]:cuts[b + 1]]] for c in (keys, lines, marks, kinds))))
                for b in range(buckets) if cuts[b] < cuts[b + 1]]
        yield X.batch([r[0] for r in rows], [0] * len(rows), [None] * len(rows), [None] * len(rows), [r[1] for r in rows])

    def run(batches):
        doc, tag, columns, rows, size = [], [], [], 0, 0
        for part in batches:
            data, off = utf8(part.column(2))
            d, t = part.column(0).to_numpy(), part.column(1).to_numpy()
            for a, b in blocks(off, BLOCK_BYTES):
                found = of_block(data[off[a]:off[b]], off[a:b + 1] - off[a])
                columns.append((found[0] + rows, *found[1:]))
                doc.append(d[a:b])
                tag.append(t[a:b])
                rows += b - a
                size += int(off[b] - off[a])
                if size >= UNIT_BYTES:
                    yield from send(doc, tag, columns)
                    doc, tag, columns, rows, size = [], [], [], 0, 0
        if rows:
            yield from send(doc, tag, columns)
    return run


def _entry(line: np.ndarray, number: np.ndarray) -> np.ndarray:
    """(line hash, line number) as 16-byte values."""
    both = np.empty((len(line), 2), np.uint64)
    both[:, 0], both[:, 1] = line, number.astype(np.uint64)
    return both.view("V16").ravel()


def _entries(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int64).reshape(-1, 2)


def _reduce(edits: int):
    def run(blobs):
        lines, shared = [], []
        for blob in blobs:
            (shared if int(np.frombuffer(blob, np.int64, 1)[0]) == 4 else lines).append(blob)
        if lines:
            one, two, number, owner, doc, tag = X.gathered(lines)
            order = np.lexsort((number, owner, two, one))
            one, two, owner, number = one[order], two[order], owner[order], number[order]
            new = np.ones(len(one), bool)
            new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
            lead = np.flatnonzero(new)[np.cumsum(new) - 1]
            again = ~new & ((owner != owner[lead]) | (number != number[lead]))
            for code, mask in ((EXACT, again), (LINE, new)):
                c, d, t, v = X.per_document(code, (doc, tag), owner[mask], _entry(one[mask], number[mask]))
                yield X.result(c, d, t, v)
        if shared:
            key, line, sketch, kind = (np.concatenate(c) for c in zip(*(X.from_blob(b) for b in shared)))
            for a, b in _candidates(key, line, sketch, kind, 2 * edits):
                yield X.result([PAIR] * len(a), a.view(np.int64), b.view(np.int64), [None] * len(a))
    return run


def _candidates(key, line, sketch, kind, limit: int):
    """(smaller, larger) line hashes of different lines that share a key, one as
    index and one as probe, with close character counts; a chunk at a time."""
    order = np.lexsort((line, kind, key))
    key, line, sketch, kind = key[order], line[order], sketch[order], kind[order]
    once = np.ones(len(key), bool)
    once[1:] = (key[1:] != key[:-1]) | (kind[1:] != kind[:-1]) | (line[1:] != line[:-1])
    key, line, sketch, kind = key[once], line[once], sketch[once], kind[once]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    end = np.append(head[1:], len(key))
    split = head + np.add.reduceat((kind == 0).astype(np.int64), head)
    several = np.minimum.reduceat(line, head) != np.maximum.reduceat(line, head)
    several &= (split > head) & (end > split)
    # every probe record meets all index records of its key
    n_probe = (end - split)[several]
    probe = gather(split[several], n_probe)
    first, n_index = np.repeat(head[several], n_probe), np.repeat((split - head)[several], n_probe)
    a = 0
    while a < len(probe):
        total = np.cumsum(n_index[a:a + PAIRS_AT_ONCE])
        b = a + max(1, int(np.searchsorted(total, PAIRS_AT_ONCE)))
        x = gather(first[a:b], n_index[a:b])
        y = np.repeat(probe[a:b], n_index[a:b])
        close = (line[x] != line[y]) & (sketch_distance(sketch[x], sketch[y]) <= limit)
        x, y = line[x[close]], line[y[close]]
        both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
        if len(both):
            yield np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])
        a = b


def _unpack(batches):
    """One row a line of the LINE and EXACT results."""
    for part in batches:
        doc, tag, code, line, number = [], [], [], [], []
        for d, t, c, data in zip(*(part.column(i).to_pylist() for i in range(4))):
            got = _entries(data)
            doc += [d] * len(got)
            tag += [t] * len(got)
            code += [c] * len(got)
            line.append(got[:, 0])
            number.append(got[:, 1])
        join = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(tag, pa.int64()), pa.array(code, pa.int32()), join(line), join(number)],
                                         ["doc", "tag", "code", "line", "number"])


def _fetch(batches):
    """The texts of the wanted lines of each document."""
    for part in batches:
        line, text = [], []
        for whole, wanted in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            own = whole.split("\n")
            for w in wanted:
                line.append(w["line"])
                text.append(own[w["number"]])
        yield pa.RecordBatch.from_arrays([pa.array(line, pa.int64()), pa.array(text, pa.string())], ["line", "chars"])


def _verify(edits: int):
    def run(batches):
        for part in batches:
            a, b = part.column(2).to_pylist(), part.column(3).to_pylist()
            yield part.filter(pa.array([x != y and within(x, y, edits) for x, y in zip(a, b)], pa.bool_())).select(["u", "v"])
    return run


COUNTS = "n_lines long, n_exact long, n_near long, kept_sha256 string, kept string"


def _finish(schema_names: list[str]):
    def run(batches):
        for part in batches:
            out = []
            for text, hits in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if text is None:
                    out.append((0, 0, 0, hashlib.sha256(b"").hexdigest(), None))
                    continue
                own = text.split("\n")
                exact, near = set(), set()
                for h in hits or ():
                    got = set(_entries(h["data"])[:, 1].tolist())
                    if h["code"] == EXACT:
                        exact |= got
                    else:
                        near |= got
                near -= exact
                kept = "\n".join(x for i, x in enumerate(own) if i not in exact and i not in near) if exact or near else text
                out.append((len(own), len(exact), len(near), hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest(), kept))
            cols = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns[2:], *(pa.array(c, k) for c, k in zip(cols, kinds))], schema_names)
    return run


def deduplicate(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_exact, n_near, n_links, class_id, kept_sha256, kept, other) per row.

    n_exact and n_near count removed lines (equal to, or only close to, an
    earlier line).  n_links: links between different line texts, counted at the
    document that holds the first line of either text.  class_id: smallest
    doc_id that first holds a line equal or linked to one of the document's,
    itself included.  ``other`` is a struct of the remaining columns.

    A null text has no lines and stays null; an empty text has one line, which
    has no word and stays.  Identical repeated rows count as one document; rows that share a
    doc_id but not the text are ordered by a digest of it; a null doc_id comes
    after all others.
    """
    if min_chars <= 2 * edits:
        raise ValueError("lines must be longer than twice the number of edits")
    spark = docs.sparkSession
    n = partitions(spark)
    buckets = 4 * n
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(X.NO_ID)).alias("doc"),
                       F.xxhash64(F.col(text_col).cast("string")).alias("tag"), F.col(text_col).cast("string").alias("text"),
                       F.col(id_col).cast("long").alias("doc_id"),
                       F.struct(*(F.col(f"`{c}`") for c in others) if others else [F.lit(None).cast("int").alias("none")]).alias("other"))
    texts = rows.select("doc", "tag", "text")
    first = stage(X.exchange(texts.mapInArrow(trimmed(_map(buckets, edits, min_chars)), X.SCHEMA), n, _reduce(edits), trim=True), "lines")
    release(spark)
    pairs = stage(first.filter(F.col("code") == PAIR).select(F.col("doc").alias("u"), F.col("tag").alias("v")).distinct(), "pairs")
    table = stage(first.filter(F.col("code").isin(EXACT, LINE)).select("doc", "tag", "code", "data")
                  .mapInArrow(_unpack, "doc long, tag long, code int, line long, number long"), "table")
    needed = pairs.select(F.col("u").alias("line")).unionAll(pairs.select(F.col("v").alias("line"))).distinct()
    leads = table.filter(F.col("code") == LINE).drop("code")
    found = stage(leads.join(needed, "line"), "found")
    wanted = found.groupBy("doc", "tag").agg(F.collect_list(F.struct("line", "number")).alias("wanted"))  # lines of one document
    fetched = texts.join(stage(wanted, "wanted"), ["doc", "tag"]).select("text", "wanted")
    chars = stage(fetched.mapInArrow(_fetch, "line long, chars string").dropDuplicates(["line"]), "chars")
    release(spark)
    left = chars.select(F.col("line").alias("u"), F.col("chars").alias("a"))
    right = chars.select(F.col("line").alias("v"), F.col("chars").alias("b"))
    links = stage(pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(_verify(edits), "u long, v long"), "links")
    both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    here = found.select(F.col("line").alias("u"), F.struct("doc", "tag", "number").alias("at"))
    there = found.select(F.col("line").alias("v"), F.struct("doc", "tag", "number").alias("before"))
    linked = stage(both.join(here, "u").join(there, "v").groupBy("u").agg(
        F.first("at").alias("at"), F.min("before").alias("before"), F.count("*").alias("links")), "linked")
    near = linked.filter("before < at").select(
        "at.doc", "at.tag", F.lit(NEAR).alias("code"),
        F.unhex(F.concat(F.repeat(F.lit("0"), 16), _little_endian_hex(F.col("at.number")))).alias("data"))
    hits = stage(first.filter(F.col("code") == EXACT).select("doc", "tag", "code", "data").unionAll(near)
                 .groupBy("doc", "tag").agg(F.collect_list(F.struct("code", "data")).alias("hits")), "hits")
    classes = stage(leads.select("line", F.col("doc").alias("first")).join(
        linked.select(F.col("u").alias("line"), F.col("before.doc").alias("other_first")), "line", "left")
        .select("line", F.least("first", "other_first").alias("class")), "classes")
    per_doc = stage(table.select("doc", "tag", "line").join(classes, "line").groupBy("doc", "tag").agg(F.min("class").alias("class"))
                    .join(linked.groupBy("at.doc", "at.tag").agg(F.sum("links").alias("n_links")), ["doc", "tag"], "left"), "summary")
    marked = rows.join(hits, ["doc", "tag"], "left").join(per_doc, ["doc", "tag"], "left").select(
        "text", "hits", "doc_id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.nullif(F.least("doc", F.coalesce("class", "doc")), F.lit(X.NO_ID)).alias("class_id"), "other")
    kind = marked.schema["other"].dataType.simpleString()
    out = marked.mapInArrow(trimmed(_finish(["doc_id", "n_links", "class_id", "other", *(c.split(" ")[0] for c in COUNTS.split(", "))])),
                            f"doc_id long, n_links long, class_id long, other {kind}, {COUNTS}")
    return out.select("doc_id", "n_lines", "n_exact", "n_near", "n_links", "class_id", "kept_sha256", "kept", "other")


def _little_endian_hex(number):
    """16 hex digits of a long, lowest byte first."""
    digits = F.lpad(F.hex(number), 16, "0")
    return F.concat(*(F.substring(digits, 15 - 2 * i, 2) for i in range(8)))
