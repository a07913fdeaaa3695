"""Best-fit packing by patterns and non-negative least squares.

Documents become token pieces of at most ``capacity`` tokens.  Only the
histogram of piece lengths (at most ``capacity`` numbers) reaches the driver:
few-piece patterns that nearly fill a sequence are enumerated, their repeat
counts are fitted to the histogram by non-negative least squares and rounded
with running sums, those of pieces longer than half a sequence first; what is
left is fitted again, and the rest is packed best-fit decreasing, whole runs
of equal lengths at a time.  The plan is a short table "the pieces of length L with
ranks from s to s+n go to sequences from q on, at offset o"; every piece finds
its place from its rank among the pieces of its length.
"""

from __future__ import annotations

import unicodedata
import zlib
from bisect import bisect_left, insort
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_symbols, split_special, texts_in
from .common import id_text, stage, trimmed
from .pretoken import Vocabulary

CAPACITY = 2048
SALTS = 64
WASTE = 0.01  # share of a sequence that a fitted pattern may leave empty
SECONDS = 8  # second lengths tried with every first length
PIECES = 4  # most pieces of a fitted pattern
FITS = 6
ROUNDS = 400
CACHE_WORDS = 200_000
BLOCK_BYTES = 2 << 20

# ---- tokens ---------------------------------------------------------------------------------------


class WordTokenizer:
    """ids of a lower-casing word-end BPE model, each distinct word asked once."""

    def __init__(self, model_json: str):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_str(model_json)
        self.model = whole.model
        self.special = {t.content: i for i, t in whole.get_added_tokens_decoder().items()}
        self.symbols = {b: ord(s) for b, s in enumerate(byte_symbols())}
        self.seen: dict[bytes, list[int]] = {}

    def _word(self, word: bytes) -> list[int]:
        got = self.seen.get(word)
        if got is None:
            if len(self.seen) >= CACHE_WORDS:
                self.seen.clear()
            got = self.seen[word] = [t.id for t in self.model.tokenize(word.decode("latin-1").translate(self.symbols))]
        return got

    @staticmethod
    def normal(text: str) -> str:
        """NFC, then lower case one character at a time (no final sigma)."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        special = list(self.special)
        segments, plan = [], []
        for i, text in enumerate(texts):
            parts = split_special(text, special) if "<|" in text else ((text, None),)
            for piece, mark in parts:
                segments.append(self.normal(piece))
                plan.append((i, mark))
        words = Vocabulary(segments, keep_space=False)
        raw = words.data.tobytes()
        coded = [self._word(raw[a:b]) for a, b in zip(words.start.tolist(), words.stop.tolist())]
        size = np.fromiter(map(len, coded), np.int64, len(coded))
        pool = np.fromiter((i for c in coded for i in c), np.uint32, int(size.sum()))
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for (i, mark), ids in zip(plan, words.spell(pool, np.cumsum(size) - size, size)):
            out[i].append(ids)
            if mark is not None:
                out[i].append(np.array([self.special[mark]], np.uint32))
        return [p[0] if len(p) == 1 else np.concatenate(p) for p in out]


_TOKENIZERS: dict[int, WordTokenizer] = {}


def _tokenizer(model_json: str) -> WordTokenizer:
    key = hash(model_json)
    if key not in _TOKENIZERS:
        _TOKENIZERS.clear()
        _TOKENIZERS[key] = WordTokenizer(model_json)
    return _TOKENIZERS[key]


def pieces(docs: DataFrame, model_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids and a closing
    0, cut into pieces of ``capacity`` only if longer."""
    with open(model_path, encoding="utf-8") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())  # the vocabulary file

    def run(batches):
        tokenizer = _tokenizer(model.value)
        for batch in batches:
            for row, texts in texts_in(batch.column(1), BLOCK_BYTES):
                where, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(tokenizer.encode(texts)):
                    raw = np.append(ids, 0).astype("<u4").tobytes()
                    for p, at in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[at:at + 4 * capacity]
                        where.append(row + i)
                        piece.append(p)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(where, pa.int64())), pa.array(piece, pa.int32()),
                     pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"])

    return id_text(docs, id_col, text_col).mapInArrow(trimmed(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


# ---- plan ----------------------------------------------------------------------------------------


def patterns(lengths: list[int], capacity: int, shift: int = 0) -> list[tuple[int, ...]]:
    """Few-piece patterns that leave at most ``WASTE`` of a sequence empty, and
    of every length its fullest one; longest first lengths first, lengths in a
    pattern descending.  Of a first length's second lengths, ``SECONDS`` are
    tried, evenly spread over the range and moved by ``shift``."""
    least = capacity - int(WASTE * capacity)
    found: set[tuple[int, ...]] = set()

    def largest(limit: int) -> int | None:
        i = bisect_left(lengths, limit + 1)
        return lengths[i - 1] if i else None

    def filled(pattern: tuple[int, ...]) -> tuple[int, ...]:
        while len(pattern) < PIECES and (c := largest(min(pattern[-1], capacity - sum(pattern)))) is not None:
            pattern += (c,)
        return pattern

    for a in lengths:
        room = capacity - a
        mine = [(a,), filled((a,) * min(PIECES, capacity // a))]
        mine += [(a, b) for less in range(4) if (b := largest(min(a, room - less))) is not None]  # the complement and the next smaller
        below = lengths[bisect_left(lengths, max(1, room // 3)):bisect_left(lengths, min(a, room) + 1)]
        every = max(1, len(below) // SECONDS)
        for b in below[shift % every::every]:
            if (c := largest(min(b, room - b))) is not None:
                mine += [(a, b, c), filled((a, b, c))]
        fullest = max(mine, key=sum)
        found |= {p for p in mine if p is fullest or sum(p) >= least}
    return sorted(found, key=lambda p: (-p[0], capacity - sum(p), len(p), p))


def fit(items: np.ndarray, owner: np.ndarray, n: int, target: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """x >= 0 that minimises |weight (A x - target)|^2 by accelerated projected
    gradient; A adds 1 at items[k] for pattern owner[k]."""
    m = len(target)
    per_item, per_pattern = np.bincount(items, minlength=m), np.bincount(owner, minlength=n)
    step = 1.0 / float(max(1, per_item.max(initial=1) * per_pattern.max(initial=1)) * weight.max(initial=0) ** 2)
    x = np.zeros(n)
    y, t = x.copy(), 1.0
    for _ in range(ROUNDS):
        over = weight * weight * (np.bincount(items, weights=y[owner], minlength=m) - target)
        new = np.maximum(0.0, y - step * np.bincount(owner, weights=over[items], minlength=n))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x


def best_fit_runs(count: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over runs of equal lengths: (pattern, repeats).
    Sequences that look alike are kept as one group, so the work depends on the
    number of different lengths, not on how many pieces there are."""
    groups: dict[int, list] = {}
    rooms: list[int] = []

    def put(room: int, pattern: tuple[int, ...], n: int) -> None:
        if n:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append((pattern, n))

    for size in sorted(count, reverse=True):
        left = count[size]
        while left:
            i = bisect_left(rooms, size)
            if i < len(rooms):
                room = rooms[i]
                pattern, n = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[i]
            else:
                room, pattern, n = capacity, (), left
            each = room // size
            full = min(n, left // each)
            if full:
                put(room - each * size, pattern + (size,) * each, full)
                left -= full * each
            elif left:
                put(room - left * size, pattern + (size,) * left, 1)
                full, left = 1, 0
            if pattern:
                put(room, pattern, n - full)
    return [g for room in rooms for g in groups[room]]


def whole_repeats(table: list[tuple[int, ...]], wish: np.ndarray, left: dict[int, int], capacity: int,
                  only_long: bool) -> list[tuple[tuple[int, ...], int]]:
    """Whole repeats of the nearly full patterns, taken out of ``left``.

    Repeats are rounded as running sums over the patterns of one first length,
    so rounding costs less than one sequence a length.  A first length above
    half a sequence needs a sequence for every piece, whatever the fit gives
    it: its shares are scaled to the pieces left.  ``only_long`` leaves the
    patterns without such a piece for a later fit, when it is known which
    pieces the long ones need.
    """
    least = capacity - int(WASTE * capacity)
    chosen: list[tuple[tuple[int, ...], int]] = []
    for head, places in groupby(range(len(table)), key=lambda k: table[k][0]):
        mine = list(places)
        if only_long and 2 * head <= capacity:
            continue
        wanted = float(wish[mine].sum())
        scale = left.get(head, 0) / wanted if 2 * head > capacity and wanted > 0 else 1.0
        total, given = 0.0, 0
        for k in mine:
            p = table[k]
            total += wish[k] * scale
            want = int(total + 1e-6) - given
            if sum(p) < least:
                given += want  # its share goes on to the next fit
                continue
            n = min(want, *(left.get(size, 0) // p.count(size) for size in p)) if want > 0 else 0
            if n > 0:
                chosen.append((p, n))
                given += n
                for size in p:
                    left[size] -= n
    return chosen


def plan(count: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that use every piece of the histogram exactly once.

    What rounding leaves is fitted again, with other patterns; of the up to
    ``FITS`` fits, as many are kept as give the fewest sequences once the
    residual is packed, at least one."""
    left = {size: n for size, n in count.items() if n}
    chosen: list[tuple[tuple[int, ...], int]] = []
    best: list[tuple[tuple[int, ...], int]] = []
    for again in range(FITS):
        lengths = sorted(left)
        if not lengths:
            break
        table = patterns(lengths, capacity, again)
        place = {size: i for i, size in enumerate(lengths)}
        items = np.array([place[size] for p in table for size in p])
        owner = np.repeat(np.arange(len(table)), [len(p) for p in table])
        scale = float(max(left.values()))
        target = np.array([left[size] for size in lengths]) / scale
        wish = fit(items, owner, len(table), target, np.array(lengths) / capacity) * scale
        chosen = chosen + whole_repeats(table, wish, left, capacity, again == 0 and 2 * lengths[-1] > capacity)
        left = {size: n for size, n in left.items() if n}
        if chosen:
            whole = chosen + best_fit_runs(left, capacity)
            if not best or sum(n for _, n in whole) < sum(n for _, n in best):
                best = whole
    return best or best_fit_runs(left, capacity)  # no pattern had a whole repeat


def slots(chosen: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Rank ranges of each length: (length, first rank) -> first sequence, offset."""
    rows, rank, base = [], {}, 0
    for p, n in chosen:
        at = 0
        for size in p:
            rows.append((size, rank.get(size, 0), base, at))
            rank[size] = rank.get(size, 0) + n
            at += size
        base += n
    rows.sort()
    flat = np.array(rows, np.int64).reshape(-1, 4)
    return {name: flat[:, i].copy() for i, name in enumerate(("length", "rank", "sequence", "offset"))}


def pack(docs: DataFrame, model_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) per piece.

    A null text counts as empty and is one piece of the closing 0.  Repeated
    rows and rows with a null id are packed like any other; an empty table
    gives an empty result.
    """
    cut = stage(pieces(docs, model_path, capacity, id_col, text_col)
                .withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int")), "pieces")
    counted = stage(cut.groupBy("length", "salt").count(), "histogram")  # at most capacity * SALTS rows
    count = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    table = slots(plan(count, capacity))
    places = docs.sparkSession.sparkContext.broadcast(table)  # bounded by the number of patterns
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (cut.withColumn("rank", F.row_number().over(order) - 1)
              .join(F.broadcast(offsets), ["length", "salt"])  # at most capacity * SALTS rows
              .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("rank")))

    def run(batches):
        t = places.value
        key = t["length"] << 44 | t["rank"]
        for batch in batches:
            size, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(key, size << 44 | rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(t["sequence"][at] + rank - t["rank"][at], pa.int64()),
                 pa.array(t["offset"][at], pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
