"""Byte-level BPE with a minimal acyclic transducer lexicon.

The corpus' most frequent words (counted over every text) are encoded once and
compiled into a minimal acyclic automaton: words share prefixes and suffixes,
and the numbers on the transitions add up to a word's index, which points to
its ids.  The automaton is a handful of flat arrays, written once per worker
to a file that is memory-mapped.  Texts are split into words in blocks, equal
words of a block are looked up once, and words outside the lexicon are merged
pair by pair by rank, so every result is exact.
"""

from __future__ import annotations

import hashlib
import json
import os
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, id_text, stage, utf8
from .pretoken import Vocabulary, gather

LEXICON_WORDS = 65536  # most frequent words that are compiled, at most
COUNT_BITS = 10  # leading bits of a word's count that decide
LONGEST = 48  # bytes of a word in the lexicon
BLOCK_BYTES = 8 << 20
CACHE_WORDS = 300_000  # words a task adds up before it passes them on
TOGETHER = 16384  # words that are merged side by side
TABLE_BITS = 18  # of the hash table of merge pairs
EMPTY, NONE = np.uint64((1 << 64) - 1), np.int64(1) << 62


def byte_symbols() -> list[str]:
    """The public byte-to-character table: printable Latin-1 stands for itself,
    the other bytes for the characters from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, free = [], 256
    for b in range(256):
        out.append(chr(b) if b in own else chr(free))
        free += b not in own
    return out


class Strings:
    """A list of byte strings as one array; many are joined at once."""

    def __init__(self, strings: list[bytes]):
        self.data = np.frombuffer(b"".join(strings), np.uint8)
        self.size = np.fromiter(map(len, strings), np.int64, len(strings))
        self.first = np.cumsum(self.size) - self.size

    def joined(self, which: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The strings which[0:ends[0]] joined, then which[ends[0]:ends[1]], ..."""
        size = self.size[which]
        raw = self.data[gather(self.first[which], size)].tobytes()
        cut = np.concatenate([[0], np.cumsum(size)])[ends]
        return [raw[a:b] for a, b in zip([0, *cut[:-1].tolist()], cut.tolist())]


class Merger:
    """Exact pair merging by rank, and the bytes of every id."""

    def __init__(self, model_json: str):
        spec = json.loads(model_json)
        vocab = spec["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.merged = np.array([vocab[a + b] for a, b in pairs] or [0], np.int64)
        self.slot_key = np.full(1 << TABLE_BITS, EMPTY, np.uint64)
        self.slot_rank = np.zeros(1 << TABLE_BITS, np.int64)
        for rank, (a, b) in enumerate(pairs):
            key = vocab[a] << 32 | vocab[b]
            at = (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 64 - TABLE_BITS
            while self.slot_key[at] not in (EMPTY, np.uint64(key)):
                at = (at + 1) % (1 << TABLE_BITS)
            if self.slot_key[at] == EMPTY:
                self.slot_key[at], self.slot_rank[at] = key, rank
        symbols = byte_symbols()
        self.single = np.array([vocab[s] for s in symbols], np.int64)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        back = {s: bytes([b]) for b, s in enumerate(symbols)}
        self.spelled = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.spelled[i] = b"".join(back[c] for c in token)
        for token, i in self.special.items():
            self.spelled[i] = token.encode()
        self.spelling = Strings(self.spelled)
        self.decimals = Strings([b"%d," % i for i in range(len(self.spelled))])

    def _look_up(self, key: np.ndarray) -> np.ndarray:
        """Row of each pair key in ``self.order`` (its rank), or NONE."""
        at = (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)
        out = np.full(len(key), NONE, np.int64)
        todo = np.arange(len(key))
        while len(todo):
            here = self.slot_key[at]
            hit = here == key[todo]
            out[todo[hit]] = self.slot_rank[at[hit]]
            on = ~hit & (here != EMPTY)
            todo, at = todo[on], (at[on] + np.uint64(1)) & np.uint64((1 << TABLE_BITS) - 1)
        return out

    def merge(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in turn, number of ids of each)."""
        parts = [self._merge(data, start[i:i + TOGETHER], stop[i:i + TOGETHER]) for i in range(0, len(start), TOGETHER)]
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *(p[0] for p in parts)]), np.concatenate([none, *(p[1] for p in parts)])

    def _merge(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Many words at once, one merge a word and round: lowest rank first,
        of overlapping equal pairs the leftmost first."""
        size = stop - start
        symbol = self.single[data[gather(start, size)]]
        word = np.repeat(np.arange(len(start)), size)
        done_symbol, done_word = [], []
        while len(symbol):
            rank = np.full(len(symbol), NONE, np.int64)
            near = np.flatnonzero(word[:-1] == word[1:])
            rank[near] = self._look_up(symbol[near].astype(np.uint64) << np.uint64(32) | symbol[near + 1].astype(np.uint64))
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(symbol))))
            ended = best == NONE
            if ended.any():
                done_symbol.append(symbol[ended])
                done_word.append(word[ended])
                symbol, word, rank, best = symbol[~ended], word[~ended], rank[~ended], best[~ended]
                if not len(symbol):
                    break
            at = np.flatnonzero(rank == best)
            # of overlapping pairs (runs of one symbol) every other one counts
            begins = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (word[at[1:]] != word[at[:-1]])])
            run = np.flatnonzero(begins)
            index = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
            at = at[index % 2 == 0]
            symbol[at] = self.merged[rank[at]]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            symbol, word = symbol[keep], word[keep]
        if not done_symbol:
            return np.zeros(0, np.int64), np.zeros(len(start), np.int64)
        symbol, word = np.concatenate(done_symbol), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return symbol[order], np.bincount(word, minlength=len(start))

    def ids(self, words: list[bytes]) -> list[list[int]]:
        size = np.fromiter(map(len, words), np.int64, len(words))
        stop = np.cumsum(size)
        flat, n = self.merge(np.frombuffer(b"".join(words), np.uint8), stop - size, stop)
        return [p.tolist() for p in np.split(flat, np.cumsum(n)[:-1])] if words else []


class Lexicon:
    """Minimal acyclic transducer over byte strings; flat arrays only."""

    NAMES = ("edge", "target", "output", "final", "first", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)

    @classmethod
    def build(cls, words: dict[bytes, list[int]]) -> Lexicon:
        """Compile words (sorted insertion; the finished part of the last word
        is replaced by an equal state if there is one)."""
        order = sorted(w for w in words if w)
        states: list[tuple[dict[int, int], bool]] = [({}, False)]
        known: dict[tuple, int] = {}
        path = [0]
        last = b""

        def settle(depth: int) -> None:
            while len(path) - 1 > depth:
                child = path.pop()
                arcs, final = states[child]
                sign = (final, tuple(sorted(arcs.items())))
                same = known.setdefault(sign, child)
                if same != child:
                    states[path[-1]][0][last[len(path) - 1]] = same

        for word in order:
            common = len(os.path.commonprefix([word, last]))
            settle(common)
            last = word
            for byte in word[common:]:
                states.append(({}, False))
                states[path[-1]][0][byte] = len(states) - 1
                path.append(len(states) - 1)
            states[path[-1]] = (states[path[-1]][0], True)
        settle(0)

        count: dict[int, int] = {}

        def below(root: int) -> None:  # number of words accepted from each state, children first
            stack = [(root, False)]
            while stack:
                s, done = stack.pop()
                if s in count:
                    continue
                if done:
                    count[s] = states[s][1] + sum(count[t] for t in states[s][0].values())
                else:
                    stack.append((s, True))
                    stack.extend((t, False) for t in states[s][0].values() if t not in count)

        below(0)
        number = {s: n for n, s in enumerate(sorted(count))}
        edge, target, output = [], [], []
        for s in sorted(count):
            before = int(states[s][1])
            for byte, t in sorted(states[s][0].items()):
                edge.append(number[s] << 8 | byte)
                target.append(number[t])
                output.append(before)
                before += count[t]
        sizes = [len(words[w]) for w in order]
        return cls({
            "edge": np.array(edge, np.int64), "target": np.array(target, np.int64), "output": np.array(output, np.int64),
            "final": np.array([states[s][1] for s in sorted(count)], np.uint8),
            "first": np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64),
            "ids": np.array([i for w in order for i in words[w]], np.int64)})

    def find(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Index of each word data[start:stop], -1 if it is not in the lexicon."""
        state, index = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        live = np.flatnonzero((stop > start) & (stop - start <= LONGEST)) if len(self.edge) else np.zeros(0, np.int64)
        out = np.full(len(start), -1, np.int64)
        step = 0
        while len(live):
            key = (state[live] << 8 | data[start[live] + step]).astype(self.edge.dtype)
            at = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
            hit = self.edge[at] == key
            live, at = live[hit], at[hit]
            state[live] = self.target[at]
            index[live] += self.output[at]
            step += 1
            ended = stop[live] - start[live] == step
            done = live[ended]
            done = done[self.final[state[done]] == 1]
            out[done] = index[done]
            live = live[~ended]
        return out

    def packed(self) -> bytes:
        parts = [np.ascontiguousarray(getattr(self, n)).astype(np.int32) for n in self.NAMES]
        head = np.array([len(p) for p in parts], np.int32)
        return head.tobytes() + b"".join(p.tobytes() for p in parts)

    @classmethod
    def mapped(cls, packed: bytes) -> Lexicon:
        """Write the arrays to a scratch file and memory-map them; the file's
        name goes at once, its pages live as long as the mapping."""
        fd, path = tempfile.mkstemp(prefix="lexicon-")
        try:
            with os.fdopen(fd, "wb") as f:
                f.write(packed)
            flat = np.memmap(path, np.int32, "r")
        finally:
            os.unlink(path)
        n = len(cls.NAMES)
        ends = n + np.cumsum(flat[:n])
        return cls({name: flat[e - s:e] for name, s, e in zip(cls.NAMES, flat[:n], ends)})


def split_special(text: str, special: list[str]):
    """Pieces of text and special strings, in turn (leftmost first, longest first)."""
    at = 0
    while special:
        found = min(((i, -len(s), s) for s in special if (i := text.find(s, at)) >= 0), default=None)
        if found is None:
            break
        yield text[at:found[0]], found[2]
        at = found[0] + len(found[2])
    yield text[at:], None


def texts_in(batch_column, limit: int = BLOCK_BYTES):
    """(first row, texts) of blocks of about ``limit`` bytes."""
    data, off = utf8(batch_column)
    raw = data.tobytes()
    for a, b in blocks(off, limit):
        yield a, [raw[x:y].decode("utf-8", "replace") for x, y in zip(off[a:b].tolist(), off[a + 1:b + 1].tolist())]


class Encoder:
    """Encodes blocks of texts: lexicon first, exact merging for the rest."""

    def __init__(self, merger: Merger, lexicon: Lexicon):
        self.merger, self.lexicon = merger, lexicon

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        special = list(self.merger.special)
        segments, plan = [], []  # plan: (text, special after it)
        for i, text in enumerate(texts):
            if any(s in text for s in special):
                for piece, mark in split_special(text, special):
                    segments.append(piece)
                    plan.append((i, mark))
            else:
                segments.append(text)
                plan.append((i, None))
        words = Vocabulary(segments, keep_space=True)
        index = self.lexicon.find(words.data, words.start, words.stop)
        known = index >= 0
        merged, n_merged = self.merger.merge(words.data, words.start[~known], words.stop[~known])
        size = np.zeros(len(index), np.int64)
        first = np.zeros(len(index), np.int64)
        first[known] = self.lexicon.first[index[known]]
        size[known] = self.lexicon.first[index[known] + 1] - first[known]
        size[~known] = n_merged
        first[~known] = len(self.lexicon.ids) + np.cumsum(n_merged) - n_merged
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for (i, mark), ids in zip(plan, words.spell(np.concatenate([self.lexicon.ids, merged]), first, size)):
            out[i].append(ids)
            if mark is not None:
                out[i].append(np.array([self.merger.special[mark]], np.int64))
        return [p[0] if len(p) == 1 else np.concatenate(p) for p in out]

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """UTF-8 of each decoded text, special tokens spelled out."""
        return [t.decode("utf-8", "replace").encode() for t in self._joined(self.merger.spelling, ids)]

    def written(self, ids: list[np.ndarray]) -> list[bytes]:
        """Decimal ids joined by commas."""
        return [t[:-1] for t in self._joined(self.merger.decimals, ids)]

    @staticmethod
    def _joined(strings: Strings, ids: list[np.ndarray]):
        group, n = [], 0
        for i in ids:  # small groups: their arrays stay in the cache
            group.append(i)
            n += len(i)
            if n >= TOGETHER * 8:
                yield from strings.joined(np.concatenate(group), np.cumsum([len(g) for g in group]))
                group, n = [], 0
        if group:
            yield from strings.joined(np.concatenate(group), np.cumsum([len(g) for g in group]))


def word_counts(docs: DataFrame, special: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word binary, n) over every text; each task adds up its own words first."""
    def flush(sums):
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.binary()), pa.array(list(sums.values()), pa.int64())], ["word", "n"])

    def run(batches):
        sums: dict[bytes, int] = {}
        for batch in batches:
            for _, texts in texts_in(batch.column(1)):
                words = Vocabulary([p for t in texts for p, _ in split_special(t, special)], keep_space=True)
                raw = words.data.tobytes()
                for a, b, c in zip(words.start.tolist(), words.stop.tolist(), words.counts().tolist()):
                    if b - a <= LONGEST:
                        w = raw[a:b]
                        sums[w] = sums.get(w, 0) + c
                if len(sums) > CACHE_WORDS:
                    yield flush(sums)
                    sums = {}
        if sums:
            yield flush(sums)

    return id_text(docs, id_col, text_col).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def least_count(counts: DataFrame, size: int) -> int:
    """Smallest count that at most ``size`` words reach, counts taken to
    ``COUNT_BITS`` leading bits: only that histogram reaches the driver (at most
    2**COUNT_BITS rows for each power of two)."""
    unit = F.expr(f"shiftleft(1L, cast(greatest(0, floor(log2(n)) - {COUNT_BITS}) as int))")
    rows = counts.groupBy((F.col("n") - F.col("n") % unit).alias("least")).agg(F.count("*").alias("words")).collect()
    found, total = 1 << 62, 0
    for least, words in sorted(((r["least"], r["words"]) for r in rows), reverse=True):
        total += words
        if total > size:
            break
        found = least
    return found


def compile_lexicon(docs: DataFrame, merger: Merger, size: int = LEXICON_WORDS, **cols) -> Lexicon:
    """Lexicon of the most frequent words, at most ``size``: all that reach the
    smallest count that no more words reach.  Only they are sent to the driver."""
    counts = stage(word_counts(docs, list(merger.special), **cols), "words")
    words = [bytes(r["word"]) for r in counts.filter(F.col("n") >= least_count(counts, size)).select("word").collect()]
    return Lexicon.build(dict(zip(words, merger.ids(words))))


_KEPT: dict[str, object] = {}  # this worker's last model and encoder


def _encoder(model_json: str, packed: bytes) -> Encoder:
    """One encoder a worker and lexicon; the model itself is parsed once."""
    model, lexicon = hashlib.sha1(model_json.encode()).hexdigest(), hashlib.sha1(packed).hexdigest()
    if _KEPT.get("model") != model:
        _KEPT.update(model=model, merger=Merger(model_json), lexicon=None)
    if _KEPT["lexicon"] != lexicon:
        _KEPT.update(lexicon=lexicon, encoder=Encoder(_KEPT["merger"], Lexicon.mapped(packed)))
    return _KEPT["encoder"]


def round_trip(docs: DataFrame, model_path: str, lexicon_words: int = LEXICON_WORDS, id_col: str = "doc_id",
               text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) for every row.

    ids_sha256 is over the decimal ids joined by commas, decoded_sha256 over
    the decoded text in UTF-8.  Null and empty texts have no tokens.  Strings
    of special tokens become those tokens.  Repeated rows and null ids are
    encoded like any other row.
    """
    spark = docs.sparkSession
    with open(model_path, encoding="utf-8") as f:
        model = f.read()
    lexicon = compile_lexicon(docs, Merger(model), lexicon_words, id_col=id_col, text_col=text_col)
    shared = spark.sparkContext.broadcast((model, lexicon.packed()))  # bounded by the vocabulary and lexicon_words

    def run(batches):
        coder = _encoder(*shared.value)
        for batch in batches:
            for row, texts in texts_in(batch.column(1)):
                coded = coder.encode(texts)
                cols = [batch.column(0).slice(row, len(texts)), pa.array([len(i) for i in coded], pa.int64()),
                        pa.array([hashlib.sha256(t).hexdigest() for t in coder.written(coded)]),
                        pa.array([hashlib.sha256(t).hexdigest() for t in coder.decode(coded)])]
                if keep_ids:
                    cols.append(pa.array([i.tolist() for i in coded], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<bigint>" * keep_ids
    return id_text(docs, id_col, text_col).mapInArrow(run, schema)
