"""Splitting texts into the words that byte-pair encoders merge within.

The two public split patterns are evaluated on arrays of code points: a text
block becomes an array of character classes, and word starts follow from
changes of class, a leading space, runs of white space and contractions.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
WHITE = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
APOSTROPHE, BLANK = 0x27, 0x20
SHORT, LONG = "stmd", ("re", "ve", "ll")  # fixed values: endings of contractions


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        kind = unicodedata.category(chr(i))[0]
        if kind == "L":
            table[i] = LETTER
        elif kind == "N":
            table[i] = NUMBER
    table[list(WHITE)] = SPACE
    return table


class Words:
    """Words of a list of texts: bytes, byte offsets [start, stop), owner text of each."""

    def __init__(self, texts: list[str], keep_space: bool):
        joined = "".join(texts)
        self.data = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(code)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        text_at = np.concatenate([[0], np.cumsum(sizes)])
        if n == 0:
            self.start = self.stop = self.owner = np.zeros(0, np.int64)
            return
        kind = classes()[code]
        first = np.zeros(n + 1, bool)  # first character of a text, and one past the end
        first[text_at] = True
        run = first.copy()
        run[1:n] |= kind[1:] != kind[:-1]
        begin = (_with_space if keep_space else _without_space)(code, kind, first, run)
        _contractions(code, kind, first, run, begin, keep_space)
        at = np.flatnonzero(begin[:n])
        if len(self.data) == n:
            byte_at = np.arange(n + 1)
        else:
            width = (code >= 0x80).astype(np.uint8)
            width += code >= 0x800
            width += code >= 0x10000
            byte_at = np.zeros(n + 1, np.int64)
            np.cumsum(width, out=byte_at[1:])
            byte_at += np.arange(n + 1)
        stop = np.append(at[1:], n)
        if not keep_space:
            words = kind[at] != SPACE
            at, stop = at[words], stop[words]
        self.start, self.stop = byte_at[at], byte_at[stop]
        self.owner = np.searchsorted(text_at, at, "right") - 1


def _without_space(code, kind, first, run) -> np.ndarray:
    """Runs of letters, single numbers, runs of others (white space is dropped later)."""
    begin = run.copy()
    begin[:-1] |= kind == NUMBER
    return begin


def _with_space(code, kind, first, run) -> np.ndarray:
    """Runs with at most one blank before them; other white space on its own."""
    n = len(code)
    begin = run.copy()
    space = kind == SPACE
    last = np.zeros(n, bool)  # last white space before a word of the same text
    last[:-1] = space[:-1] & ~space[1:] & ~first[1:n]
    begin[:n] |= last
    after = np.zeros(n, bool)  # word characters that follow a blank taken with them
    after[1:] = last[:-1] & (code[:-1] == BLANK)
    begin[:n] &= ~after
    return begin


def _contractions(code, kind, first, run, begin, keep_space: bool) -> None:
    """Mark 's 't 'm 'd 're 've 'll as words where an apostrophe starts a word."""
    n = len(code)
    at = np.flatnonzero((code == APOSTROPHE) & run[:n] & begin[:n])
    at = at[at + 1 < n]
    at = at[~first[at + 1] & (kind[at + 1] == LETTER)]
    if len(at) == 0:
        return
    one = code[at + 1]
    two = np.where((at + 2 < n) & ~first[np.minimum(at + 2, n)], code[np.minimum(at + 2, n - 1)], 0)
    short = np.isin(one, [ord(c) for c in SHORT])
    long = np.zeros(len(at), bool)
    for a, b in LONG:
        long |= (one == ord(a)) & (two == ord(b))
    for hit, size in ((short, 2), (long & ~short, 3)):
        here = at[hit]
        begin[here + 1] = False
        after = here + size
        begin[after] = True  # what follows is a word of its own


P1, P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)  # odd multipliers


def _inverse(p: np.uint64) -> np.uint64:
    return np.uint64(pow(int(p), -1, 1 << 64))


@lru_cache(maxsize=4)
def _powers(p: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(x):
        out = np.empty(n, np.uint64)
        out[0] = 1
        have = 1
        while have < n:  # doubling
            take = min(have, n - have)
            out[have:have + take] = out[:take] * np.uint64(pow(x, have, 1 << 64))
            have += take
        return out
    return run(p), run(int(_inverse(np.uint64(p))))


@lru_cache(maxsize=4)
def _letters(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def prefix_hash(data: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
    """(prefix sums of letter * p**i, inverse powers) to hash any substring as
    (sums[b] - sums[a]) * inverse[a], modulo 2**64."""
    p = int(P1 if which == 0 else P2)
    room = 1 << max(16, int(len(data) + 1).bit_length())
    power, inverse = _powers(p, room)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_letters(1000 + which)[data] * power[:len(data)], out=sums[1:])
    return sums, inverse


def span_hash(hashed, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    sums, inverse = hashed
    return (sums[stop] - sums[start]) * inverse[start]


def same(a: np.ndarray, b: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of one of each kind, kind of each); two independent 64-bit hashes
    and the length must agree for words to count as equal."""
    _, at, kind = np.unique(a, return_index=True, return_inverse=True)
    agree = (b == b[at[kind]]) & (size == size[at[kind]])
    if not agree.all():  # a collision of the first hash: make each odd word a kind of its own
        odd = np.flatnonzero(~agree)
        kind[odd] = len(at) + np.arange(len(odd))
        at = np.concatenate([at, odd])
    return at, kind


def hashes(words: Words) -> tuple[np.ndarray, np.ndarray]:
    return tuple(span_hash(prefix_hash(words.data, i), words.start, words.stop) for i in (0, 1))


class Vocabulary:
    """The different words of a list of texts.  Texts are split a small block at
    a time (arrays that stay in the cache), equal words are then joined across
    the blocks: data[start:stop] spells each of them."""

    BLOCK_CHARS = 1 << 20

    def __init__(self, texts: list[str], keep_space: bool):
        self.blocks, spelled, a, b, size = [], [], [], [], []
        for part in self._cut(texts):
            words = Words(part, keep_space)
            one, two = hashes(words)
            long = words.stop - words.start
            at, kind = same(one, two, long)
            spelled.append(words.data[gather(words.start[at], long[at])])
            a.append(one[at])
            b.append(two[at])
            size.append(long[at])
            self.blocks.append((len(part), words.owner, kind))
        self.data = np.concatenate([np.zeros(0, np.uint8), *spelled])
        sizes = np.concatenate([np.zeros(0, np.int64), *size])
        ends = np.cumsum(sizes)
        none = np.zeros(0, np.uint64)
        at, self.kind = same(np.concatenate([none, *a]), np.concatenate([none, *b]), sizes)
        self.start, self.stop = (ends - sizes)[at], ends[at]

    def _cut(self, texts):
        part, n = [], 0
        for t in texts:
            part.append(t)
            n += len(t)
            if n >= self.BLOCK_CHARS:
                yield part
                part, n = [], 0
        if part:
            yield part

    def counts(self) -> np.ndarray:
        """How often each word occurs."""
        n, done = np.zeros(len(self.start), np.int64), 0
        for _, _, kind in self.blocks:
            own = np.bincount(kind)
            n += np.bincount(self.kind[done:done + len(own)], weights=own, minlength=len(n)).astype(np.int64)
            done += len(own)
        return n

    def spell(self, pool: np.ndarray, first: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
        """Each text as the pool entries first[k] .. first[k]+size[k] of its words k."""
        out, done = [], 0
        for n, owner, kind in self.blocks:
            known = int(kind.max()) + 1 if len(kind) else 0
            k = self.kind[done:done + known][kind]
            done += known
            flat = pool[gather(first[k], size[k])]
            per = np.bincount(owner, weights=size[k], minlength=n).astype(np.int64)
            ends = np.cumsum(per)
            out += [flat[e - m:e] for e, m in zip(ends.tolist(), per.tolist())]
        return out


def gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions starts[i], starts[i]+1, ... (sizes[i] of them), for all i in turn."""
    ends = np.cumsum(sizes)
    out = np.repeat(starts - (ends - sizes), sizes)
    out += np.arange(len(out))
    return out
