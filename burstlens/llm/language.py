"""Language identification: script ranges, per-word scores, Viterbi spans.

Learning counts hashed letter trigrams (with word ends) and scripts of every
labelled training text, a fixed number of counters per language.  Predicting,
the script of a word leaves only the languages that are written in it, each of
which scores the word by the log probabilities of its trigrams; a Viterbi pass
with a penalty for every change of language then labels the words, so a text
in several languages falls into spans.  The text's language is the one that
labels most letters.
"""

from __future__ import annotations

import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import texts_in

BUCKET_BITS = 15
SMOOTHING = 0.5
SWITCH = 12.0  # log-probability that a change of language costs
SCRIPT_SHARE = 0.01  # least share of a language's letters for a script to be one of its own
BARRED = -60.0  # score of a word in a language that isn't written in its script
UNKNOWN = "und"
BLOCK_BYTES = 2 << 20
# fixed values: first and last code point of the main Unicode script blocks
SCRIPTS = (
    ("Latin", 0x41, 0x24F), ("Latin", 0x1E00, 0x1EFF), ("Greek", 0x370, 0x3FF), ("Greek", 0x1F00, 0x1FFF),
    ("Cyrillic", 0x400, 0x52F), ("Armenian", 0x530, 0x58F), ("Hebrew", 0x590, 0x5FF), ("Arabic", 0x600, 0x6FF),
    ("Arabic", 0x750, 0x77F), ("Devanagari", 0x900, 0x97F), ("Bengali", 0x980, 0x9FF), ("Tamil", 0xB80, 0xBFF),
    ("Telugu", 0xC00, 0xC7F), ("Thai", 0xE00, 0xE7F), ("Georgian", 0x10A0, 0x10FF), ("Hangul", 0x1100, 0x11FF),
    ("Kana", 0x3040, 0x30FF), ("Han", 0x3400, 0x9FFF), ("Hangul", 0xAC00, 0xD7AF), ("Han", 0x20000, 0x2FFFF),
)
NAMES = ("Other", *dict.fromkeys(s[0] for s in SCRIPTS))


@lru_cache(maxsize=1)
def _tables():
    """Lower-case letter of every code point (0 if it isn't a letter), its script."""
    low = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            one = c.lower()
            low[i] = ord(one) if len(one) == 1 else i
    script = np.zeros(0x110000, np.uint8)
    for name, a, b in SCRIPTS:
        script[a:b + 1] = NAMES.index(name)
    return low, script


class Letters:
    """Letters of a list of texts: trigram bucket and word of each, and the
    owner text, script and place (code points) of each word."""

    def __init__(self, texts: list[str]):
        low, script = _tables()
        code = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        begin = np.cumsum(size) - size
        c = low[code].astype(np.uint64)
        at = np.flatnonzero(c)
        before = np.concatenate([np.zeros(1, np.uint64), c[:-1]])[at]
        after = np.append(c[1:], np.uint64(0))[at]
        mixed = (before * np.uint64(0x9E3779B97F4A7C15)) ^ (c[at] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (after * np.uint64(0x165667B19E3779F9))
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        self.bucket = (mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        self.first = np.flatnonzero(before == 0)  # first letter of each word
        self.size = np.diff(np.append(self.first, len(at)))
        start = at[self.first]
        self.owner = np.searchsorted(begin, start, "right") - 1
        self.start = start - begin[self.owner]
        self.script = script[code[start]]
        self.letter_script = script[code[at]]


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict:
    """Counters of all rows with a text, a label and an id that isn't held out:
    {languages, trigrams[bucket, language], scripts[script, language]}."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"),
                       F.col(id_col).alias("i")).filter("lang is not null and text is not null and i is not null")
    rows = rows.filter(~held_out(F.col("i"))).select("lang", "text")
    width = (1 << BUCKET_BITS) + len(NAMES)

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for row, texts in texts_in(batch.column(1), BLOCK_BYTES):
                by: dict[str, list[str]] = {}
                for lang, text in zip(langs[row:], texts):
                    by.setdefault(lang, []).append(text)
                for lang, own in by.items():
                    found = Letters(own)
                    now = sums.setdefault(lang, np.zeros(width, np.int64))
                    now += np.bincount(np.concatenate([found.bucket, found.letter_script.astype(np.int64) + (1 << BUCKET_BITS)]), minlength=width)
        for lang, now in sums.items():
            at = np.flatnonzero(now)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(now[at], pa.int64())],
                                             ["lang", "counter", "n"])

    # at most (buckets + scripts) rows per language
    counted = rows.mapInArrow(run, "lang string, counter int, n long").groupBy("lang", "counter").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counted["lang"].unique().tolist())
    table = np.zeros((width, len(languages)))
    table[counted["counter"].to_numpy(np.int64), np.searchsorted(np.array(languages, object), counted["lang"].to_numpy(object)) if languages else []] = counted["n"]
    return {"languages": languages, "trigrams": table[:1 << BUCKET_BITS], "scripts": table[1 << BUCKET_BITS:]}


class Model:
    def __init__(self, counters: dict):
        self.languages = counters["languages"]
        n = counters["trigrams"] + SMOOTHING
        self.score = np.log(n / n.sum(0)).astype(np.float32)
        total = counters["scripts"].sum(0)
        own = counters["scripts"] >= np.maximum(SCRIPT_SHARE * total, 1e-9)
        own[~own.any(1)] = True  # nobody's script narrows nothing
        self.barred = np.where(own, 0.0, BARRED).astype(np.float32)

    def words(self, letters: Letters) -> np.ndarray:
        """Score of each word in each language."""
        if not len(letters.first):
            return np.zeros((0, len(self.languages)), np.float32)
        return np.add.reduceat(self.score[letters.bucket], letters.first, axis=0) + self.barred[letters.script]

    @staticmethod
    def viterbi(score: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Best label of each word; all texts advance together, longest first."""
        label = np.zeros(len(score), np.int64)
        if not len(score):
            return label
        texts, first, size = np.unique(owner, return_index=True, return_counts=True)
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        active = np.searchsorted(-size, -np.arange(size[0]), "left")  # texts longer than t words
        best = score[first].copy()
        back = [None]
        own = np.arange(score.shape[1])
        for t in range(1, size[0]):
            n = active[t]
            now = best[:n]
            top = now.argmax(1)
            limit = now[np.arange(n), top][:, None] - SWITCH
            stay = now >= limit
            back.append(np.where(stay, own, top[:, None]).astype(np.uint8 if len(own) < 256 else np.int32))
            best[:n] = np.where(stay, now, limit) + score[first[:n] + t]
            best[:n] -= best[:n].max(1, keepdims=True)  # keep the numbers small
        state = best.argmax(1)
        for t in range(size[0] - 1, 0, -1):
            n = active[t]
            label[first[:n] + t] = state[:n]
            state[:n] = back[t][np.arange(n), state[:n]]
        label[first] = state
        return label


_KEPT: dict[str, Model] = {}


def predict(docs: DataFrame, counters: dict, id_col: str = "doc_id", text_col: str = "text", keep_spans: bool = False) -> DataFrame:
    """(doc_id, held_out, lang_pred, score[, spans]) for every row.

    score is the share of letters that carry the predicted language; ``und``
    and 0 if the text is null, has no letters, or nothing was learned.  spans
    lists (lang, first, end) in code points.  Rows with a null id are never
    held out; repeated rows are predicted one by one.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(counters)  # buckets and scripts times languages
    key = uuid.uuid4().hex

    def run(batches):
        if key not in _KEPT:
            _KEPT.clear()
            _KEPT[key] = Model(shared.value)
        model = _KEPT[key]
        names = np.array([*model.languages, UNKNOWN], object)
        none = len(model.languages)
        for batch in batches:
            for row, texts in texts_in(batch.column(1), BLOCK_BYTES):
                pred, share = np.full(len(texts), none), np.zeros(len(texts))
                spans = [[] for _ in texts] if keep_spans else None
                letters = Letters(texts)
                if none and len(letters.first):
                    label = model.viterbi(model.words(letters), letters.owner)
                    votes = np.bincount(letters.owner * none + label, weights=letters.size, minlength=len(texts) * none).reshape(-1, none)
                    total = votes.sum(1)
                    some = total > 0
                    pred[some] = votes[some].argmax(1)
                    share[some] = votes[some].max(1) / total[some]
                    if keep_spans:
                        new = np.flatnonzero(np.concatenate([[True], (label[1:] != label[:-1]) | (letters.owner[1:] != letters.owner[:-1])]))
                        last = np.append(new[1:], len(label)) - 1
                        for o, a, l, b in zip(letters.owner[new], letters.start[new], label[new], letters.start[last] + letters.size[last]):
                            spans[o].append({"lang": model.languages[l], "first": int(a), "end": int(b)})
                cols = [batch.column(0).slice(row, len(texts)), batch.column(2).slice(row, len(texts)),
                        pa.array(names[pred].tolist(), pa.string()), pa.array(share, pa.float64())]
                if keep_spans:
                    cols.append(pa.array(spans, pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("end", pa.int32())]))))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "lang_pred", "score"] + ["spans"] * keep_spans)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), held_out(F.col(id_col)).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double"
                           + ", spans array<struct<lang:string,first:int,end:int>>" * keep_spans)


def identify(docs: DataFrame, keep_spans: bool = False, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the labelled rows that aren't held out, predict every row."""
    return predict(docs, learn(docs, id_col, text_col, lang_col), id_col, text_col, keep_spans)
