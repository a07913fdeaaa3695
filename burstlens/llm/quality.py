"""Quality rules: a threshold table compiled into one Spark projection.

All measures are built-in expressions over the whole text (no user function,
no shuffle): words and lines come from ``split``, repeated 5-word windows from
an array of window hashes that is only re-examined with the exact windows
where two hashes agree.
"""

from __future__ import annotations

from functools import reduce

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
BASE_MIN_WORDS, BASE_MAX_REPEAT_PCT = 10, 20
# fixed values: very frequent function words
STOP_WORDS = (
    "the", "of", "and", "to", "a", "in", "is", "it", "that", "for", "was", "on", "are", "with", "as", "be", "at", "this",
    "der", "die", "und", "das", "den", "von", "zu", "mit", "ist", "des", "im", "für", "auf", "dem", "eine", "ein",
    "le", "la", "les", "de", "et", "des", "un", "une", "du", "en", "que", "est", "pour", "dans", "par", "qui", "pas",
    "el", "los", "las", "y", "se", "del", "por", "con", "una", "su", "para", "es", "al", "no",
)
# (rule, ratio, least, most); a text passes when every ratio lies inside its bounds
RULES = (
    ("length", "n_words", 10, 10_000_000),
    ("word_length", "word_chars / n_words", 1.5, 20.0),
    ("symbols", "n_symbols / n_words", 0.0, 0.1),
    ("shouting", "n_upper / word_chars", 0.0, 0.5),
    ("emphasis", "n_bang / n_words", 0.0, 0.3),
    ("stop_words", "(n_stop + 1) / n_words", 0.01, 2.0),
    ("dup_lines", "n_dup_lines / n_lines", 0.0, 0.5),
    ("repeats", "n_repeat_words / n_words", 0.0, 0.2),
)


def _stop_hashes() -> list[int]:
    """Spark's xxhash64 of every stop word, as written and capitalised."""
    forms = {f for w in STOP_WORDS for f in (w, w.capitalize())}
    return sorted(int.from_bytes(xxhash.xxh64_digest(f.encode(), 42), "big", signed=True) for f in forms)


def _measures(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    step = docs.select(
        "*", F.array_remove(F.split(text, SPACE), "").alias("_words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"))
    step = step.select(
        "*", F.size("_words").cast("long").alias("n_words"),
        F.aggregate("_words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        F.size(F.filter("_words", lambda w: w.endswith("!!"))).cast("long").alias("n_bang"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hash"))
    step = step.withColumn("n_stop", F.size(F.filter("_hash", lambda h: h.isin(*_stop_hashes()))).cast("long"))
    hashes = F.transform(F.sequence(F.lit(0), F.size("_hash") - WINDOW), lambda i: F.xxhash64(
        *(F.get("_hash", i + k) for k in range(WINDOW))))
    step = step.withColumn("_windows", F.when(F.size("_hash") >= WINDOW, hashes).otherwise(F.array().cast("array<bigint>")))
    exact = F.transform(F.sequence(F.lit(0), F.size("_hash") - WINDOW), lambda i: F.struct(
        F.array_join(F.slice("_words", i + 1, F.lit(WINDOW)), " ").alias("w"), i.alias("i")))
    suspect = F.size(F.array_distinct("_windows")) < F.size("_windows")
    step = step.withColumn("_sorted", F.when(suspect, F.sort_array(exact)).otherwise(
        F.array().cast("array<struct<w:string,i:int>>")))
    twice = F.filter("_sorted", lambda x, j: (F.get(F.col("_sorted"), j - 1)["w"].eqNullSafe(x["w"]))
                     | (F.get(F.col("_sorted"), j + 1)["w"].eqNullSafe(x["w"])))
    begins = F.sort_array(F.transform(twice, lambda x: x["i"]))
    covered = F.aggregate(begins, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
                          lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")),
                          lambda a: a["n"])
    step = step.withColumn("n_repeat_words", covered)
    return step.drop("_words", "_lines", "_hash", "_windows", "_sorted")


def passes(rules=RULES) -> Column:
    """The threshold table as one boolean expression over the measures."""
    def inside(ratio, least, most):
        return F.coalesce(F.expr(f"try_divide({ratio.replace(' / ', ', ')})" if " / " in ratio else ratio)
                          .between(least, most), F.lit(False))

    return reduce(lambda a, b: a & b, (inside(r, low, high) for _, r, low, high in rules), F.lit(True))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES,
            carry: str | None = None, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_words, measures, base_failed, kept) for every row.

    A null or empty text has no words and fails.  Rows with null or repeated
    ids are judged one by one.  ``rules`` may be replaced by another table of
    the same form; an empty table keeps all that the base rules keep.
    ``carry`` names a column that is handed through, ``keep_text`` keeps the text.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       *([F.col(f"`{carry}`")] if carry else []))
    out = _measures(rows)
    failed = (F.col("n_words") < BASE_MIN_WORDS) | (100 * F.col("n_repeat_words") > BASE_MAX_REPEAT_PCT * F.col("n_words"))
    # A condition on the verdict must not be pushed below the measures: it would
    # be rewritten in terms of the text, with every shared step repeated.  The
    # always-true test on a row number keeps it above.
    here = F.monotonically_increasing_id() >= 0
    out = out.withColumn("base_failed", failed & here).withColumn("kept", ~F.col("base_failed") & passes(rules) & here)
    return out if keep_text else out.drop("text")
