"""Secret scan: base patterns plus sliding-window entropy (DataFrame functions only).

Base kinds are found leftmost and non-overlapping on the whole text.  Offsets
come without a user function: ``split`` by the same pattern gives the pieces
between the matches, and running lengths of pieces and matches give the code
point positions.

On top of them, *candidate strings* (maximal runs of ``CANDIDATE`` characters)
are scored by the Shannon entropy of every ``WINDOW``-character window.  The
character counts of a window are updated incrementally: the entering character
adds f(c+1)-f(c) and the leaving one f(c-1)-f(c), f(c) = c*log2(c), so
H = log2(W) - sum(f)/W.  Each character class has its own threshold, and
allow-listed shapes (identifiers made of plain words, UUIDs, paths, alphabets,
examples, digests named as such, runs of few symbols) are suppressed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# fixed values: the base kinds in their listed order; (name, pattern, group that is measured, least characters)
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    # a maximal run shorter than 32 fails as a whole, so the bound can stand in the pattern
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
# class name, what the whole candidate looks like, its alphabet, least entropy in bits of a window
CLASSES = (
    ("hexent", r"^[0-9A-Fa-f]+$", "0123456789abcdefABCDEF", 3.0),
    ("b64ent", r"^(?=.*[0-9])(?=.*[A-Za-z]).+$",
     "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.8),
)
SAMPLES = "example|placeholder|changeme|xxxxxx|abcdefgh|01234567"  # samples and alphabets
# no repeated groups here: each repetition would take a stack frame, and candidates have any length
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # UUID
    r"^[A-Za-z][A-Za-z_/=-]*[A-Za-z]$",  # plain words joined by separators
    r"^[0-9_/=+-]+$",  # numbers, dates, telephone numbers
    # a sample word clears its own segment; any other segment as long as a window is still judged
    rf"(?i)^(?=.*(?:{SAMPLES}))(?!.*(?:^|/)(?![^/]*(?:{SAMPLES}))[^/]{{{WINDOW}}})",
    r"^(sha1|sha256|sha512|md5)[-=:_]",  # a digest that says so
    r"^(?!.*//)(?!.*[a-z0-9_-]{13}/)(?!.*[a-z0-9]{13})/?[a-z0-9_-]+/[a-z0-9_-]+/[a-z0-9_/-]*$",  # a path of short names
)
KINDS = tuple(b[0] for b in BASE) + tuple(c[0] for c in CLASSES)
SPAN = "array<struct<start:int,rank:int,stop:int,kind:string,hit:string>>"


def _positions(text: Column, pattern: str, kind: str) -> Column:
    """Every leftmost non-overlapping match as (start, rank, stop, kind, hit)."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    empty = F.array().cast(SPAN)

    def put(acc, x):
        start = acc["pos"] + F.length(x["gap"])
        stop = start + F.length(x["hit"])
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), stop.alias("stop"),
                        F.lit(kind).alias("kind"), x["hit"].alias("hit"))
        return F.struct(stop.alias("pos"), F.concat(acc["out"], F.array(span)).cast(SPAN).alias("out"))

    pairs = F.zip_with(F.slice(between, F.lit(1), F.size(hits)), hits,
                       lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")))
    found = F.aggregate(pairs, F.struct(F.lit(0).alias("pos"), empty.alias("out")), put, lambda acc: acc["out"])
    return F.when(F.size(hits) > 0, found).otherwise(empty)


def _long_enough(pattern: str, group: int, least: int):
    return lambda x: F.length(F.regexp_extract(x["hit"], pattern, group)) >= least


def window_entropy(s: Column, alphabet: str) -> Column:
    """Highest Shannon entropy (bits per character) of a ``WINDOW`` window of ``s``."""
    n = len(alphabet)

    def f(c):
        return F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))

    def step(chars, acc, i):
        into = F.instr(F.lit(alphabet), F.get(chars, i - 1))
        out = F.when(i > WINDOW, F.instr(F.lit(alphabet), F.get(chars, i - WINDOW - 1))).otherwise(F.lit(0))
        c_in, c_out = F.get(acc["counts"], into - 1), F.get(acc["counts"], out - 1)
        change = F.when(into == out, F.lit(0.0)).otherwise(
            f(c_in + 1) - f(c_in) + F.when(out > 0, f(c_out - 1) - f(c_out)).otherwise(F.lit(0.0)))
        counts = F.transform(acc["counts"], lambda c, k: c + (k == into - 1).cast("int") - (k == out - 1).cast("int"))
        total = acc["sum"] + change
        best = F.when(i >= WINDOW, F.greatest(acc["best"], F.log2(F.lit(float(WINDOW))) - total / WINDOW)).otherwise(acc["best"])
        return F.struct(counts.alias("counts"), total.alias("sum"), best.alias("best"))

    start = F.struct(F.array_repeat(F.lit(0), n).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))
    # the characters are cut once, as a one-element array that binds them for all steps
    best = F.transform(F.array(F.split(s, "")), lambda chars: F.aggregate(
        F.sequence(F.lit(1), F.length(s)), start, lambda acc, i: step(chars, acc, i), lambda acc: acc["best"]))
    return F.get(best, F.lit(0))


def _allowed(s: Column) -> Column:
    hit = F.lit(False)
    for pattern in ALLOW:
        hit = hit | s.rlike(pattern)
    return hit


def _entropy_spans(candidates: Column) -> Column:
    """Candidates whose best window reaches the threshold of their class."""
    def label(x):
        out = F.lit(None).cast("string")
        for name, shape, alphabet, least in reversed(CLASSES):
            high = window_entropy(x["hit"], alphabet) >= least
            out = F.when(x["hit"].rlike(shape), F.when(high, F.lit(name))).otherwise(out)
        return F.when(~_allowed(x["hit"]), out)

    marked = F.transform(candidates, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"),
                                                        label(x).alias("kind"), x["hit"].alias("hit")))
    ranked = lambda x: F.when(x["kind"] == CLASSES[0][0], F.lit(KINDS.index(CLASSES[0][0]))).otherwise(
        F.lit(KINDS.index(CLASSES[1][0])))
    return F.transform(F.filter(marked, lambda x: x["kind"].isNotNull()), lambda x: F.struct(
        x["start"].alias("start"), ranked(x).alias("rank"), x["stop"].alias("stop"), x["kind"].alias("kind"),
        x["hit"].alias("hit"))).cast(SPAN)


def secret_spans(text: Column) -> dict[str, Column]:
    """Span arrays of each base kind and of the candidates, on a non-null text."""
    spans = {}
    for name, pattern, group, least in BASE:
        found = _positions(text, pattern, name)
        if group or name == "access":
            found = F.filter(found, _long_enough(pattern, group, least))
        spans[name] = found
    return spans


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False,
         carry: str | None = None) -> DataFrame:
    """(doc_id, base, extra, spans[, text]) for every row, no shuffle.

    base: kept base spans, sorted by start then kind; extra: entropy spans not
    inside a base span; spans: both, sorted.  Each span has start and stop in
    code points (stop exclusive), kind and the matched string.  A null or empty
    text has no spans; repeated rows and null ids pass through unchanged.
    """
    cols = ["doc_id", *(["text"] if keep_text else []), *([carry] if carry else [])]
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       *([F.col(f"`{carry}`")] if carry else []))
    found = secret_spans(text)
    step = rows.select(*cols, *(c.alias(n) for n, c in found.items()),
                       _positions(text, CANDIDATE, CLASSES[0][0]).alias("candidates"))
    step = step.select(*cols, F.array_sort(F.concat(*(F.col(b[0]) for b in BASE))).alias("base"),
                       _entropy_spans(F.col("candidates")).alias("entropy"))
    extra = F.filter("entropy", lambda e: ~F.exists("base", lambda b: (b["start"] <= e["start"]) & (b["stop"] >= e["stop"])))
    step = step.select(*cols, "base", extra.alias("extra"))
    return step.select(*cols, "base", "extra", F.array_sort(F.concat("base", "extra")).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span (overlaps merged) replaced by ``[kind]``."""
    def put(acc, s):
        fresh = s["start"] >= acc["pos"]
        out = F.when(fresh, F.concat(acc["out"], F.substring(text, acc["pos"] + 1, s["start"] - acc["pos"]),
                                     F.lit("["), s["kind"], F.lit("]"))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["pos"], s["stop"]).alias("pos"), out.alias("out"))

    done = F.aggregate(spans, F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")), put,
                       lambda acc: F.concat(acc["out"], F.substring(text, acc["pos"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
