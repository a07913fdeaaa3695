"""Training-corpus pipeline: quality rules, line dedup, SimHash near-dedup,
secret redaction, sequence packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept; its result is written as Parquet and read again.  All stages but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burstlens.llm import lines, packing, quality, secrets, simhash
from burstlens.llm.common import documents, stage
from burstlens.llm.queries import tokenizer_path

# SQL can express neither the edit join nor the packing plan; the tests check
# the stages one after the other on a small fixture with known results
ORACLE_SQL = None


def _struct(docs: DataFrame, *but: str):
    """The columns other than ``but`` as one struct, so that no name can clash."""
    names = [c for c in docs.columns if c not in but]
    return F.struct(*(F.col(f"`{c}`") for c in names) if names else [F.lit(None).cast("int").alias("none")])


def _documents(rows: DataFrame, like: DataFrame, as_was: bool = False) -> DataFrame:
    """The columns of ``like`` from (doc_id, text, other); n_chars follows the
    text unless the texts are ``as_was``."""
    def column(c):
        if c in ("doc_id", "text"):
            return F.col(c)
        if c == "n_chars" and not as_was:
            return F.length("text").cast("long").alias(c)
        return F.col("other").getField(c).alias(c)

    return rows.select(*(column(c) for c in like.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others stay as they are."""
    judged = quality.quality(docs.select("doc_id", "text", _struct(docs, "doc_id", "text").alias("other")), carry="other", keep_text=True)
    return _documents(judged.filter("kept"), docs, as_was=True)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and nearly repeated lines go; a document whose words all went goes too."""
    found = lines.deduplicate(docs)
    changed = F.col("n_exact") + F.col("n_near") > 0
    left = found.filter(~changed | F.col("kept").rlike(r"[^\x20\x09-\x0D]"))
    return _documents(left.select("doc_id", F.col("kept").alias("text"), "other"), docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest doc_id, once
    if its row repeats.  Rows without an id go where a row with an id is linked
    to them; the others have no group leader and stay."""
    found = simhash.near_duplicates(docs, distance=2, words_per_shingle=3, text_key=True)
    first = stage(found.filter("doc_id = component_id or component_id is null").select("doc_id", "tag").distinct(), "first")
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("tag"))
    kept = keyed.join(first.withColumnRenamed("tag", "first_tag"), F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("tag") == F.col("first_tag")))
    once = kept.filter("id is not null").dropDuplicates(["id"])
    return once.unionAll(kept.filter("id is null")).select("row.*")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by the name of its kind."""
    other = _struct(docs, "doc_id", "text")
    found = secrets.scan(docs.select("doc_id", "text", other.alias("other")), keep_text=True, carry="other")
    clean = F.when(F.col("text").isNotNull(), secrets.redacted(F.col("text"), F.col("spans")))
    return _documents(found.select("doc_id", clean.alias("text"), "other"), docs)


def packing_plan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every token piece goes: (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), capacity=2048)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("secret_scan", secret_scan),
    ("packing", packing_plan),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``."""
    docs = documents(spark, sf_dir)
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
