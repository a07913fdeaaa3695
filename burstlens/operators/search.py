"""Text search (F7) over trigram posting lists, with exact verification.

* ``texts``: every different (title, summary) once, numbered in sorted order.
* ``postings``: (gram, text number) for each three characters in a row of the
  lower-cased title or summary, one folder a hash bucket of the gram;
  ``counts`` holds the length of each list.
* ``places``: (text number, date, id) of every event, one folder a range of
  text numbers.

A pattern keeps its wildcards.  Any text it matches holds all the grams of its
literal pieces, so the few rarest of them give a list that misses nothing;
``ilike`` then judges each listed text, once however many events carry it.  The
matching numbers name the ranges of ``places`` to open, those the dates of the
events.  A pattern without a usable gram (short pieces, escapes) is judged on
all texts, still not on events.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .paging import ROW_BITS

GRAM = 3
BUCKETS = 64
RAREST = 3  # lists read for a pattern; the judgement is exact whatever their number


def bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def _shown(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def texts(canon: DataFrame, parts: int) -> DataFrame:
    """(text_no, title, summary); the numbers belong to one run, so write it."""
    pairs = canon.select(_shown("analysis_title").alias("title"), _shown("analysis_summary").alias("summary")).distinct()
    return (pairs.repartitionByRange(parts, "title", "summary").sortWithinPartitions("title", "summary")
            .select(F.monotonically_increasing_id().alias("text_no"), "title", "summary"))


def _grams(text: Column) -> Column:
    chars = F.split(F.lower(text), "")
    at = F.sequence(F.lit(0), F.size(chars) - GRAM)
    whole = F.transform(at, lambda i: F.array_join(F.slice(chars, i + 1, GRAM), ""))
    return F.when(F.size(chars) >= GRAM, F.array_distinct(whole)).otherwise(F.array().cast("array<string>"))


def postings(numbered: DataFrame) -> DataFrame:
    """(gram, text_no, bucket) of written ``texts``."""
    both = F.array_union(_grams(F.col("title")), _grams(F.col("summary")))
    return numbered.select(F.explode(both).alias("gram"), "text_no").withColumn("bucket", bucket(F.col("gram")))


def counts(lists: DataFrame) -> DataFrame:
    return lists.groupBy("gram", "bucket").agg(F.count(F.lit(1)).alias("n"))


def places(canon: DataFrame, numbered: DataFrame) -> DataFrame:
    """(text_no, event_date, id, part); a text on a third of all events is split
    by the adaptive join."""
    events = canon.select("id", "event_date", _shown("analysis_title").alias("title"), _shown("analysis_summary").alias("summary"))
    return events.join(numbered, ["title", "summary"]).select("text_no", "event_date", "id", F.shiftright("text_no", ROW_BITS).alias("part"))


def pattern_grams(q: str) -> list[str]:
    """Grams every match must hold: of ASCII pieces between wildcards (engines
    agree on the lower case of those).  None if the pattern escapes something."""
    if "\\" in q:
        return []
    grams = {p[i:i + GRAM] for p in re.split("[%_]", q.lower()) for i in range(len(p) - GRAM + 1)}
    return sorted(g for g in grams if g.isascii())


def matching_texts(numbered: DataFrame, lists: DataFrame, lengths: DataFrame, q: str) -> DataFrame:
    """(text_no) of the texts that ``%q%`` matches without regard to case."""
    grams = pattern_grams(q)
    if grams:
        folders = F.col("bucket").isin([bucket(F.lit(g)) for g in grams])
        known = lengths.filter(folders & F.col("gram").isin(grams))
        rare = known.agg(F.struct(
            F.count(F.lit(1)).alias("known"),
            F.transform(F.slice(F.sort_array(F.collect_list(F.struct("n", "gram"))), 1, RAREST), lambda x: x["gram"]).alias("grams"))).scalar()
        listed = lists.filter(folders & (rare.getField("known") == len(grams)) & F.array_contains(rare.getField("grams"), F.col("gram")))
        held = listed.groupBy("text_no").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == min(RAREST, len(grams)))
        numbered = numbered.join(held, "text_no", "left_semi")
    pattern = f"%{q}%"
    return numbered.filter(F.col("title").ilike(pattern) | F.col("summary").ilike(pattern)).select("text_no")


def events(canon: DataFrame, numbered: DataFrame, lists: DataFrame, lengths: DataFrame, where: DataFrame, q: str) -> DataFrame:
    """The canonical rows F7 keeps, open to any other filter or report.  Ids are
    unique, as the event store keeps them."""
    found = matching_texts(numbered, lists, lengths, q)
    ranges = found.agg(F.collect_set(F.shiftright("text_no", ROW_BITS).cast("int"))).scalar()  # at most the ranges there are
    held = where.filter(F.array_contains(ranges, F.col("part"))).join(found, "text_no", "left_semi")
    dates = held.agg(F.collect_set("event_date")).scalar()  # calendar dates
    on_dates = F.array_contains(dates, F.col("event_date")) | F.col("event_date").isNull()
    return canon.filter(on_dates).join(held.select("id"), "id", "left_semi").select(*canon.columns)
