"""Trigram search against ``ilike`` on every row."""

import datetime as dt

import pytest

from conftest import SMALL
from pyspark.sql import functions as F

from burstlens.operators import search as S
from burstlens.operators.filters import Filters
from burstlens.sources import staging

TEXTS = [("Elk at dawn", "a WOLF near the den"), (None, "100% sure_thing"), ("", None), (None, None), ("ab", "abc"), ("abc", "ab"),
         ("Straße NACH", "Ünder the brücke"), ("KELVIN Klimb", "wolf\nden"), ("x" * 30000 + "needle" + "y" * 30000, "deep"),
         ("back\\slash", "w%lf"), ("aaaa", "aa"), ("İstanbul", "wolfden"), ("a wolf", "a den"), ("wol", "f den")]
PATTERNS = ["WOLF near", "w%den", "100\\%", "sure_thing", "abc", "", "___", "straße", "klimb", "xneedley", "aaaaa", "istanbul",
            "back\\\\slash", "wolf den", "wolf%wolf"]


@pytest.fixture(scope="module")
def index(spark):
    import tempfile
    days = [dt.date(2024, 1, 1), dt.date(2024, 1, 2), None]
    rows = [(f"{i}-{j}", days[(i + j) % 3], t, s) for i, (t, s) in enumerate(TEXTS) for j in range(1 if i else 200)]  # a hot text
    canon = spark.createDataFrame(rows, "id string, event_date date, analysis_title string, analysis_summary string")
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    made = []
    for name, frame, by in (("texts", lambda: S.texts(canon, 3), None), ("postings", lambda: S.postings(made[0]), "bucket"),
                            ("counts", lambda: S.counts(made[1]), "bucket"), ("places", lambda: S.places(canon, made[0]), "part")):
        writer = frame().write if by is None else frame().write.partitionBy(by)
        writer.parquet(f"{root}/{name}")
        made.append(spark.read.parquet(f"{root}/{name}"))
    return canon, made


@pytest.mark.parametrize("q", PATTERNS)
def test_equals_ilike(index, q):
    canon, tables = index
    got = sorted(r["id"] for r in S.events(canon, *tables, q).collect())
    shown = F.col("id") if not q else F.when(Filters(q=q).predicate(), F.col("id"))
    want = sorted(r[0] for r in canon.select(shown).collect() if r[0] is not None)
    assert got == want


def test_empty_table(spark, index):
    canon, _ = index
    none = canon.limit(0)
    texts = S.texts(none, 2)
    lists = S.postings(texts)
    assert S.events(none, texts, lists, S.counts(lists), S.places(none, texts), "wolf").count() == 0


def test_a_text_is_kept_once(index):
    canon, (texts, lists, lengths, where) = index
    assert texts.count() == len({(t or "", s or "") for t, s in TEXTS}) and where.count() == canon.count()
    assert lists.count() == lists.distinct().count() == lengths.agg(F.sum("n")).first()[0]


def test_lists_and_ranges_are_pruned(spark):
    texts, lists, lengths, where = staging.search_tables(spark, SMALL)
    text = S.events(staging.canonical_table(spark, SMALL), texts, lists, lengths, where, "near the wolf") \
        ._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001
    pruned = [p.split("PushedFilters")[0] for p in text.split("PartitionFilters: [")[1:]]
    for column in ("bucket#", "part#", "event_date#"):
        assert any(column in p for p in pruned), column
