"""Deep pages by the order-statistic index against one whole sort."""

import pytest

from conftest import SMALL
from pyspark.sql import functions as F

from burstlens.operators import explorer as X
from burstlens.operators import paging as P
from burstlens.operators.filters import SORT_KEYS, EventQuery
from burstlens.sources import staging


@pytest.fixture(scope="module")
def odd(spark):
    """400 rows: a third share a value, a third have none, the others differ or tie in pairs."""
    n = F.col("id")
    some = lambda c: F.when(n % 3 == 0, F.lit(5)).when(n % 3 == 1, F.lit(None)).otherwise(c)
    number = F.when(n % 31 == 2, F.lit("NaN").cast("double")).otherwise(some(F.floor(n / 6)).cast("double"))
    return spark.range(400).select(
        F.concat(F.lit("id-"), F.format_string("%03d", (n * 7) % 400)).alias("id"),
        F.when(n % 50 != 9, F.date_add(F.lit("2024-01-01").cast("date"), (n % 5).cast("int"))).alias("event_date"),
        F.timestamp_seconds(some(n)).cast("timestamp_ntz").alias("local_timestamp"),
        *(some(F.floor(n / 6)).cast("string").alias(c) for c in ("camera_name", "event_group", "subject_class", "category")),
        *(some(F.floor(n / 6)).cast("int").alias(c) for c in ("sequence", "raw_lux", "heat_level")),
        number.alias("raw_temperature"))


@pytest.fixture(scope="module")
def built(spark, odd):
    import tempfile
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/index"
    P.index(odd, 60).write.partitionBy("form", "part").parquet(path)
    indexed = spark.read.parquet(path)
    return indexed, P.starts(indexed)


@pytest.mark.parametrize("form", P.FORMS)
def test_pages_equal_the_sorted_rows(odd, built, form):
    key, way = form.rsplit("_", 1)
    order = [X._pg_order(SORT_KEYS[key], way), F.col("id").asc()]
    want = [r["id"] for r in odd.orderBy(*order).select("id").collect()]
    ranges = built[1].filter(F.col("form") == form).orderBy("part").collect()
    assert len(ranges) > 2 and sum(r["rows"] for r in ranges) == 400
    for page, size in ((1, 7), (2, 100), (21, 19), (400, 1), (3, 150), (401, 1)):
        got = P.page_keys(*built, EventQuery(page=page, page_size=size, sort_by=key, sort_dir=way)).collect()
        assert sorted(r["id"] for r in got) == sorted(want[(page - 1) * size:page * size]), (page, size)


def test_empty_table(spark, odd):
    none = P.index(odd.limit(0), 4)
    assert P.page_keys(none, P.starts(none), EventQuery()).count() == 0


def test_rows_without_a_date_are_found(spark, scratch):
    canon = staging.canonical_table(spark, SMALL)
    blank = canon.withColumn("event_date", F.when(F.col("sequence") != 2, F.col("event_date")))
    P.index(blank, 20).write.partitionBy("form", "part").parquet(f"{scratch}/index")
    indexed = spark.read.parquet(f"{scratch}/index")
    query = EventQuery(page=3, page_size=40)
    sizes = blank.groupBy("event_group").agg(F.count(F.lit(1)).cast("int").alias("event_group_size"))
    got = P.events_page_at(blank, indexed, P.starts(indexed), query, sizes)
    want = X.events_page(blank, query)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() == 40


def test_filters_are_refused(spark):
    with pytest.raises(ValueError):
        P.events_page_at(None, None, None, EventQuery(min_lux=3), None)


def test_a_deep_page_opens_two_ranges_at_most(spark):
    indexed, ranges = staging.pages_table(spark, SMALL), staging.page_starts_table(spark, SMALL)
    total = len(indexed.inputFiles())
    for page in (1, 77, 400):  # the table has 400 pages of 25
        df = P.page_keys(indexed, ranges, EventQuery(page=page, page_size=25, sort_by="lux", sort_dir="desc"))
        assert df.count() == 25
        df.collect()
        plan = df._jdf.queryExecution().executedPlan()  # noqa: SLF001
        if "AdaptiveSparkPlan" in plan.nodeName():
            plan = plan.finalPhysicalPlan()
        leaves = plan.collectLeaves()
        opened = [leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()) if "Scan parquet" in leaves.apply(i).nodeName()]
        assert len(opened) == 1 and 1 <= opened[0] <= 2 < total
