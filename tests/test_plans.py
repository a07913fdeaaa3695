"""Plan shape checks: what would hurt at scale must not appear."""

import pytest

from conftest import SMALL

from __spark_entry__ import queries


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001


@pytest.mark.parametrize("key", sorted(queries()))
def test_no_cartesian_product_or_python_udf(spark, key):
    text = plan_text(queries()[key](spark, SMALL))
    assert "CartesianProduct" not in text
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text


def test_building_a_query_runs_no_job(spark):
    from burstlens.plans.registry import QUERIES, canon
    from burstlens.sources import staging
    canon(spark, SMALL)
    staging.stage_all(spark, SMALL)  # the staged tables are the only thing written
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("build-only", "")
    try:
        for key in QUERIES:
            QUERIES[key](spark, SMALL)
        assert list(tracker.getJobIdsForGroup("build-only")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_canonical_scan_is_pruned(spark):
    df = queries()["composition"](spark, SMALL)
    text = df._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001
    scans = [line for line in text.splitlines() if "FileScan parquet" in line or "ReadSchema" in line]
    assert scans
    read = text[text.index("ReadSchema"):].split("\n")[0]
    assert "subject_category" in read and "event_group" in read and "analysis" not in read


def test_date_filter_prunes_folders(spark):
    df = queries()["day_summary_totals"](spark, SMALL)
    assert "PartitionFilters: [isnotnull(event_date" in plan_text(df)
    assert "(event_date#" in plan_text(df).split("PartitionFilters: ")[1].split("]")[0]
