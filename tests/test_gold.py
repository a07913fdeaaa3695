"""Gold tables: states that merge, running totals, and cells that count exactly."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from burstlens.operators import canonical as C
from burstlens.operators import gold as G
from burstlens.operators import lab as L
from burstlens.operators import reports as R
from burstlens.operators.filters import Filters
from burstlens.plans import registry
from burstlens.sources import staging
from conftest import SMALL, raw_frame


def rows_of(df):
    def plain(v):
        return round(v, 9) if isinstance(v, float) else v

    return sorted((tuple(plain(v) for v in r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def canon(spark):
    """A hot group, groups over several dates, rows without any group, clock or category."""
    rnd = random.Random(4)
    rows = []
    for i in range(1500):
        t = dt.datetime(2024, 1, 1) + dt.timedelta(hours=rnd.randint(0, 24 * 12))
        group = "hot" if i % 3 == 0 else f"g{rnd.randint(0, 200)}"
        rows.append({"id": f"e{i}" if i % 50 else None, "event": group if i % 40 else None, "name": f"cam-{rnd.randint(0, 4)}",
                     "mac": f"m{rnd.randint(0, 3)}", "timestamp": t if i % 30 else None, "utc_timestamp": t if i % 30 else None,
                     "created": t + dt.timedelta(seconds=rnd.randint(0, 900)), "voltage": rnd.choice([None, 11.0, 12.5]),
                     "temperature": rnd.choice([None, 3.5, 20.25]), "lux": rnd.choice([None, 3, 90]), "uploaded": rnd.choice([None, True, False]),
                     "ai_processed": rnd.choice([None, True, False]), "analysis_summary": rnd.choice([None, "an elk walks", "a truck and a person"]),
                     "subject_class": rnd.choice([None, "elk", "truck", "hiker"])})
    return C.canonical(raw_frame(spark, rows)).persist()


def test_group_states_give_the_roll_up(canon):
    states = G.merged(G.group_states(canon, "event_date").drop("event_date"))
    assert rows_of(G.event_groups(states)) == rows_of(C.event_groups(canon).select(*G.event_groups(states).columns))
    assert rows_of(G.kpi_groups(states)) == rows_of(C.kpi_groups(canon).select(*G.kpi_groups(states).columns))


def test_merging_a_new_file_equals_a_rebuild(spark, canon, scratch):
    old = canon.filter("event_date < '2024-01-08' or event_date is null or crc32(event_group) % 3 = 0")
    path = f"{scratch}/states"
    G.group_states(old, "event_date").write.partitionBy("event_date").parquet(path)
    untouched = {f for f in spark.read.parquet(path).inputFiles() if "event_date=2024-01-02" in f}
    new = canon.filter("not coalesce(event_date < '2024-01-08' or event_date is null or crc32(event_group) % 3 = 0, false)")
    assert new.count() > 100 and old.count() + new.count() == canon.count()
    G.ingest(path, new.filter("event_date >= '2024-01-08'"))
    G.ingest(path, new.filter("not coalesce(event_date >= '2024-01-08', false)"))
    whole = G.group_states(canon, "event_date")
    assert rows_of(spark.read.parquet(path).select(*whole.columns)) == rows_of(whole)
    now = set(spark.read.parquet(path).inputFiles())
    assert untouched and untouched <= now  # a date without new events is left alone


def test_running_totals(canon):
    combos = G.combinations(C.event_groups(canon))
    daily = rows_of(R.combo_daily(C.event_groups(canon)))
    assert rows_of(combos.drop("total")) == daily
    for r in combos.collect():
        same = [d for d in daily if d[1:4] == (r["camera_name"], r["category"], r["hour"])]
        assert r["total"] == sum(d[4] for d in same if d[0] is None or (r["date"] is not None and d[0] <= r["date"]))


@pytest.mark.parametrize("sparse", [0, 3, 512])
def test_cells_count_like_events(canon, monkeypatch, sparse):
    """All reports and filters, with every bucket as a bitmap, mixed, and as places."""
    monkeypatch.setattr(G, "SPARSE", sparse)
    groups = canon.filter("event_group is not null").select("event_group").distinct()
    numbers = groups.withColumn("number", (F.crc32("event_group") % 3) * 33000 + F.row_number().over(
        Window.orderBy("event_group")))  # three buckets
    cells = G.cells(canon, numbers).persist()
    assert cells.agg(F.sum("rows")).first()[0] == 1500
    if sparse == 0:
        assert cells.filter("places is not null").count() == 0
    every = (Filters(), Filters(camera_name=("cam-1", "cam-3"), start_date="2024-01-03"), Filters(mac=("m0",), end_date="2024-01-06"),
             Filters(subject_category=("wildlife", "unknown")), Filters(subject_class=("elk",), time_of_day_bucket=("morning", "night")),
             Filters(camera_name=("nowhere",)))
    for k, flt in enumerate(every if sparse == 3 else every[1:2]):
        for name, report in list(G.REPORTS.items())[k % 2 if sparse == 3 else 0::2 if sparse == 3 else 1]:
            want = getattr(R, name)(canon.filter(flt.predicate()))
            got = report(cells.filter(flt.predicate()))
            assert rows_of(got.select(*want.columns)) == rows_of(want), (name, flt)
    cells.unpersist()


def test_filters_that_need_events():
    assert Filters(camera_name=("a",), end_date="2024-01-01").on_cells()
    assert not Filters(q="wolf").on_cells() and not Filters(min_lux=0).on_cells() and not Filters(max_heat_level=0).on_cells()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001


@pytest.mark.parametrize("report", sorted(registry.SLICES))
def test_filtered_reports_read_cells_only(spark, report):
    staging.stage_all(spark, SMALL)
    text = plan(registry.QUERIES[f"filtered_{report}"](spark, SMALL))
    assert "/cells/" in text and "/canonical/" not in text and "/raw/" not in text


def test_slices_beyond_cells_read_events(spark):
    text = plan(registry.on_slice(spark, SMALL, "composition", Filters(min_lux=5)))
    assert "/canonical/" in text and "/cells/" not in text


def test_lab_reads_few_tables_and_only_window_dates(spark):
    combos = staging.combos_table(spark, SMALL)
    timeline = plan(registry.QUERIES["novelty_timeline"](spark, SMALL))
    assert timeline.count("FileScan") < 10 and "/canonical/" not in timeline
    shift = plan(L.category_shift_all(combos))
    scans = [line for line in shift.splitlines() if "FileScan" in line and "count" in line]
    assert scans and all("PartitionFilters: [isnotnull(date" in line and "subquery" in line.lower() for line in scans)
