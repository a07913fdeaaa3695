"""Governed query builder."""

import pytest

from conftest import SMALL

from burstlens.plans import builder as B


@pytest.fixture(scope="module")
def rels(spark):
    return B.relations(spark, SMALL)


def test_catalog_matches_schemas(spark, rels):
    cat = B.catalog(rels)
    assert len(cat["daily_camera_summary"]["columns"]) == 17
    assert len(cat["dim_devices"]["columns"]) == 8
    assert len(cat["events"]["columns"]) == 38
    assert cat["events"]["columns"]["timestamp"]["type"] == "timestamp"
    assert cat["events"]["columns"]["uploaded"]["operators"] == ["=", "!=", "IS NULL", "IS NOT NULL"]
    assert cat["daily_camera_summary"]["columns"]["date"]["type"] == "date"
    assert B.catalog_frame(spark, cat).count() == 63


def test_builder_defaults_and_group_by_selected(spark, rels):
    spec = B.BuilderSpec(relation="dim_devices")
    assert B.build(rels, spec).columns == ["camera_name", "mac", "location_name", "camera_profile"]
    agg = B.BuilderSpec(relation="daily_camera_summary", columns=("camera_name",),
                        aggregates=(B.Aggregate("SUM", "total_rows"), B.Aggregate("COUNT", "mac"), B.Aggregate("COUNT")))
    out = B.build(rels, agg)
    assert out.columns == ["camera_name", "sum_total_rows", "count_mac", "count"]
    total = sum(r["sum_total_rows"] for r in out.collect())
    assert total == rels["events"].count()


def test_builder_matches_example_sql(spark, rels):
    spec = B.BuilderSpec(relation="daily_camera_summary", columns=("camera_name",),
                         aggregates=(B.Aggregate("SUM", "unique_event_groups", "total_event_groups"),),
                         sort=(B.Sort("total_event_groups", "desc"), B.Sort("camera_name")), limit=10)
    built = [tuple(r) for r in B.build(rels, spec).collect()]
    sql = [tuple(r) for r in B.run_example(spark, rels, "ex_top_cameras").collect()]
    assert built == sql


@pytest.mark.parametrize("spec", [
    B.BuilderSpec(relation="nope"),
    B.BuilderSpec(relation="events", columns=("no_such",)),
    B.BuilderSpec(relation="events", filters=(B.Filter("uploaded", ">", True),)),
    B.BuilderSpec(relation="events", aggregates=(B.Aggregate("AVG", "camera_name"),)),
    B.BuilderSpec(relation="events", filters=(B.Filter("lux", "IN", ""),)),
    B.BuilderSpec(relation="events", sort=(B.Sort("no_such"),)),
    B.BuilderSpec(relation="events", columns=("camera_name",), aggregates=(B.Aggregate("COUNT"),), sort=(B.Sort("id"),)),
    B.BuilderSpec(relation="events", columns=("id",), limit=5000),
    B.BuilderSpec(relation="events", columns=("id",), limit=0),
])
def test_builder_rejects_bad_specs(rels, spec):
    with pytest.raises(ValueError):
        B.build(rels, spec)


def test_no_limit_returns_every_row(rels):
    assert B.build(rels, B.BuilderSpec(relation="events", columns=("id",))).count() == rels["events"].count() > B.MAX_LIMIT
    assert B.build(rels, B.BuilderSpec(relation="events", columns=("id",), limit=7)).count() == 7


def test_named_views_for_free_sql(spark):
    names = B.register_views(spark, SMALL, prefix="ws_")
    assert names == ["ws_daily_camera_summary", "ws_dim_devices", "ws_events"]
    n = spark.sql("select count(*) from ws_events e join ws_dim_devices d on e.mac = d.mac").first()[0]
    assert n > 0


def test_text_and_boolean_operators(spark, rels):
    ev = rels["events"]
    spec = B.BuilderSpec(relation="events", columns=("id",), limit=1200, filters=(
        B.Filter("analysis_title", "ILIKE", "title CLICK%"), B.Filter("uploaded", "=", "true"),
        B.Filter("sensor", "IN", "F, B")))
    got = {r["id"] for r in B.build(rels, spec).collect()}
    exp = {r["id"] for r in ev.filter("lower(analysis_title) like 'title click%' and uploaded = true "
                                      "and sensor in ('F', 'B')").collect()}
    assert 0 < len(exp) <= 1200 and got == exp
    like = B.BuilderSpec(relation="dim_devices", columns=("mac",), filters=(B.Filter("camera_name", "LIKE", "cam-0%"),))
    assert {r["mac"] for r in B.build(rels, like).collect()} == {f"mac-0{i}" for i in range(10)}  # all device rows
