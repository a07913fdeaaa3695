"""Explorer paging: keyset pages equal offset pages; bundles compute."""

import pytest

from conftest import SMALL

from burstlens.operators import explorer as X
from burstlens.operators.filters import EventQuery
from burstlens.plans import bundles
from burstlens.plans.registry import AS_OF, QUERIES, canon
from burstlens.plans.shape import finish


@pytest.mark.parametrize("sort_by,sort_dir", [("timestamp", "desc"), ("lux", "asc"), ("heat_level", "desc"),
                                              ("subject_category", "asc")])
def test_keyset_pages_equal_offset_pages(spark, sort_by, sort_dir):
    c = canon(spark, SMALL)
    key = {"timestamp": "local_timestamp", "lux": "raw_lux", "heat_level": "heat_level",
           "subject_category": "category"}[sort_by]
    after_value, after_id = None, None
    for page in (1, 2, 3):
        q = EventQuery(page=page, page_size=40, sort_by=sort_by, sort_dir=sort_dir)
        by_offset = [r["id"] for r in X.events_page(c, q).collect()]
        by_seek = X.events_page_after(c, q, after_value, after_id)
        seek_ids = [r["id"] for r in by_seek.collect()]
        assert sorted(by_offset) == sorted(seek_ids)
        last = c.filter(c.id.isin(seek_ids)).orderBy(
            X._pg_order(key, sort_dir), "id").select(key, "id").collect()[-1]  # noqa: SLF001
        after_value, after_id = last[0], last[1]


def rows_of(df):
    """Rows by column name, whole numbers and doubles alike."""
    names = sorted(df.columns)
    return sorted(repr([float(r[c]) if isinstance(r[c], (int, float)) else r[c] for c in names]) for r in df.collect())


def test_overview_and_lab_bundles(spark):
    c = canon(spark, SMALL)
    for build in (bundles.overview, bundles.analytics_lab):
        b = build(c, AS_OF)
        got = {k: rows_of(finish(v)) for k, v in b.items() if not k.startswith("_")}
        bundles.release(b)
        assert len(got) >= 15
        # each report equals the registered key of that name (the bundle's alerts are as of the same time)
        shared = [k for k in got if k in QUERIES and k not in ("notable_events", "stale_cameras", "kpis", "insights")]
        assert len(shared) >= 8
        for k in shared:
            assert got[k] == rows_of(QUERIES[k](spark, SMALL)), k
