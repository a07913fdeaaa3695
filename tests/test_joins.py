"""Outer and band joins against a loop over all pairs."""

import datetime as dt
import math
import random

import pytest

from conftest import SMALL

from burstlens.operators import joins as J
from burstlens.plans import builder as B
from burstlens.plans.registry import JOINS


def le(a, b):  # Spark's order: NaN is the largest number
    if isinstance(a, float) and math.isnan(a):
        return isinstance(b, float) and math.isnan(b)
    return isinstance(b, float) and math.isnan(b) or a <= b


def brute(left, right, how, keys, moved=lambda x, by: x):
    """Rows are (key, value, tag) and (key, low, high, tag)."""
    out, lone = [], set(range(len(right)))
    for a in left:
        hit = False
        for j, b in enumerate(right):
            lo, hi = (None if x is None else moved(x, s) for x, s in ((b[1], -1), (b[2], 1)))
            if (not keys or (a[0] is not None and a[0] == b[0])) and None not in (a[1], lo, hi) and le(lo, a[1]) and le(a[1], hi):
                out.append((*a, *b))
                hit = True
                lone.discard(j)
        if not hit and how in ("left", "full"):
            out.append((*a, None, None, None, None))
    if how in ("right", "full"):
        out += [(None, None, None, *right[j]) for j in lone]
    return sorted(map(repr, out))


def run(spark, left, right, kind, how, keys, band):
    a = spark.createDataFrame(left, f"k string, v {kind}, tag int")
    b = spark.createDataFrame(right, f"k string, v {kind}, high {kind}, tag int")  # names of both sides clash
    out = J.join(a, b, (("k", "k"),) if keys else (), band, how)
    assert out.columns == ["l_k", "l_v", "l_tag", "r_k", "r_v", "r_high", "r_tag"]
    return sorted(repr(tuple(r)) for r in out.collect())


@pytest.mark.parametrize("how", J.HOW)
@pytest.mark.parametrize("keys", [True, False])
def test_numbers_equal_the_loop(spark, how, keys):
    rnd = random.Random(7)
    odd = [float("nan"), float("inf"), float("-inf"), -0.0, 1e300, -1e300, -3.5, None]
    value = lambda: rnd.choice(odd) if rnd.random() < 0.25 else round(rnd.uniform(-40, 40), 1)
    key = lambda: rnd.choice(["a", "a", "a", "b", None])
    left = [(key(), value(), rnd.randrange(3)) for _ in range(60)]
    right = []
    for _ in range(40):
        lo = value()
        long = rnd.choice([0.0, 0.3, 5.0, 1e9])
        right.append((key(), lo, None if lo is None or rnd.random() < 0.1 else lo + long, rnd.randrange(3)))
    right.append(("a", 5.0, 4.0, 0))  # the wrong way round
    left += left[:3]  # repeated rows stay repeated
    right += right[:3]
    want = brute(left, right, how, keys)
    for step in (0.1, 7):
        assert run(spark, left, right, "double", how, keys, J.Band("v", "v", "high", step=step)) == want


@pytest.mark.parametrize("kind,unit", [("timestamp_ntz", dt.timedelta(seconds=1)), ("date", dt.timedelta(days=1))])
def test_times_and_slack_equal_the_loop(spark, kind, unit):
    rnd = random.Random(3)
    if kind == "date":
        at = lambda: dt.date(1969, 12, 20) + dt.timedelta(days=rnd.randrange(30))
    else:  # around a change of clocks and before 1970
        at = lambda: rnd.choice([dt.datetime(2024, 3, 31, 1, 59), dt.datetime(1969, 12, 31, 23, 59)]) + dt.timedelta(seconds=rnd.randrange(200), microseconds=rnd.randrange(10**6))
    left = [("a", at(), i) for i in range(40)]
    right = [("a", x, x + unit * rnd.randrange(40), i) for i, x in enumerate(at() for _ in range(25))]
    want = brute(left, right, "full", True, lambda x, s: x + s * 2 * unit)
    assert run(spark, left, right, kind, "full", True, J.Band("v", "v", "high", slack=2, step=5 if kind != "date" else 1)) == want


@pytest.mark.parametrize("how", J.HOW)
@pytest.mark.parametrize("keys", [True, False])
def test_counts_equal_the_counted_rows(spark, how, keys):
    from pyspark.sql import functions as F
    rnd = random.Random(11)
    odd = [float("nan"), float("inf"), float("-inf"), -0.0, 0.0, 1e300, -3.5, None]
    value = lambda: rnd.choice(odd) if rnd.random() < 0.2 else round(rnd.uniform(-60, 60), 1)
    word = lambda: rnd.choice(["a", "a", "b", None])
    left = [(word(), value(), word(), rnd.choice([1, None])) for _ in range(150)]
    right = []
    for _ in range(60):
        lo = value()
        right.append((word(), lo, None if lo is None or rnd.random() < 0.1 else lo + rnd.choice([0.0, 0.3, 5.0, 37.0, -1.0, 1e9]), word(), rnd.choice([1, None])))
    left, right = left + left[:9], right + right[:9]
    a = spark.createDataFrame(left, "k string, v double, g string, tag int")
    b = spark.createDataFrame(right, "k string, v double, high double, g string, tag int")
    on = (("k", "k"),) if keys else ()
    for step, by in ((0.5, ("l_g", "r_g")), (7, ("r_g",) if keys else ("l_g",))):
        band = J.Band("v", "v", "high", slack=0.2, step=step)
        want = J.join(a, b, on, band, how).groupBy(*by).agg(F.count(F.lit(1)).alias("joined"), F.count("l_tag").alias("l_tag"), F.count("r_tag").alias("r_tag"))
        got = J.counts(a, b, on, band, how, by, ("l_tag", "r_tag"))
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_counts_shuffle_no_pairs(spark):
    """2000 values in 2000 intervals: four million pairs, counted without one."""
    from pyspark.sql import functions as F
    a = spark.range(2000).select((F.col("id") / 2000).alias("v"))
    b = spark.range(2000).select((-F.col("id") / 2000).alias("v"), (1 + F.col("id") / 2000).alias("high"))
    got = J.counts(a, b, (), J.Band("v", "v", "high", step=0.01))
    text = got._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001
    assert "_v" not in "".join(x for x in text.splitlines() if "Join" in x)  # values meet intervals in no join
    assert [tuple(r) for r in got.collect()] == [(4_000_000,)]


@pytest.mark.parametrize("how", J.HOW)
def test_empty_sides(spark, how):
    some, span = [("a", 1.0, 1)], [("a", 0.0, 2.0, 1)]
    band = J.Band("v", "v", "high")
    for left, right in (([], span), (some, []), ([], [])):
        assert run(spark, left, right, "double", how, True, band) == brute(left, right, how, True)


def test_plans_hold_no_nested_loop(spark):
    rels = B.relations(spark, SMALL)
    for key, spec in JOINS.items():
        text = B.join(rels, spec)._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001
        assert "NestedLoop" not in text and "CartesianProduct" not in text, key


def test_a_long_interval_is_two_rows(spark):
    points = spark.createDataFrame([(0.5,)], "_v double")
    spans = spark.createDataFrame([(-1e12, 1e12), (3.0, 4.5), (5.0, 5.0)], "_lo double, _hi double")
    plan = J._meetings(points, spans, [], points.schema["_v"].dataType, 1)
    assert [tuple(r) for r in plan.collect()] == [(0.5, -1e12, 1e12)]
    from pyspark.sql import functions as F
    a, b = (J.cell(F.col(c), points.schema["_v"].dataType, 1) for c in ("_lo", "_hi"))
    across = F.col("b") - F.col("a")
    level = F.when(across <= 1, F.lit(0)).otherwise(F.length(F.bin(across - 1))).cast("int")
    made = spans.select(a.alias("a"), b.alias("b")).select(
        F.size(F.sequence(J._shifted(F.col("a"), level), J._shifted(F.col("b"), level))).alias("n"))
    assert max(r["n"] for r in made.collect()) == 2


@pytest.mark.parametrize("spec", [
    B.JoinSpec("nope", "events", (("left", "id", "id"),), on=(("id", "id"),)),
    B.JoinSpec("events", "dim_devices", (("left", "id", "id"),)),
    B.JoinSpec("events", "dim_devices", (), on=(("mac", "mac"),)),
    B.JoinSpec("events", "dim_devices", (("left", "no_such", "x"),), on=(("mac", "mac"),)),
    B.JoinSpec("events", "dim_devices", (("left", "id", "id"),), on=(("mac", "latitude"),)),
    B.JoinSpec("events", "dim_devices", (("left", "id", "id"),), on=(("mac", "mac"),), how="cross"),
    B.JoinSpec("events", "dim_devices", (("left", "id", "id"),), band=J.Band("mac", "mac", "mac")),
    B.JoinSpec("events", "dim_devices", (("left", "id", "id"),), band=J.Band("latitude", "latitude", "latitude", step=0)),
])
def test_bad_joins_raise(spark, spec):
    with pytest.raises(ValueError):
        B.join(B.relations(spark, SMALL), spec)
