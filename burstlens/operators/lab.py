"""Analytics lab: analysis windows, forecasts, category shift, novelty, insights.

All inputs are aggregates of event groups ((date, camera[, category, hour])
counts).  Window-style logic is expressed with joins and aggregates:

* the analysis windows (W4) label the distinct observed dates; their first and
  last dates are read as one scalar, which prunes the folders that are read;
* counts over all history come from the running totals of the staged
  combinations, not from old dates;
* the per-camera trailing forecast (W3) needs zero-filled camera x date
  series.  Instead of materialising that cross product, every observed
  (camera, date) count is sent to the next seven date slots (a fixed 8x
  fan-out) and summed per slot, which yields exactly the non-zero cells;
* novelty maxima come from one-row aggregates used as scalar subqueries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.normalize import js_round


def fill(template: str, *values: Column) -> Column:
    """Text template with ``{}`` slots filled by columns, in order."""
    pieces = template.split("{}")
    parts: list[Column] = [F.lit(pieces[0])]
    for v, tail in zip(values, pieces[1:]):
        parts += [v.cast("string"), F.lit(tail)]
    return F.concat(*parts)


def js_number_text(x: Column) -> Column:
    """Number as text the way the UI prints it: integral values without '.0'."""
    return F.when(x == F.floor(x), F.floor(x).cast("bigint").cast("string")).otherwise(x.cast("string"))


def hh(hour: Column) -> Column:
    return F.lpad(hour.cast("string"), 2, "0")


# ---------------------------------------------------------------- W4
def analysis_windows(rows: DataFrame) -> DataFrame:
    """Every observed date with its index, recent/baseline labels and n.

    One row per distinct date, so the unpartitioned window below runs over a
    table bounded by the calendar span, never over event rows.
    """
    dates = rows.select("date").filter(F.col("date").isNotNull()).distinct()
    ranked = dates.select(
        "date",
        F.row_number().over(Window.orderBy(F.col("date").desc())).alias("rdesc"),
        F.count(F.lit(1)).over(Window.partitionBy()).alias("n"),
    )
    rc = F.least(F.lit(K.RECENT_MAX_DAYS), F.greatest(F.lit(K.RECENT_MIN_DAYS), F.ceil(F.col("n") / 3)))
    return ranked.select(
        "date", "rdesc", "n",
        (F.col("n") - F.col("rdesc")).alias("idx"),
        rc.alias("recent_days"),
        (F.col("rdesc") <= rc).alias("is_recent"),
        F.when(F.col("n") > rc, (F.col("rdesc") > rc) & (F.col("rdesc") <= rc + K.BASELINE_MAX_DAYS))
        .otherwise(F.col("rdesc") >= 2).alias("is_baseline"),
    )


def window_bounds(windows: DataFrame) -> Column:
    """The two windows as one scalar: observed dates are consecutive inside a
    window, so its first and last date say which rows fall into it."""
    def ends(label: str) -> list[Column]:
        own = F.when(F.col(label), F.col("date"))
        return [F.min(own).alias(f"{label}_from"), F.max(own).alias(f"{label}_to"), F.count(own).alias(f"{label}_days")]

    first = F.least(F.min(F.when(F.col("is_recent"), F.col("date"))), F.min(F.when(F.col("is_baseline"), F.col("date")))).alias("first")
    return windows.agg(F.struct(first, *ends("is_recent"), *ends("is_baseline"))).scalar()


def _within(bounds: Column, label: str) -> Column:
    return F.coalesce(F.col("date").between(bounds.getField(f"{label}_from"), bounds.getField(f"{label}_to")), F.lit(False))


def _counted(bounds: Column, label: str) -> Column:
    return F.when(_within(bounds, label), F.col("count")).otherwise(0)


def with_totals(combo: DataFrame) -> DataFrame:
    """Combinations with their running totals (the staged table has them)."""
    if "total" in combo.columns:
        return combo
    running = Window.partitionBy("camera_name", "category", "hour").orderBy("date")  # a row a date
    return combo.withColumn("total", F.sum("count").over(running))


# ---------------------------------------------------------------- W2
def forecast(daily: DataFrame) -> DataFrame:
    """Fleet daily total vs the mean of the previous (up to) 7 observed dates."""
    actual = sum(F.col(c) for c in K.MAIN_CATEGORIES + ["unknown"])
    d = daily.select("date", actual.alias("actual"))
    w = Window.orderBy("date").rowsBetween(-K.TRAILING_DAYS, -1)
    e = d.select("date", "actual", F.coalesce(F.avg("actual").over(w), F.col("actual").cast("double")).alias("_e"))
    return e.select("date", "actual", js_round(F.col("_e"), 2).alias("expected"),
                    js_round(F.col("actual") - F.col("_e"), 2).alias("delta")).orderBy("date")


# ---------------------------------------------------------------- W3 / J7
def camera_forecast(cam_daily: DataFrame) -> DataFrame:
    """Per camera, recent dates, expectation over the 7 previous observed dates
    (missing dates count as 0); rows with actual = expected = 0 are dropped."""
    win = analysis_windows(cam_daily)
    # Dates that can feed a recent slot: the recent ones and the 7 before them.
    feed = F.broadcast(win.filter(F.col("rdesc") <= F.col("recent_days") + K.TRAILING_DAYS).select("date", "idx"))
    recent = F.broadcast(win.filter(F.col("is_recent")).select(F.col("idx").alias("i"), "date"))
    src = cam_daily.join(feed, "date").select("camera_name", "idx", "count")
    spread = src.select("camera_name", "count",
                        F.explode(F.sequence(F.lit(0), F.lit(K.TRAILING_DAYS))).alias("o"), "idx")
    slots = spread.select("camera_name", "count", "o", (F.col("idx") + F.col("o")).alias("i"))
    cells = slots.groupBy("camera_name", "i").agg(
        F.sum(F.when(F.col("o") == 0, F.col("count")).otherwise(0)).alias("actual"),
        F.sum(F.when(F.col("o") > 0, F.col("count")).otherwise(0)).alias("trail"),
    ).join(recent, "i")
    length = F.least(F.col("i"), F.lit(K.TRAILING_DAYS))
    raw = F.when(length > 0, F.col("trail") / length).otherwise(F.col("actual").cast("double"))
    out = cells.select("date", "camera_name", "actual", js_round(raw, 2).alias("expected"), "i")
    out = out.select("*", js_round(F.col("actual") - F.col("expected"), 2).alias("delta"))
    residual = (F.when(F.col("expected") > 0, js_round(F.col("delta") / F.col("expected") * 100, 1))
                .when(F.col("actual") > 0, F.lit(100.0)).otherwise(F.lit(0.0)))
    return (out.select("date", "camera_name", "actual", "expected", "delta", residual.alias("residual_pct"), "i")
            .filter(~((F.col("actual") == 0) & (F.col("expected") == 0))))


def camera_forecast_leaders(cam_fc: DataFrame) -> DataFrame:
    """K4: latest date, |delta| desc, actual desc, camera; top 10."""
    latest = cam_fc.agg(F.max("i")).scalar()
    return (cam_fc.filter(F.col("i") == latest)
            .orderBy(F.abs(F.col("delta")).desc(), F.col("actual").desc(), F.col("camera_name").asc())
            .limit(K.LEADERS_TOP).drop("i"))


# ---------------------------------------------------------------- L1
def _shift_columns(recent: Column, baseline: Column, recent_all: Column, baseline_all: Column) -> tuple[Column, Column, Column]:
    """(recent share, baseline share, shift) in per cent."""
    rs = F.when(recent_all > 0, js_round(recent / recent_all * 100, 1)).otherwise(0.0)
    bs = F.when(baseline_all > 0, js_round(baseline / baseline_all * 100, 1)).otherwise(0.0)
    return rs, bs, js_round(rs - bs, 1)


def category_shift_all(combo: DataFrame, win: DataFrame | None = None) -> DataFrame:
    """L1 before the cut: per (camera, category) recent vs baseline share.
    Only the dates of the two windows are read."""
    bounds = window_bounds(analysis_windows(combo) if win is None else win)
    pairs = combo.filter(F.col("date") >= bounds.getField("first")).groupBy("camera_name", "category").agg(
        F.sum(_counted(bounds, "is_recent")).alias("recent_count"), F.sum(_counted(bounds, "is_baseline")).alias("baseline_count"))
    cam = Window.partitionBy("camera_name")
    pairs = pairs.select("*", F.sum("recent_count").over(cam).alias("_rt"), F.sum("baseline_count").over(cam).alias("_bt"))
    rs, bs, shift = _shift_columns(F.col("recent_count"), F.col("baseline_count"), F.col("_rt"), F.col("_bt"))
    shares = pairs.select("camera_name", "category", "recent_count", "baseline_count",
                          rs.alias("recent_share_pct"), bs.alias("baseline_share_pct"), shift.alias("shift_pct"))
    lift = (F.when(F.col("baseline_share_pct") > 0,
                   js_round(F.col("recent_share_pct") / F.col("baseline_share_pct"), 2))
            .when(F.col("recent_share_pct") > 0, F.lit(float(K.LIFT_NEW))).otherwise(F.lit(float(K.LIFT_NONE))))
    return shares.select(
        "camera_name", "category", "recent_share_pct", "baseline_share_pct", "shift_pct", lift.alias("lift"),
        "recent_count", "baseline_count",
    ).filter((F.col("recent_count") > 0) | (F.col("baseline_count") > 0))


def shift_order() -> list[Column]:
    return [F.abs(F.col("shift_pct")).desc(), F.col("recent_count").desc(),
            F.col("camera_name").asc(), F.col("category").asc()]


def category_shift_matrix(combo: DataFrame, win: DataFrame | None = None) -> DataFrame:
    """L1: the 36 largest absolute shifts."""
    return category_shift_all(combo, win).orderBy(*shift_order()).limit(K.SHIFT_TOP)


# ---------------------------------------------------------------- L2-L4
def _history(lab: DataFrame) -> tuple[DataFrame, Column]:
    """Groups of every (category, hour) over all dates, and the two maxima of
    the score (floored at 1) as one scalar.  Running totals never fall, so the
    largest one is the largest combination."""
    tops = lab.groupBy("category", "hour").agg(F.sum("count").alias("category_hour_count"), F.max("total").alias("_most"))
    maxima = tops.agg(F.struct(F.greatest(F.max("_most"), F.lit(1)).alias("combo"),
                               F.greatest(F.max("category_hour_count"), F.lit(1)).alias("category_hour"))).scalar()
    return tops.drop("_most"), maxima


def _labelled(combo: DataFrame) -> DataFrame:
    return with_totals(combo).filter(F.col("category") != F.lit(K.NOVELTY_EXCLUDED))


def _score(count_rate: Column, baseline_avg: Column, combo_count: Column, cat_hour_count: Column,
           shift: Column, max_combo: Column, max_cat_hour: Column) -> Column:
    w = K.NOVELTY_WEIGHTS
    combo_rarity = 1 - combo_count / max_combo
    cat_hour_rarity = 1 - cat_hour_count / max_cat_hour
    deviation = F.greatest(F.lit(0.0), count_rate - baseline_avg)
    deviation_score = F.least(F.lit(1.0), deviation / F.greatest(baseline_avg, F.lit(1.0)))
    shift_score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), shift) / K.SHIFT_SCORE_DIV)
    return js_round(100 * (w["combo"] * combo_rarity + w["category_hour"] * cat_hour_rarity
                           + w["deviation"] * deviation_score + w["shift"] * shift_score), 1)


def novel_patterns(combo: DataFrame, win: DataFrame | None = None, shifts: DataFrame | None = None) -> DataFrame:
    """L2 before the cut: every (camera, category, hour) pattern of the recent window, scored.

    ``win`` (W4) and ``shifts`` (L1, uncut) may be passed in when already computed.
    A pattern's count over all history is its last running total, so patterns
    come from the dates of the windows alone."""
    win = analysis_windows(combo) if win is None else win
    bounds = window_bounds(win)
    lab = _labelled(combo)
    cat_hour, maxima = _history(lab)
    shifts = (category_shift_all(combo, win) if shifts is None else shifts).select("camera_name", "category", F.col("shift_pct").alias("_shift"))
    combos = lab.filter(F.col("date") >= bounds.getField("first")).groupBy("camera_name", "category", "hour").agg(
        F.sum(_counted(bounds, "is_recent")).alias("current_count"), F.sum(_counted(bounds, "is_baseline")).alias("baseline_count"),
        F.max("total").alias("combo_count"))
    base_days = F.greatest(bounds.getField("is_baseline_days"), F.lit(1))
    recent_days = F.greatest(bounds.getField("is_recent_days"), F.lit(1))
    max_combo, max_cat_hour = maxima.getField("combo"), maxima.getField("category_hour")
    rows = (combos.filter(F.col("current_count") > 0)
            .join(cat_hour, ["category", "hour"], "left")
            .join(shifts, ["camera_name", "category"], "left"))
    bda_k = F.floor(F.col("baseline_count") / base_days * 100 + 0.5)
    scored = rows.select(
        "camera_name", "category", "hour", "current_count", "combo_count", "category_hour_count",
        (bda_k / 100.0).alias("baseline_daily_avg"), bda_k.alias("_bda_k"),
        js_round(F.coalesce(F.col("_shift"), F.lit(0.0)), 1).alias("shift_pct"),
    )
    score = _score(F.col("current_count") / recent_days, F.col("baseline_daily_avg"), F.col("combo_count"),
                   F.col("category_hour_count"), F.col("shift_pct"), max_combo, max_cat_hour)
    tenths = F.floor((F.col("_bda_k") + 5) / 10).cast("bigint")
    bda_text = F.concat((tenths / 10).cast("bigint").cast("string"), F.lit("."), (tenths % 10).cast("string"))
    narrative = fill(K.NOVEL_NARRATIVE, F.col("camera_name"), F.col("category"), hh(F.col("hour")),
                     F.col("current_count"), bda_text)
    return scored.select("camera_name", "category", "hour", "current_count", "baseline_daily_avg",
                         "combo_count", "category_hour_count", "shift_pct", score.alias("novelty_score"),
                         narrative.alias("narrative"))


def novel_events(patterns: DataFrame, top: int = K.NOVEL_TOP) -> DataFrame:
    """L2: the displayed list, the ``top`` most novel of ``novel_patterns``."""
    return patterns.orderBy(F.col("novelty_score").desc(), F.col("current_count").desc(), F.col("camera_name").asc(),
                            F.col("category").asc(), F.col("hour").asc()).limit(top)


def _driver(cam: Column, cat: Column, hour: Column) -> Column:
    return F.concat(cam, F.lit(" "), cat, F.lit(" @ "), hh(hour), F.lit(":00"))


def novelty_by_date(combo: DataFrame, novel: DataFrame, win: DataFrame | None = None) -> DataFrame:
    """L3: per recent date, count of rows in all patterns of ``novel`` scoring >= 70 and the top driver."""
    bounds = window_bounds(analysis_windows(combo) if win is None else win)
    hot = (novel.filter(F.col("novelty_score") >= K.NOVELTY_THRESHOLD)
           .select("camera_name", "category", "hour", "novelty_score"))
    rows = (combo.filter((F.col("category") != F.lit(K.NOVELTY_EXCLUDED)) & _within(bounds, "is_recent"))
            .join(hot, ["camera_name", "category", "hour"]))
    order = F.struct(-F.col("novelty_score"), F.col("camera_name"), F.col("category"), F.col("hour"))
    return rows.groupBy("date").agg(
        F.sum("count").alias("novel_event_count"),
        F.min_by(_driver(F.col("camera_name"), F.col("category"), F.col("hour")), order).alias("top_driver"),
    )


def novelty_timeline(combo: DataFrame, win: DataFrame | None = None) -> DataFrame:
    """L4: every observed date with the volume, mean/max score, top driver and
    dominant category of its patterns scoring >= 70 (row count as the rate).

    Every date is scored, so all combinations are read, once: what a pattern
    needs of its combination, category and camera comes from windows over a
    camera's rows (dates x categories x hours), one shuffle by camera."""
    win = analysis_windows(combo) if win is None else win
    cat_hour, maxima = _history(_labelled(combo))
    rows = with_totals(combo).select("*", window_bounds(win).alias("_b"))
    camera, pair = Window.partitionBy("camera_name"), Window.partitionBy("camera_name", "category")
    own = Window.partitionBy("camera_name", "category", "hour")
    rows = rows.select("*", _counted(F.col("_b"), "is_recent").alias("_r"), _counted(F.col("_b"), "is_baseline").alias("_l"))
    rows = rows.select(
        "date", "camera_name", "category", "hour", "count", F.col("_b.is_baseline_days").alias("_days"),
        F.sum("_r").over(camera).alias("_rt"), F.sum("_l").over(camera).alias("_bt"),
        F.sum("_r").over(pair).alias("_rp"), F.sum("_l").over(pair).alias("_bp"),
        F.max("total").over(own).alias("combo_count"), F.sum("_l").over(own).alias("baseline_count"))
    per = rows.filter(F.col("category") != F.lit(K.NOVELTY_EXCLUDED)).join(cat_hour, ["category", "hour"])
    bda = F.floor(F.col("baseline_count") / F.greatest(F.col("_days"), F.lit(1)) * 100 + 0.5) / 100.0
    shift = _shift_columns(F.col("_rp"), F.col("_bp"), F.col("_rt"), F.col("_bt"))[2]
    score = _score(F.col("count").cast("double"), bda, F.col("combo_count"), F.col("category_hour_count"), shift,
                   maxima.getField("combo"), maxima.getField("category_hour"))
    q = per.select("date", "camera_name", "category", "hour", "count", score.alias("s")) \
        .filter(F.col("s") >= K.NOVELTY_THRESHOLD)
    order = F.struct(-F.col("s"), F.col("camera_name"), F.col("category"), F.col("hour"))
    by_category = q.groupBy("date", "category").agg(
        F.sum("count").alias("_c"), F.sum(F.round(F.col("s") * 10).cast("bigint")).alias("_tenths"), F.count(F.lit(1)).alias("_n"),
        F.max("s").alias("_max"), F.min(F.struct(order.alias("order"), _driver(
            F.col("camera_name"), F.col("category"), F.col("hour")).alias("driver"))).alias("_top"))
    daily = by_category.groupBy("date").agg(
        F.sum("_c").alias("novelty_count"),
        # mean of 1-decimal scores, summed exactly in tenths, rounded half up
        (F.floor((F.sum("_tenths") * 2 + F.sum("_n")) / (F.sum("_n") * 2)) / F.lit(10.0)).alias("avg_novelty_score"),
        js_round(F.max("_max"), 1).alias("max_novelty_score"), F.min("_top").getField("driver").alias("top_driver"),
        F.min_by("category", F.struct(-F.col("_c"), F.col("category"))).alias("dominant_category"))
    all_dates = win.select("date")
    out = all_dates.join(daily, "date", "left")
    return out.select(
        "date",
        F.coalesce(F.col("novelty_count"), F.lit(0)).alias("novelty_count"),
        F.coalesce(F.col("avg_novelty_score"), F.lit(0.0)).alias("avg_novelty_score"),
        F.coalesce(F.col("max_novelty_score"), F.lit(0.0)).alias("max_novelty_score"),
        "top_driver", "dominant_category",
    ).orderBy("date")


# ---------------------------------------------------------------- A31 + J6
def anomaly_timeline(canon: DataFrame, novelty_dates: DataFrame) -> DataFrame:
    """Per row-date anomaly count and mean row score, joined to L3 by date."""
    s = K.TIMELINE_SCORE
    c = F.col
    failed = F.coalesce(c("uploaded"), F.lit(True)) == F.lit(False)
    low_v = c("voltage").isNotNull() & (c("voltage") < K.LOW_VOLTAGE)
    lag = F.coalesce(c("processing_lag_seconds"), F.lit(0))
    row_score = F.least(F.lit(100.0), F.greatest(F.lit(0.0),
                        F.when(failed, s["upload_failed"]).otherwise(0)
                        + F.when(low_v, s["low_voltage"]).otherwise(0)
                        + F.least(F.lit(float(s["lag_cap"])), lag / s["lag_div"])
                        + F.when(c("suspicious_numeric_flag"), s["suspicious"]).otherwise(0)))
    per_day = canon.groupBy(c("event_date").alias("date")).agg(
        F.count_if(failed | low_v | (lag > K.PROCESSING_LAG_LIMIT) | c("suspicious_numeric_flag")).alias("anomaly_count"),
        F.avg(row_score).alias("_avg"),
    )
    out = per_day.join(novelty_dates, "date", "left")
    return out.select(
        "date", "anomaly_count",
        js_round(F.coalesce(c("_avg"), F.lit(0.0)), 1).alias("avg_anomaly_score"),
        "top_driver",
        F.coalesce(c("novel_event_count"), F.lit(0)).alias("novel_event_count"),
    ).orderBy("date")


# ---------------------------------------------------------------- R7
def camera_clusters(diversity: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Rule-based camera profile from diversity and anomaly tables."""
    a = anomalies.select("camera_name", F.col("anomaly_score").alias("_a"), F.col("health_score").alias("_h"))
    j = diversity.join(a, "camera_name", "left")
    anomaly = F.coalesce(F.col("_a"), F.lit(0))
    rules = K.CLUSTER_RULES
    conds = [anomaly >= K.CLUSTER_ANOMALY,
             (F.col("wildlife_ratio_pct") >= K.CLUSTER_WILDLIFE_PCT) & (F.col("low_light_share_pct") >= K.CLUSTER_LOW_LIGHT_PCT),
             F.col("human_ratio_pct") >= K.CLUSTER_HUMAN_PCT,
             F.col("diversity_score") >= K.CLUSTER_DIVERSITY]

    def pick(i: int) -> Column:
        expr = F.when(conds[0], F.lit(rules[0][i]))
        for cond, rule in zip(conds[1:], rules[1:4]):
            expr = expr.when(cond, F.lit(rule[i]))
        return expr.otherwise(F.lit(rules[4][i]))

    return j.select("camera_name", pick(0).alias("cluster"), pick(1).alias("similarity_label"),
                    pick(2).alias("rationale"), F.coalesce(F.col("_h"), F.lit(100)).alias("health_score"),
                    anomaly.alias("anomaly_score"), "diversity_score", "total_events") \
        .orderBy(F.col("total_events").desc(), "camera_name").drop("total_events")


# ---------------------------------------------------------------- R8 / R9
def _insight(df: DataFrame, rank: int, title: Column, detail: Column, tone: str) -> DataFrame:
    return df.select(F.lit(rank).alias("rank"), title.alias("title"), detail.alias("detail"),
                     F.lit(tone).alias("tone"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.orderBy("rank").limit(K.INSIGHT_MAX)


def overview_insights(health: DataFrame, kpis: DataFrame, top_cams: DataFrame, stale: DataFrame) -> DataFrame:
    """Up to four headline insights in fixed priority."""
    first_alert = (health.filter(F.col("status") == "alert")
                   .orderBy(F.col("total_events").desc(), "camera_name").limit(1))
    busiest = top_cams.orderBy(F.col("count").desc(), "camera_name").limit(1)
    stale_n = stale.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 0)
    lag = F.col("avg_processing_lag_seconds")
    ll = F.col("low_light_share_pct")
    return _union([
        _insight(first_alert, 1, fill(K.INSIGHT_CAMERA_ALERT[0], F.col("camera_name")),
                 F.coalesce(F.col("alert_reason"), F.lit(K.INSIGHT_CAMERA_ALERT[1])), "alert"),
        _insight(kpis.filter(F.coalesce(lag, F.lit(0.0)) > K.INSIGHT_LAG_SECONDS), 2, F.lit(K.INSIGHT_LAG[0]),
                 fill(K.INSIGHT_LAG[1], F.floor(lag / 60 + 0.5).cast("bigint")), "warning"),
        _insight(busiest, 3, fill(K.INSIGHT_BUSIEST[0], F.col("camera_name")),
                 fill(K.INSIGHT_BUSIEST[1], F.format_number(F.col("count"), 0)), "info"),
        _insight(kpis.filter(ll > K.INSIGHT_LOW_LIGHT_PCT), 4, F.lit(K.INSIGHT_LOW_LIGHT[0]),
                 fill(K.INSIGHT_LOW_LIGHT[1], js_number_text(js_round(ll, 1))), "positive"),
        _insight(stale_n, 5, fill(K.INSIGHT_STALE[0], F.col("n")), F.lit(K.INSIGHT_STALE[1]), "warning"),
    ])


def advanced_insights(leaders: DataFrame, novel: DataFrame, shifts: DataFrame) -> DataFrame:
    """Hottest and quietest forecast leader, top novel pattern, top positive shift."""
    lead = leaders.select("*", F.row_number().over(
        Window.orderBy(F.abs(F.col("delta")).desc(), F.col("actual").desc(), F.col("camera_name").asc())).alias("_r"))
    hot = lead.filter(F.col("delta") > 0).orderBy(F.col("delta").desc(), "_r").limit(1)
    quiet = lead.filter(F.col("delta") < 0).orderBy(F.col("delta").asc(), "_r").limit(1)
    top_novel = novel.orderBy(F.col("novelty_score").desc(), F.col("current_count").desc(), "camera_name",
                              "category", "hour").limit(1)
    top_shift = shifts.filter(F.col("shift_pct") > 0).orderBy(F.col("shift_pct").desc(), *shift_order()).limit(1)
    return _union([
        _insight(hot, 1, fill(K.INSIGHT_HOT[0], F.col("camera_name")),
                 fill(K.INSIGHT_HOT[1], js_number_text(js_round(F.col("residual_pct"), 1)), F.col("date")), "warning"),
        _insight(quiet, 2, fill(K.INSIGHT_QUIET[0], F.col("camera_name")),
                 fill(K.INSIGHT_QUIET[1], js_number_text(js_round(F.abs(F.col("residual_pct")), 1)), F.col("date")),
                 "info"),
        _insight(top_novel, 3, fill(K.INSIGHT_NOVEL[0], F.col("category")),
                 fill(K.INSIGHT_NOVEL[1], F.col("camera_name"), hh(F.col("hour"))), "alert"),
        _insight(top_shift, 4, fill(K.INSIGHT_SHIFT[0], F.col("camera_name")),
                 fill(K.INSIGHT_SHIFT[1], F.col("category"), js_number_text(js_round(F.col("shift_pct"), 1))),
                 "positive"),
    ])


# ---------------------------------------------------------------- D1 / D2 / D7
def daily_trend(daily_activity: DataFrame) -> DataFrame:
    """D1 in long form: per (date, camera) groups plus the date's total."""
    return daily_activity.select(
        "date", "camera_name", "unique_event_groups",
        F.sum("unique_event_groups").over(Window.partitionBy("date")).alias("total"),
    ).orderBy("date", "camera_name")


def hour_heatmap_grid(hourly: DataFrame) -> DataFrame:
    """Camera x 24-hour grid (missing -> 0) with value / max intensity.

    The 24 columns are a fixed domain, so the grid is an ``explode`` over the
    observed cameras, not a join with another table.
    """
    cams = hourly.select("camera_name").distinct()
    grid = cams.select("camera_name", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    vals = hourly.select("camera_name", "hour", F.col("unique_event_groups").alias("value"))
    top = hourly.agg(F.greatest(F.max("unique_event_groups"), F.lit(1))).scalar()
    j = grid.join(vals, ["camera_name", "hour"], "left")
    v = F.coalesce(F.col("value"), F.lit(0))
    return j.select("camera_name", "hour", v.alias("value"), (v / top).alias("intensity"))


def forecast_residual_matrix(cam_fc: DataFrame, leaders: DataFrame) -> DataFrame:
    """The five first leaders x their forecast dates, residual or null."""
    five = leaders.orderBy(F.abs(F.col("delta")).desc(), F.col("actual").desc(), "camera_name").limit(5) \
        .select("camera_name")
    cells = cam_fc.join(F.broadcast(five), "camera_name")
    dates = cells.select("date").distinct()
    # at most 14 recent dates by construction of W4
    date_list = dates.agg(F.sort_array(F.collect_list("date"))).scalar()
    grid = five.select("camera_name", F.explode(date_list).alias("date"))
    return grid.join(cells.select("camera_name", "date", "residual_pct"), ["camera_name", "date"], "left")
