"""Lab algorithms (W3, W4, L1-L4) against a plain-Python statement of the rules
on hand-made combo tables: more than 36 (camera, category) pairs so the L1
cut matters, rare recent patterns so novelty scores reach 70, a date gap and
cameras missing on some dates."""

import datetime as dt
import math
import random
from collections import defaultdict

import pytest

from burstlens.operators import lab as L

D0 = dt.date(2024, 3, 1)


def jsr(x, d=1):
    p = 10 ** d
    return math.floor(x * p + 0.5) / p


def windows(dates):
    s = sorted(set(dates))
    n = len(s)
    rc = min(14, max(5, math.ceil(n / 3)))
    recent = s[-rc:]
    base = s[max(0, n - rc - 28): max(0, n - rc)]
    if not base:
        base = s[:-1]
    return s, set(recent), set(base)


def shift_matrix(rows):
    _, rec, base = windows([r[0] for r in rows])
    rc, bc, rt, bt = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(int)
    for d, cam, cat, _, n in rows:
        if d in rec:
            rc[(cam, cat)] += n
            rt[cam] += n
        if d in base:
            bc[(cam, cat)] += n
            bt[cam] += n
    out = []
    for key in set(rc) | set(bc):
        cam, cat = key
        rs = jsr(rc[key] / rt[cam] * 100) if rt[cam] > 0 else 0
        bs = jsr(bc[key] / bt[cam] * 100) if bt[cam] > 0 else 0
        lift = jsr(rs / bs, 2) if bs > 0 else (4 if rs > 0 else 1)
        out.append((cam, cat, rs, bs, jsr(rs - bs), lift, rc[key], bc[key]))
    out = [o for o in out if o[6] > 0 or o[7] > 0]
    out.sort(key=lambda o: (-abs(o[4]), -o[6], o[0], o[1]))
    return out


def novelty_parts(rows):
    sorted_dates, rec, base = windows([r[0] for r in rows])
    shifts = {(o[0], o[1]): o[4] for o in shift_matrix(rows)}  # all pairs, uncut
    elig = [r for r in rows if r[2] != "empty_scene"]
    combo, cath, cur, bcnt = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(int)
    for d, cam, cat, h, n in elig:
        combo[(cam, cat, h)] += n
        cath[(cat, h)] += n
        if d in rec:
            cur[(cam, cat, h)] += n
        if d in base:
            bcnt[(cam, cat, h)] += n
    mc = max(list(combo.values()) + [1])
    mh = max(list(cath.values()) + [1])
    rd, bd = max(len(rec), 1), max(len(base), 1)

    def score(key, rate):
        cam, cat, h = key
        bda = jsr(bcnt[key] / bd, 2)
        dev = max(0, rate - bda)
        sh = shifts.get((cam, cat), 0)
        return jsr(100 * (0.45 * (1 - combo[key] / mc) + 0.25 * (1 - cath[(cat, h)] / mh)
                          + 0.2 * min(1, dev / max(bda, 1)) + 0.1 * min(1, max(0, sh) / 25))), bda, sh
    return sorted_dates, rec, elig, cur, combo, cath, rd, score


def novel_events(rows):
    _, _, _, cur, combo, cath, rd, score = novelty_parts(rows)
    out = []
    for key, n in cur.items():
        s, bda, sh = score(key, n / rd)
        out.append((key[0], key[1], key[2], n, bda, combo[key], cath[(key[1], key[2])], jsr(sh), s))
    out.sort(key=lambda o: (-o[8], -o[3], o[0], o[1], o[2]))
    return out


def novelty_by_date(rows):
    _, rec, elig, _, _, _, _, _ = novelty_parts(rows)
    top = {(o[0], o[1], o[2]): o for o in novel_events(rows)}
    by = {}
    for d, cam, cat, h, n in sorted(elig, key=lambda r: (r[0], r[1], r[2], r[3])):
        o = top.get((cam, cat, h))
        if d not in rec or o is None or o[8] < 70:
            continue
        cnt, drv, best = by.get(d, (0, None, -1))
        if o[8] > best:
            drv, best = f"{cam} {cat} @ {h:02d}:00", o[8]
        by[d] = (cnt + n, drv, best)
    return {d: (v[0], v[1]) for d, v in by.items()}


def novelty_timeline(rows):
    sorted_dates, _, elig, _, _, _, _, score = novelty_parts(rows)
    out = {}
    for d in sorted_dates:
        q = []
        for dd, cam, cat, h, n in sorted(elig, key=lambda r: (r[1], r[2], r[3])):
            if dd != d:
                continue
            s = score((cam, cat, h), n)[0]
            if s >= 70:
                q.append((cam, cat, h, n, s))
        if not q:
            out[d] = (0, 0.0, 0.0, None, None)
            continue
        contrib = defaultdict(int)
        for _, cat, _, n, _ in q:
            contrib[cat] += n
        best = max(q, key=lambda x: (x[4], [-ord(c) for c in ""]))
        first_best = next(x for x in q if x[4] == max(y[4] for y in q))
        dom = sorted(contrib.items(), key=lambda kv: (-kv[1], kv[0]))[0][0]
        out[d] = (sum(x[3] for x in q), jsr(sum(x[4] for x in q) / len(q)), jsr(max(x[4] for x in q)),
                  f"{first_best[0]} {first_best[1]} @ {first_best[2]:02d}:00", dom)
        del best
    return out


def camera_forecast(cam_rows):
    dates, rec, _ = windows([r[0] for r in cam_rows])
    cams = sorted({r[1] for r in cam_rows})
    cnt = {(r[1], r[0]): r[2] for r in cam_rows}
    out = []
    for cam in cams:
        for i, d in enumerate(dates):
            actual = cnt.get((cam, d), 0)
            prior = [cnt.get((cam, p), 0) for p in dates[max(0, i - 7):i]]
            raw = sum(prior) / len(prior) if prior else actual
            exp = jsr(raw, 2)
            delta = jsr(actual - exp, 2)
            res = jsr(delta / exp * 100) if exp > 0 else (100 if actual > 0 else 0)
            if d in rec and not (actual == 0 and exp == 0):
                out.append((d, cam, actual, exp, delta, res))
    return out


def make_rows(n_dates, seed=7, gap=True):
    rnd = random.Random(seed)
    cams = [f"cam-{i:02d}" for i in range(8)]
    cats = ["wildlife", "human", "vehicle", "empty_scene", "unknown", "threat"]
    dates = [D0 + dt.timedelta(days=i + (3 if gap and i > n_dates // 2 else 0)) for i in range(n_dates)]
    rows = []
    for di, d in enumerate(dates):
        for cam in cams:
            if rnd.random() < 0.15:
                continue  # camera absent that day
            for cat in cats:
                for h in rnd.sample(range(24), 3):
                    w = 4 if cat in ("wildlife", "human") else 1
                    if rnd.random() < 0.5:
                        rows.append((d, cam, cat, h, rnd.randint(1, 3 * w)))
    # rare late patterns: novel in the recent window
    for k in range(3):
        rows.append((dates[-1 - min(k, n_dates - 1)], "cam-07", "threat", 3 + k, 6 + k))
        # a category seen only in the recent window: lift = 4
        rows.append((dates[-1 - min(k, n_dates - 1)], "cam-06", "intruder", 2, 5))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "date date, camera_name string, category string, hour int, count bigint")


def close(a, b):
    return all((x == y) or (isinstance(x, float) and isinstance(y, (int, float)) and abs(x - y) < 1e-9)
               for x, y in zip(a, b)) and len(a) == len(b)


@pytest.mark.parametrize("n", [1, 4, 5, 6, 15, 42, 60])
def test_analysis_windows(spark, n):
    rows = make_rows(n, gap=n > 3)
    s, rec, base = windows([r[0] for r in rows])
    got = L.analysis_windows(frame(spark, rows)).collect()
    assert {r["date"] for r in got if r["is_recent"]} == rec
    assert {r["date"] for r in got if r["is_baseline"]} == base


@pytest.fixture(scope="module")
def rows42():
    return make_rows(42)


def test_category_shift_matrix_cut(spark, rows42):
    full = L.category_shift_all(frame(spark, rows42)).count()
    assert full > 36
    got = [tuple(r) for r in L.category_shift_matrix(frame(spark, rows42)).collect()]
    exp = shift_matrix(rows42)[:36]
    assert len(got) == 36
    assert sorted(got) == sorted(exp)
    lifts = {(r["camera_name"], r["category"]): r["lift"]
             for r in L.category_shift_all(frame(spark, rows42)).collect()}
    assert lifts[("cam-06", "intruder")] == 4


def test_novel_events(spark, rows42):
    patterns = L.novel_patterns(frame(spark, rows42))
    exp = novel_events(rows42)
    assert patterns.count() == len(exp) > 12
    got, exp = L.novel_events(patterns).collect(), exp[:12]
    assert len(got) == 12
    for g, e in zip(sorted(got, key=lambda r: (r[0], r[1], r[2])), sorted(exp, key=lambda r: r[:3])):
        assert close(tuple(g)[:9], e), (tuple(g), e)
    assert max(e[8] for e in exp) >= 70


def test_novelty_by_date(spark, rows42):
    df = frame(spark, rows42)
    got = {r["date"]: (r["novel_event_count"], r["top_driver"]) for r in L.novelty_by_date(df, L.novel_patterns(df)).collect()}
    exp = novelty_by_date(rows42)
    assert got == exp and len(exp) > 0


def test_novelty_timeline(spark, rows42):
    got = {r["date"]: tuple(r)[1:] for r in L.novelty_timeline(frame(spark, rows42)).collect()}
    exp = novelty_timeline(rows42)
    assert set(got) == set(exp)
    for d in exp:
        assert close(got[d], exp[d]), (d, got[d], exp[d])


@pytest.mark.parametrize("n", [1, 6, 15, 42])
def test_camera_forecast_matches_dense_loop(spark, n):
    rows = make_rows(n)
    cd = defaultdict(int)
    for d, cam, _, _, c in rows:
        cd[(d, cam)] += c
    cam_rows = [(d, cam, c) for (d, cam), c in cd.items()]
    df = spark.createDataFrame(cam_rows, "date date, camera_name string, count bigint")
    got = sorted(tuple(r)[:6] for r in L.camera_forecast(df).collect())
    exp = sorted(camera_forecast(cam_rows))
    assert len(got) == len(exp)
    for g, e in zip(got, exp):
        assert close(g, e), (g, e)
