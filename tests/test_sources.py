"""Sources and sinks round trips in a scratch folder (S3-S9, A1 rebuild)."""

import csv
import datetime as dt
import glob
import gzip
import json
import os

import pytest

from conftest import SMALL, raw_frame

from burstlens.operators import summary as SM
from burstlens.sources import adapter, ingest, sinks, staging


def test_raw_export_array_with_mixed_timestamps(spark, scratch):
    recs = []
    for i, ts in enumerate(["2025-03-01 06:05:04", "2025-03-01T07:05:04", "2025-03-01T08:05:04.123456", "junk"]):
        rec = {k: None for k in ingest.RAW_EXPORT_KEYS}
        rec.update(id=f"e{i}", mac="m1", event="g1", timestamp=ts, utc_timestamp=ts, sequence=i + 1,
                   batteryPercentage=50.5, heatLevel=7, fileType="camera", lux=12, uploaded=i % 2 == 0,
                   analysis={"title": f"T{i}", "summary": "wolf, near", "details": {"main_subject": "wolf"}})
        recs.append(rec)
    path = os.path.join(scratch, "export.json.gz")
    with gzip.open(path, "wt") as fh:
        fh.write(json.dumps(recs))
    raw = ingest.read_raw_export(spark, path)
    got = {r["id"]: r for r in raw.collect()}
    assert got["e0"]["timestamp"] == dt.datetime(2025, 3, 1, 6, 5, 4)
    assert got["e1"]["timestamp"] == dt.datetime(2025, 3, 1, 7, 5, 4)
    assert got["e2"]["timestamp"] == dt.datetime(2025, 3, 1, 8, 5, 4, 123456)
    assert got["e3"]["timestamp"] is None
    assert json.loads(got["e0"]["analysis"])["title"] == "T0"
    events = ingest.raw_to_events(raw)
    assert len(events.columns) == 43
    flat = {r["id"]: r for r in ingest.export_projection(raw).collect()}
    assert flat["e1"]["analysis_title"] == "T1" and flat["e1"]["battery_percentage"] == 50.5
    loader = ingest.loader_projection(raw)
    assert loader.columns[15] == "battery_percentage" and len(loader.columns) == 23


def test_json_lines_export(spark, scratch):
    path = os.path.join(scratch, "export.jsonl")
    with open(path, "w") as fh:
        for i in range(5):
            fh.write(json.dumps({"id": f"x{i}", "timestamp": "2025-01-02 03:04:05", "lux": i}) + "\n")
    raw = ingest.read_raw_export(spark, path, json_lines=True)
    assert raw.count() == 5 and raw.filter("lux = 4").count() == 1


def test_merge_insert_ignore_keeps_first_and_skips_existing(spark):
    existing = spark.createDataFrame([("a", 1)], "id string, v int")
    incoming = spark.createDataFrame([("a", 9, 1), ("b", 2, 2), ("b", 3, 1), ("c", 4, 5)], "id string, v int, o int")
    out = {r["id"]: r["v"] for r in ingest.merge_insert_ignore(existing, incoming, "o").collect()}
    assert out == {"b": 3, "c": 4}


def test_head_export_is_whole_unless_cut(spark):
    raw = staging.raw_table(spark, SMALL)
    assert ingest.head_export(raw).count() == raw.count() > 1000
    ids = [r["id"] for r in ingest.head_export(raw, 30).collect()]
    assert ids == sorted(r["id"] for r in raw.select("id").collect())[:30]


def test_daily_summary_dynamic_overwrite(spark, scratch):
    t = dt.datetime(2024, 1, 1, 8)
    rows = [{"id": str(i), "mac": "m", "camera_name": "c", "event": f"g{i // 2}", "timestamp": t + dt.timedelta(days=i % 2),
             "utc_timestamp": t, "lux": 10 + i, "temperature": 1.005 * i, "subject_category": "wildlife",
             "time_of_day_bucket": "morning"} for i in range(6)]
    path = os.path.join(scratch, "dcs")
    sinks.write_daily_summary(SM.daily_camera_summary(raw_frame(spark, rows)), path)
    # rewrite only day 2 with fewer rows; day 1 must survive untouched
    sinks.write_daily_summary(SM.daily_camera_summary(raw_frame(spark, [rows[1]])), path)
    got = {str(r["date"]): r["total_rows"] for r in spark.read.parquet(path).collect()}
    assert got == {"2024-01-01": 3, "2024-01-02": 1}


def test_events_csv_quotes_every_cell(spark, scratch):
    df = spark.createDataFrame([("a", 'say "hi"', None, 3)], "timestamp string, analysis_title string, lux int, n int")
    path = os.path.join(scratch, "csv")
    sinks.write_events_csv(df, path)
    text = open(max(glob.glob(os.path.join(path, "part-*.csv")), key=os.path.getsize)).read().splitlines()
    assert text[1] == '"a","say ""hi""","","3"'


def test_query_csv_json_encodes_nested(spark, scratch):
    df = spark.createDataFrame([("x,y", [1, 2])], "label string, vals array<int>")
    path = os.path.join(scratch, "qcsv")
    sinks.write_query_csv(df, path)
    rows = list(csv.reader(open(max(glob.glob(os.path.join(path, "part-*.csv")), key=os.path.getsize))))
    assert rows[0] == ["label", "vals"] and rows[1] == ["x,y", "[1,2]"]


def test_staged_tables_are_reused_and_complete(spark):
    a = staging.raw_table(spark, SMALL)
    b = staging.raw_table(spark, SMALL)
    assert a is b
    assert os.path.exists(staging.latest(spark, staging.table_path(spark, SMALL, "raw")).replace("file:", "") + "/_SUCCESS")


def test_refresh_and_second_builder_leave_readers_alone(spark, monkeypatch):
    old = staging.raw_table(spark, SMALL)
    n, files = old.count(), set(old.inputFiles())
    new = staging.raw_table(spark, SMALL, refresh=True)
    assert new is not old and not files & set(new.inputFiles())
    path = staging.table_path(spark, SMALL, "raw")
    staging.write_raw(new.limit(3), staging._version(path), 2)  # another process's version
    assert old.count() == new.count() == n
    monkeypatch.setattr(staging, "TASK_BYTES", 1 << 10)
    assert staging._parts(spark, f"{SMALL}/events.parquet") > 8
    staging._MEMO.clear()
    assert staging.raw_table(spark, SMALL).count() == 3  # the newest complete one is read
    staging.raw_table(spark, SMALL, refresh=True)


def test_merge_insert_ignore_null_and_tied_order(spark):
    existing = spark.createDataFrame([("a", 1)], "id string, v int")
    rows = [("b", 2, None), ("c", 9, None), ("c", 3, 5), ("d", 5, 7), ("d", 4, 7), (None, 1, 1), ("a", 8, 1)]
    incoming = spark.createDataFrame(rows, "id string, v int, o int")
    for frame in (incoming, incoming.repartition(4)):
        out = {r["id"]: r["v"] for r in ingest.merge_insert_ignore(existing, frame, "o").collect()}
        assert out == {"b": 2, "c": 3, "d": 4}


def test_staged_tables_follow_source_and_rules(spark, scratch, monkeypatch):
    import os

    from burstlens.sources import staging
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    where = os.path.join(scratch, "events.parquet")
    events.write.parquet(where)
    n = events.count()
    assert staging.canonical_table(spark, scratch).count() == n
    events.withColumn("event_id", events["event_id"] + 10_000_000).write.mode("append").parquet(where)
    assert staging.canonical_table(spark, scratch).count() == 2 * n
    before = staging.table_path(spark, scratch)
    real = staging.inspect.getsource
    monkeypatch.setattr(staging.inspect, "getsource", lambda m: real(m) + "#" * (m is staging.constants))
    assert staging.table_path(spark, scratch) != before


def test_array_splits_equal_the_whole_read(spark, scratch):
    """Every range size finds the same records, whatever the strings hold."""
    hard = ["", "x", "\\\\", '"', '\\\\"', "[{", "}]", "é漢\n", "a, {b}", "\\\\" * 9]
    recs = [{"id": f"e{i}", "event": hard[i % 10] + hard[i // 10 % 10], "lux": i, "timestamp": "2025-03-01T07:05:04",
             "analysis": {"title": hard[i % 7], "more": [{"k": hard[i % 3]}]}} for i in range(120)]
    folder = os.path.join(scratch, "deliveries")
    os.makedirs(folder)
    for name, part, indent in (("a", recs[:70], None), ("b", recs[70:], 2), ("empty", [], None)):
        with open(os.path.join(folder, f"{name}.json"), "w", encoding="utf-8") as out:
            json.dump(part, out, ensure_ascii=name == "a", indent=indent)
    open(os.path.join(folder, "nothing.json"), "w").close()
    whole = sorted(map(repr, spark.read.schema(ingest.raw_export_schema()).option("multiLine", True).json(folder).select("id", "event", "lux").collect()))
    assert len(whole) == 120
    for size in (37, 300, 1 << 20):
        raw = ingest.read_raw_export(spark, folder, range_bytes=size)
        assert sorted(map(repr, raw.select("id", "event", "lux").collect())) == whole
    title = {r["id"]: json.loads(r["analysis"])["title"] for r in raw.collect()}
    assert title == {r["id"]: r["analysis"]["title"] for r in recs}


def test_ranges_alone_find_records():
    """The scan on bytes: states carried from range to range, tiny ranges."""
    import io
    import random

    from burstlens.sources import json_array as J
    import numpy as np
    rnd = random.Random(2)
    for _ in range(60):
        recs = [{"a": "".join(rnd.choice('\\\\"{}[],x') for _ in range(rnd.randint(0, 9))), "b": [{"c": "}"}]} for _ in range(rnd.randint(0, 9))]
        raw = json.dumps(recs, indent=rnd.choice([None, 1])).encode()
        file, step, inside, depth, got = io.BytesIO(raw), rnd.randint(1, 40), 0, 0, []
        for start in range(0, len(raw), step):
            stop = min(start + step, len(raw))
            got += [json.loads(t) for t in J.records(file, start, stop, bool(inside), depth, step)]
            data = np.frombuffer(raw[start:stop], np.uint8)
            marks = J.quotes(data, J._escaped(file, start))
            depth += int(J.depths(data, marks, bool(inside))[1].sum())
            inside = (inside + len(marks)) % 2
        assert got == recs


def test_bronze_sorts_source_rows_and_makes_raw_ones_once(spark, scratch):
    """Shuffle and sort see the source's columns, not the 43 of a raw row."""
    from pyspark.sql import functions as F

    source = adapter.read_table(spark, SMALL, "events")
    widths = []

    def made(rows):
        widths.append(len(rows.columns))
        return adapter.camera_events_from(spark, rows)

    staging.write_raw(source, f"{scratch}/raw", 3, (F.col("ts"), F.col("event_id").cast("string")), made)
    assert widths == [6]
    got, want = spark.read.parquet(f"{scratch}/raw"), adapter.camera_events(spark, SMALL)
    assert got.dtypes == want.dtypes and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_staging_writes_split_long_methods_and_scans(spark, scratch):
    """Staging writes run under their own settings; the session's come back, also after a failure."""
    before = {k: spark.conf.get(k, None) for k in staging.WRITING}
    seen = []

    def write(path):
        seen.append({k: spark.conf.get(k) for k in staging.WRITING})
        spark.range(3).write.parquet(path)

    staging._staged(spark, f"{scratch}/t", write, False)
    assert seen == [staging.WRITING] and int(seen[0]["spark.sql.codegen.hugeMethodLimit"]) == 8000
    with pytest.raises(ZeroDivisionError):
        staging._staged(spark, f"{scratch}/u", lambda path: 1 / 0, False)
    assert {k: spark.conf.get(k, None) for k in staging.WRITING} == before
    assert staging.TASK_BYTES <= 8 << 20


def test_brackets_and_quotes_equal_a_loop():
    import random

    import numpy as np

    from burstlens.sources import json_array

    rnd = random.Random(5)
    for _ in range(600):
        raw = bytes(rnd.choice(b'"\\\\{}[]a') for _ in range(rnd.randrange(14)))
        for escaped in (False, True):
            marks, run = [], int(escaped)
            for i, c in enumerate(raw):
                if c == 34 and run % 2 == 0:
                    marks.append(i)
                run = run + 1 if c == 92 else 0
            data = np.frombuffer(raw, np.uint8)
            found = json_array.quotes(data, escaped)
            assert found.tolist() == marks, (raw, escaped)
            for inside in (False, True):
                want = [(i, 1 if c in json_array.OPEN else -1) for i, c in enumerate(raw)
                        if c in b"{}[]" and (sum(m <= i for m in marks) + inside) % 2 == 0]
                at, steps = json_array.depths(data, found, inside)
                assert [*zip(at.tolist(), steps.tolist())] == want


def test_page_index_is_cut_finer_than_the_bronze_table(spark, monkeypatch):
    monkeypatch.setattr(staging, "TASK_BYTES", 1 << 10)
    assert staging._parts(spark, f"{SMALL}/events.parquet", 4) > 3 * staging._parts(spark, f"{SMALL}/events.parquet")


def test_field_map_flattens_the_nested_documents(spark, scratch, monkeypatch):
    """Title and summary come from ``analysis``, nested or as text, not from the flat keys beside it."""
    from burstlens.plans.registry import QUERIES

    docs = {"nested": {"title": "T", "summary": "a, \"wolf\"", "details": {"title": "inner"}}, "text": '{"title":"T","summary":"s"}',
            "part": {"title": "T"}, "blank": {"title": " ", "summary": ""}, "number": {"title": 5, "summary": None},
            "none": None, "junk": "not json", "cut": '{"title":"T","summary":', "list": [{"title": "T"}], "empty": {}}
    want = {"nested": ("T", 'a, "wolf"'), "text": ("T", "s"), "part": ("T", None), "blank": (" ", ""), "number": ("5", None)}
    recs = [{"id": k, "analysis": v, "analysis_title": "stored", "analysis_summary": "stored", "batteryPercentage": 50.5,
             "heatLevel": 7, "fileType": "camera"} for k, v in docs.items()]
    del recs[0]["analysis_title"], recs[0]["analysis_summary"]  # a document of the store has no flat keys
    recs += recs[:2]
    with open(os.path.join(scratch, "a.json"), "w") as out:
        json.dump(recs, out)
    monkeypatch.setattr(staging, "export_folder", lambda spark, d: scratch)
    mapped = QUERIES["ingest_field_map"](spark, SMALL)
    assert mapped.columns == [dst for dst, _ in ingest.LOADER_FIELDS]
    got = sorted((r["id"], r["analysis_title"], r["analysis_summary"]) for r in mapped.collect())
    assert got == sorted((r["id"], *want.get(r["id"], (None, None))) for r in recs)
    assert {(r["battery_percentage"], r["heat_level"], r["file_type"]) for r in mapped.collect()} == {(50.5, 7.0, "camera")}
