"""Streams against batch: late rows, restarts, upserts."""

import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from cohortlake.operators import audit
from cohortlake.sources import bindings as B, schemas
from cohortlake.streaming import audit_stream as ST

START = datetime(2024, 1, 1)


def _write(spark, folder, rows, name):
    df = spark.createDataFrame(rows, schemas.EVENTS).coalesce(1)
    df.write.mode("append").parquet(os.path.join(folder, name))
    return df


def _event(i, minutes, user=1, kind="view"):
    return (i, START + timedelta(minutes=minutes), user, kind, 1.0, "{}")


def _stream(spark, folder):
    return ST.read_files(spark, os.path.join(folder, "*"), schemas.EVENTS, files_per_trigger=1)


def test_audit_stream_survives_a_restart_without_repeats(spark, tmp_path):
    source, out, check = (os.path.join(tmp_path, n) for n in ("in", "out", "check"))
    first = _write(spark, source, [_event(i, i * 50) for i in range(40)], "a")
    events = B.shape_access_events(_stream(spark, source))
    ST.run_available(ST.append_audit(events, out, check))
    ST.run_available(ST.append_audit(events, out, check))  # nothing new
    second = _write(spark, source, [_event(i, i * 50) for i in range(40, 60)], "b")
    ST.run_available(ST.append_audit(events, out, check))
    log = audit.read_log(spark, out)
    batch = audit.build_records(B.shape_access_events(first.unionByName(second)))
    assert log.count() == 60 and log.select("log_id").distinct().count() == 60
    assert log.select("log_id").exceptAll(batch.select("log_id")).count() == 0
    assert {d for d in os.listdir(out) if d.startswith("event_date")} == {"event_date=2024-01-01", "event_date=2024-01-02", "event_date=2024-01-03"}


def test_late_rows_count_until_the_watermark(spark, tmp_path):
    source, out, check = (os.path.join(tmp_path, n) for n in ("in", "out", "check"))
    events = B.shape_access_events(_stream(spark, source))

    def drain():
        ST.run_available(ST.write_windows(ST.action_counts(events, key="user_id"), out, check))

    _write(spark, source, [_event(1, 10), _event(2, 100)], "a")  # watermark 00:40
    drain()
    _write(spark, source, [_event(3, 20), _event(4, 200)], "b")  # 3 is late but allowed; watermark 02:20
    drain()
    _write(spark, source, [_event(5, 30), _event(6, 400)], "c")  # 5 is too late
    drain()
    got = {(r["window_start"], r["n"]) for r in spark.read.parquet(out).collect()}
    assert got == {(START, 2), (START + timedelta(hours=1), 1), (START + timedelta(hours=3), 1)}


def test_status_upserts(spark, tmp_path):
    source, out, check = (os.path.join(tmp_path, n) for n in ("in", "out", "check"))
    updates = B.shape_transfer_updates(_stream(spark, source))
    _write(spark, source, [_event(1, 0, 1, "requested"), _event(2, 5, 2, "requested")], "a")
    ST.run_available(ST.write_status(updates, out, check))
    _write(spark, source, [_event(3, 9, 1, "confirmed"), _event(4, 9, 1, "arrived"), _event(5, 1, 2, "stale")], "b")
    ST.run_available(ST.write_status(updates, out, check))
    got = {r["transfer_id"]: r["status"] for r in ST.read_status(spark, out).collect()}
    assert got == {"xfer_1": "arrived", "xfer_2": "requested"}


def test_look_back_window_and_filters(spark):
    rows = [_event(i, i * 60, i % 3, "view") for i in range(48)]
    log = audit.with_event_date(audit.build_records(B.shape_access_events(spark.createDataFrame(rows, schemas.EVENTS))))
    anchor = F.lit("2024-01-02 12:00:00").cast("timestamp")
    assert audit.look_back(log, anchor, 24).count() == 25
    assert audit.look_back(log, anchor, 24, user_id="user_1").count() == 8
    newest = audit.look_back(log, anchor, 24, limit=3).collect()
    assert [r["logged_at"].hour for r in newest] == [12, 11, 10]
