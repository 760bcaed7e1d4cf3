"""Versions of a set of tables, gates in the write, and status state that expires."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cohortlake.operators import profile as P
from cohortlake.sources import bindings as B, schemas, snapshots as SN
from cohortlake.streaming import audit_stream as ST


def builders(n):
    return {"curated": {"rows": lambda b: b["source"].limit(n)},
            "verification": {"total": lambda b: b["rows"].agg(F.count(F.lit(1)).alias("n"))}}


@pytest.fixture
def source(spark):
    return {"source": spark.range(100).select("id", F.lit("x").alias("part"), F.when(F.col("id") > 5, F.col("id")).alias("v"))}


def test_failed_builds_leave_the_version(spark, tmp_path, source):
    root = str(tmp_path)
    assert SN.open_version(spark, root) is None
    first = SN.build(spark, root, source, builders(100))
    assert (first.version, first.table("verification", "total").first()["n"]) == (1, 100)
    held = first.metrics().filter("field = 'v'").first()
    assert (held["row_count"], held["count"]) == (100, 94)
    broken = {**builders(80), "late": {"bad": lambda b: b["rows"].select(F.raise_error(F.lit("stop")).alias("x"))}}
    with pytest.raises(Exception, match="stop"):
        SN.build(spark, root, source, broken)
    # two layers of the failed build are written, and nobody reads them
    assert SN.versions(spark, root) == [1] and SN.open_version(spark, root).table("curated", "rows").count() == 100
    second = SN.build(spark, root, source, builders(60))
    assert SN.open_version(spark, root).version == second.version == 2
    pinned = SN.open_version(spark, root, 1)
    assert pinned.table("curated", "rows").count() == 100 and second.table("curated", "rows").count() == 60
    rows = {(r["layer"], r["table_name"]): r["row_count"] for r in second.manifest().collect()}
    assert rows == {("curated", "rows"): 60, ("verification", "total"): 1}
    with pytest.raises(ValueError):
        SN.open_version(spark, root, 7)


def test_a_gate_refuses_before_the_commit(spark, tmp_path, source):
    root = str(tmp_path)
    SN.build(spark, root, source, builders(100))
    with pytest.raises(SN.GateRefused) as refused:
        SN.build(spark, root, source, builders(30))
    assert {r["type"] for r in refused.value.findings.filter("level = 'error'").collect()} == {"row_count_anomaly"}
    assert SN.versions(spark, root) == [1]
    assert SN.build(spark, root, source, builders(30), gate=None).version == 2


def test_one_scan_writes_and_counts(spark, tmp_path, source):
    read = spark.sparkContext.accumulator(0)
    spark.sparkContext.setJobGroup("build", "build")
    df, counts = SN._observed(source["source"])
    df.write.parquet(f"{tmp_path}/t")
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("build")
    n, metrics = counts()
    assert n == 100 and ("v", "numeric", 94, pytest.approx(94, rel=0.1)) in metrics
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("build")) == len(jobs) and read.value == 0


def test_garbage_is_what_no_version_holds(spark, tmp_path, source):
    root = str(tmp_path)
    for n in (100, 90, 80, 70):
        SN.build(spark, root, source, builders(n))
    with pytest.raises(KeyError):
        SN.build(spark, root, source, {**builders(1), "late": {"x": lambda b: b["absent"]}})
    orphan = set(os.listdir(f"{root}/data")) - {SN.open_version(spark, root, v).run for v in (1, 2, 3, 4)}
    assert len(orphan) == 1
    assert SN.collect_garbage(spark, root, keep=2) == []  # the orphan may still be written
    assert SN.versions(spark, root) == [3, 4] and len(os.listdir(f"{root}/data")) == 3
    assert set(SN.collect_garbage(spark, root, keep=2, hours=0.0)) == orphan
    assert SN.open_version(spark, root, 3).table("curated", "rows").count() == 80
    assert SN.build(spark, root, source, builders(75)).version == 5


def test_status_state_stays_bounded(spark, tmp_path):
    source, out, check = (os.path.join(tmp_path, n) for n in ("in", "out", "check"))
    start, state, rows = datetime(2024, 1, 1), [], []
    for day in range(20):
        # ten new transfers a day, each confirmed on the next
        made = [(day * 100 + i, start + timedelta(days=day, minutes=i), day * 10 + i, "requested", 1.0) for i in range(10)]
        made += [(day * 100 + 50 + i, start + timedelta(days=day, minutes=30 + i), day * 10 + i - 10, "confirmed", 1.0)
                 for i in range(10) if day]
        rows += made
        frame = spark.createDataFrame([(a, b, c, d) for a, b, c, d, _ in made], "event_id long, ts timestamp_ntz, user_id long, event_type string")
        full = frame
        for f in schemas.EVENTS.fields:
            if f.name not in frame.columns:
                full = full.withColumn(f.name, F.lit(None).cast(f.dataType))
        full.select(*[F.col(f.name).cast(f.dataType) for f in schemas.EVENTS.fields]).coalesce(1).write.mode("append").parquet(source)
        updates = B.shape_transfer_updates(ST.read_files(spark, source, schemas.EVENTS))
        query = ST.write_bounded_status(updates, out, check, "2 days", compact_every=4).trigger(availableNow=True).start()
        query.awaitTermination()
        state.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert max(state) <= 100 and max(state[10:]) <= max(state[:10]) + 20
    got = {r["transfer_id"]: r["status"] for r in ST.read_bounded_status(spark, out).collect()}
    latest = {}
    for event, ts, who, status, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        latest[f"xfer_{who}"] = status
    assert got == latest
    # old batches are gone, and the newest merged folder is there
    assert len([n for n in os.listdir(out) if n.startswith("batch=")]) <= 16
    assert len(os.listdir(f"{out}/merged")) <= 2


def test_status_of_nothing(spark, tmp_path):
    assert ST.read_bounded_status(spark, f"{tmp_path}/none").count() == 0


def test_gate_of_a_profile_without_columns(spark, tmp_path):
    snap = SN.build(spark, str(tmp_path), {"s": spark.range(3)}, {"l": {"t": lambda b: b["s"].select(F.array("id").alias("a"))}})
    assert snap.metrics().count() == 0 and P.quality_findings(snap.metrics()).count() == 0
