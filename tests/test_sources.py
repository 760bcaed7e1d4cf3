"""Readers, writers, baselines, layers, drift and quality."""

import os

import pytest
from pyspark.sql import functions as F

from cohortlake.operators import profile as P
from cohortlake.plans import layers
from cohortlake.session import drop_intermediates, materialise, run_path, shared_dir
from cohortlake.sources import schemas, tables as S


def test_shared_folder_comes_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert shared_dir(spark) == configured
    assert run_path(spark, "x").startswith(shared_dir(spark)) and run_path(spark, "x") != run_path(spark, "x")


def test_baseline_is_written_once(spark, tmp_path):
    path = os.path.join(tmp_path, "baseline")
    assert S.baseline(spark.range(3), path).count() == 3
    assert S.baseline(spark.range(9), path).count() == 3


def test_samples_repeat_and_do_not_overlap(spark):
    df = spark.range(1000)
    a = {r["id"] for r in S.hashed_rows(df, "id", 100, "s").collect()}
    assert a == {r["id"] for r in S.hashed_rows(df.repartition(7), "id", 100, "s").collect()}
    roles = {r["id"]: r["role"] for r in S.disjoint_samples(df, "id", 30, 20, "s").collect()}
    assert sorted(roles.values()) == ["background"] * 20 + ["sample"] * 30
    assert S.random_rows(df, 10, 1).count() == 10


def test_csv_export_keeps_nested_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"])], "id int, tags array<string>")
    S.export_csv({"t": df}, str(tmp_path))
    row = spark.read.option("header", True).option("escape", '"').csv(os.path.join(tmp_path, "t")).first()
    assert "a" in row["tags"] and "b" in row["tags"]


def test_layers_lazy_and_written_agree(spark, tables, tmp_path):
    sources = {"patients": tables.patients, "admissions": tables.admissions, "transfers": tables.transfers}
    lazy = layers.build_layers(sources)
    written = layers.write_layers(spark, sources, str(tmp_path), "agree_")
    for layer, built in lazy.items():
        assert list(built) == list(written[layer])
    for name in ("dataset_statistics", "data_leakage_check"):
        a, b = lazy["verification"][name], written["verification"][name]
        assert a.exceptAll(b.select(a.columns)).count() == 0 and a.count() == b.count()
    sites = layers.site_views(written["federated"]["site_data"])
    assert sum(df.count() for df in sites.values()) == written["federated"]["site_data"].count()
    assert S.layer_tables(spark, ["agree_verification"]) == {"agree_verification": ["data_leakage_check", "dataset_statistics"]}


def test_layers_evaluate_the_movements_once(spark, tables):
    lazy = layers.build_layers({"patients": tables.patients, "admissions": tables.admissions, "transfers": tables.transfers})
    stored = {name: df for built in lazy.values() for name, df in built.items()}
    for layer, name in (("curated", "fact_icu_stay"), ("curated", "clinical_features"), ("federated", "site_data")):
        assert layers.BUILDERS[layer][name](stored).columns == stored[name].columns


def test_table_size(spark, tmp_path):
    path = os.path.join(tmp_path, "t")
    spark.range(100).write.parquet(path)
    row = S.table_size(spark, path, "t").first()
    files = sum(os.path.getsize(os.path.join(path, f)) for f in os.listdir(path) if f.endswith(".parquet"))
    assert row["row_count"] == 100 and row["size_bytes"] == files


def test_profile_of_an_empty_table(spark):
    df = spark.createDataFrame([], "a int, b string, c timestamp, d boolean")
    rows = {r["field"]: r for r in P.profile(df, "t").collect()}
    assert set(rows) == {"a", "b", "c", "d"} and rows["a"]["count"] == 0 and rows["a"]["mean"] is None
    assert P.quality_findings(P.layer_profile({"t": df}, "l")).filter("type = 'high_null_rate'").count() == 0


def test_field_whose_name_starts_like_another(spark):
    df = spark.createDataFrame([(1, 10), (None, 20)], "a int, a_count int")
    rows = {r["field"]: r for r in P.profile(df, "t").collect()}
    assert rows["a"]["count"] == 1 and rows["a_count"]["count"] == 2 and rows["a"]["max"] == 1.0


def test_nested_and_repeated_fields(spark):
    df = spark.createDataFrame([], "id int, s struct<x:int,y:array<string>>, tags array<string>")
    rows = [(r["field"], r["field_type"], r["mode"]) for r in P.schema_rows({"t": df}, "l").orderBy("position").collect()]
    assert rows == [("id", "integer", "NULLABLE"), ("s", "struct", "NULLABLE"), ("s.x", "integer", "NULLABLE"),
                    ("s.y", "string", "REPEATED"), ("tags", "string", "REPEATED")]


def test_mode_change_and_row_change(spark):
    a = P.schema_rows({"t": spark.createDataFrame([(1,), (2,)], "id int")}, "l")
    b = a.withColumn("mode", F.lit("REQUIRED")).withColumn("n_rows", F.lit(1).cast("bigint"))
    drift = P.schema_drift(a, b).collect()
    assert [(r["change"], r["old"], r["new"]) for r in drift] == [("mode", "REQUIRED", "NULLABLE")]
    assert P.table_drift(a, b).first()["percent_change"] == 100.0
    assert P.schema_drift(a, a.withColumn("n_rows", F.lit(9).cast("bigint"))).count() == 0  # rows alone are no drift


def test_quality_error_is_raised(spark):
    now = P.layer_profile({"t": spark.range(10).toDF("id")}, "l")
    was = P.layer_profile({"t": spark.range(4).toDF("id")}, "l")
    findings = P.quality_findings(now, was)
    assert [(r["level"], r["value"]) for r in findings.collect()] == [("error", 150.0)]
    with pytest.raises(ValueError):
        P.require_quality(findings)
    P.require_quality(P.quality_findings(now, now))


def test_audit_schema_is_complete():
    assert len(schemas.AUDIT_LOG.fields) == 24
    assert [f.name for f in schemas.AUDIT_LOG.fields if not f.nullable] == [
        "log_id", "hospital_id", "action", "event_timestamp", "user_id"]


def test_intermediates_are_written_and_dropped(spark):
    kept = materialise(spark.range(5))
    folder = kept.inputFiles()[0].rsplit("/", 1)[0]
    assert kept.count() == 5 and S.path_exists(spark, folder)
    assert drop_intermediates(spark) >= 1 and not S.path_exists(spark, folder)
    assert drop_intermediates(spark) == 0


def test_a_large_partition_value_is_written_by_several_tasks(spark, tmp_path):
    from cohortlake.sources import tables as S

    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        rows = spark.range(0, 200_000, 1, 8).selectExpr("id", "uuid() AS filler", "if(id % 10 = 0, 'small', 'hot') AS site")
        S.write_table(rows, str(tmp_path / "t"), by=("site",), key="id")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(list((tmp_path / "t" / "site=hot").glob("*.parquet"))) > 2
    assert spark.read.parquet(str(tmp_path / "t")).count() == 200_000


def test_scopes_of_two_threads_leave_each_other_alone(spark):
    from concurrent.futures import ThreadPoolExecutor
    from threading import Barrier

    from cohortlake.session import intermediates

    both = Barrier(2)

    def work(rows, first):
        with intermediates(spark):
            kept = materialise(spark.range(rows))
            folder = kept.inputFiles()[0].rsplit("/", 1)[0]
            both.wait(60)
            if first:
                drop_intermediates(spark)
            both.wait(60)
            found = None if first else kept.count()
        return found, folder

    with ThreadPoolExecutor(2) as pool:
        one, other = pool.submit(work, 3, True), pool.submit(work, 4, False)
        assert other.result()[0] == 4
        assert not any(S.path_exists(spark, f.result()[1]) for f in (one, other))


def test_two_builds_never_share_catalog_names(spark):
    from cohortlake.plans.catalogue import CATALOGUE
    from tests.conftest import SMALL

    before = {d.name for d in spark.catalog.listDatabases()}
    first, second = (CATALOGUE["s08_ordered_build"].run(spark, SMALL) for _ in range(2))
    assert {d.name for d in spark.catalog.listDatabases()} == before
    assert sorted(first.collect()) == sorted(second.collect())


def test_drift_of_stored_sizes(spark):
    now = P.schema_rows({"t": spark.range(4)}, "l")
    sizes = spark.createDataFrame([("t", 3.5)], "table_name string, size_mb double")
    before = spark.createDataFrame([("t", 1.25)], "table_name string, size_mb double")
    row = P.table_drift(now, P.schema_rows({"t": spark.range(2)}, "l"), sizes, before).first()
    assert (row["delta"], row["baseline_mb"], row["current_mb"], row["delta_mb"]) == (2, 1.25, 3.5, 2.25)
