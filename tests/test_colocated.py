"""Tables in buckets of their join key: no shuffle in the joins, plain tables where one bucket is too full."""

import uuid

import pytest
from pyspark.sql import functions as F

from cohortlake.operators import curated
from cohortlake.plans import layers
from cohortlake.sources import colocated


@pytest.fixture
def unshared(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.fixture(scope="module")
def built(spark, tables, tmp_path_factory):
    folder, prefix = str(tmp_path_factory.mktemp("layers")), f"t_{uuid.uuid4().hex[:8]}_"
    given = {"patients": tables.patients, "admissions": tables.admissions, "transfers": tables.transfers}
    stored = layers.colocated_sources(spark, given, folder, prefix, buckets=4)
    return given, stored, layers.write_layers(spark, stored, folder, prefix, buckets=4)


def test_joins_on_the_key_need_no_shuffle(built, unshared):
    given, stored, out = built
    curated_ = out["curated"]
    j01 = curated.fact_hospital_admission(stored["admissions"], stored["patients"])
    j02 = curated.dim_patient(stored["patients"], stored["admissions"])
    j05 = curated_["fact_hospital_admission"].select("hadm_id").join(
        curated.transfer_counts(stored["transfers"]), "hadm_id", "left")
    assert [exchanges(df) for df in (j01, j02, j05)] == [0, 0, 0]
    # the stays meet admissions and movements in place and move once, to their persons
    j03 = curated.clinical_features(
        curated_["fact_icu_stay"], curated_["fact_hospital_admission"], curated_["dim_patient"], stored["transfers"])
    assert exchanges(j03) == 1
    plain = curated.fact_hospital_admission(given["admissions"], given["patients"])
    assert exchanges(plain) == 2 and sorted(plain.collect()) == sorted(j01.collect())


def test_layers_with_buckets_hold_the_same_rows(built):
    given, _, out = built
    lazy = layers.build_layers(given)
    for layer, tables_ in out.items():
        for name, stored in tables_.items():
            want = lazy[layer][name].select(*stored.columns)
            assert stored.exceptAll(want).count() == 0 and want.exceptAll(stored).count() == 0, name


@pytest.mark.parametrize("key", [7, None])
def test_a_hot_key_is_stored_without_buckets(spark, tmp_path, key):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(key)).otherwise(F.col("id")).alias("k"), "id")
    names = [f"hot_{uuid.uuid4().hex[:8]}" for _ in range(3)]
    hot = colocated.store(df, names[0], "k", str(tmp_path / "a"), 8, most=900)
    fits = colocated.store(df, names[1], "k", str(tmp_path / "b"), 8, most=2000)
    empty = colocated.store(df.limit(0), names[2], "k", str(tmp_path / "c"), 8)
    assert [colocated.is_bucketed(spark, n) for n in names] == [False, True, True]
    assert hot.exceptAll(fits).count() == 0 and hot.count() == fits.count() == 3000
    assert empty.count() == 0 and empty.columns == ["k", "id"]
    for n in names:
        spark.sql(f"DROP TABLE {n}")
