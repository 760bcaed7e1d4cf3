"""Properties of physical plans: what must and must not appear in them."""

import io
import os
import re
from contextlib import redirect_stdout

import pytest

from cohortlake.plans.catalogue import CATALOGUE
from tests.conftest import SMALL


def plan(df, mode="formatted"):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


# single-partition exchanges are fine after a reduction to a bounded number of rows
RAW_PLANS = [
    "j01_fact_admission", "j02_dim_patient", "j03_clinical_features", "j05_transfer_counts", "j10_repeated_patients",
    "w01_first_admission", "w02_transfer_sequence", "w03_surrogate_key", "w04_readmissions", "m02_stratified_split",
    "m06_label_encoding", "t06_bed_allocation", "v04_anonymise", "v15_audit_records", "p36_transfer_decisions",
]


@pytest.mark.parametrize("name", RAW_PLANS)
def test_no_single_task_over_rows(spark, name):
    text = plan(CATALOGUE[name].run(spark, SMALL))
    for exchange in re.findall(r"Exchange.*?Arguments: ([^\n]*)", text, flags=re.S):
        assert not exchange.startswith("SinglePartition") or "executorId" in exchange, text


# their result is a table made on the driver from streams, fitted models or one row per round
NO_PLAN = {"m10_random_forest", "m14_federated_rounds"} | {n for n in CATALOGUE if n.startswith("st") and n[2].isdigit()}


@pytest.mark.parametrize("name", sorted(set(CATALOGUE) - NO_PLAN))
def test_no_python_and_no_cross_join(spark, name):
    text = plan(CATALOGUE[name].run(spark, SMALL), "simple")
    for node in ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "PythonUDF", "CartesianProduct"):
        assert node not in text, text
    assert not re.search(r"BroadcastNestedLoopJoin.*Cross", text), text


def test_filters_and_columns_reach_the_scan(spark, tables):
    from pyspark.sql import functions as F

    text = plan(tables.raw("orders").filter(F.col("o_orderkey") > 5).select("o_custkey"))
    assert "PushedFilters: [IsNotNull(o_orderkey), GreaterThan(o_orderkey,5)]" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in text
    text = plan(CATALOGUE["a25_event_rate"].run(spark, SMALL))
    assert "o_totalprice" not in text


def test_site_filter_prunes_partitions(spark, tables, tmp_path):
    from cohortlake.operators.curated import site_table
    from cohortlake.sources import tables as S

    path = os.path.join(tmp_path, "stays")
    S.write_table(tables.predictions.withColumnRenamed("site", "assigned_hospital"), path,
                  by=("assigned_hospital", "data_split"), key="row_id")
    text = plan(S.scan_split(site_table(S.read_table(spark, path), "hospital_a"), "train"))
    assert re.search(r"PartitionFilters: \[.*assigned_hospital.*data_split", text)


def test_statistics_shuffle_after_partial_aggregation(spark):
    text = plan(CATALOGUE["a25_event_rate"].run(spark, SMALL), "simple")
    assert text.count("Exchange hashpartitioning") == 1 and "partial_" in text


def test_join_small_broadcasts_only_below_the_limit(spark):
    from cohortlake.operators.joins import join_small

    large, small = spark.range(1000), spark.range(50)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in plan(join_small(large, small, "id"), "simple")
        assert "BroadcastHashJoin" not in plan(join_small(large, small, "id", limit=10), "simple")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert join_small(large, small, "id", limit=10).count() == 50


def final_plan(df):
    """The plan after adaptive execution, with the exchanges that were reused."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["a07_value_distribution", "a22_value_counts"])
def test_totals_share_the_exchange_of_the_counts(spark, name):
    name = next(n for n in CATALOGUE if n.startswith(name[:3]))
    assert "ReusedExchange" in final_plan(CATALOGUE[name].run(spark, SMALL))


def test_profiles_shuffle_digests_not_texts(spark):
    text = plan(CATALOGUE["a16_string_profile"].run(spark, SMALL), "simple")
    expand = re.search(r"Expand \[[^\n]*\], \[([^\n]*)\]", text).group(1)
    assert "md5" in expand and not re.search(r"\btext#", expand), expand


def test_run_edges_are_filtered_not_aggregated(spark):
    text = plan(CATALOGUE["w04_readmissions"].run(spark, SMALL), "simple")
    assert "SortAggregate" not in text
    assert re.search(r"Window \[lag[^\n]*\], \[_run#\w+, subject_id", text), text
