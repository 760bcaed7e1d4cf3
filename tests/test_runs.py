"""Ordered runs against brute force, with hot keys, ties, NULLs and empty input."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlake.operators.runs import exact_quantiles, sorted_runs


def _rows(seed, n=3000):
    rng = random.Random(seed)
    # one key holds a third of the rows, another is NULL
    keys = [7] * (n // 3) + [None] * 50 + [rng.randrange(40) for _ in range(n - n // 3 - 50)]
    rows = [(k, rng.randrange(200), i, rng.randrange(5)) for i, k in enumerate(keys)]
    rng.shuffle(rows)
    return rows


def _order(row):
    return (row[0] is not None, row[0] or 0, row[1], row[2])


@pytest.fixture(params=[1, 2])
def frame(spark, request):
    rows = _rows(request.param)
    return rows, spark.createDataFrame(rows, "k int, t int, id int, v int").repartition(6)


def test_global_number(frame):
    rows, df = frame
    got = {r["id"]: r["n"] for r in sorted_runs(df, ["k", "t", "id"], 7).numbered("n").collect()}
    want = {r[2]: i + 1 for i, r in enumerate(sorted(rows, key=_order))}
    assert got == want


def test_keyed_number_and_sum(frame):
    rows, df = frame
    placed = sorted_runs(df, ["k", "t", "id"], 7).running(["k"], {"n": F.lit(1), "s": F.col("v")})
    got = {r["id"]: (r["n"], r["s"]) for r in placed.collect()}
    want, seen = {}, {}
    for k, _, i, v in sorted(rows, key=_order):
        n, s = seen.get(k, (0, 0))
        seen[k] = want[i] = (n + 1, s + v)
    assert got == want


@pytest.mark.parametrize("step", [1, -1])
def test_shift(frame, step):
    rows, df = frame
    placed = sorted_runs(df, ["k", "t", "id"], 7).shifted(["k"], {"near": "id"}, step)
    got = {r["id"]: r["near"] for r in placed.collect()}
    ordered = sorted(rows, key=_order)
    want = {}
    for i, row in enumerate(ordered):
        j = i - step
        near = ordered[j] if 0 <= j < len(ordered) else None
        want[row[2]] = near[2] if near is not None and near[0] == row[0] else None
    assert got == want


def test_merged_ranges_keep_order(spark, frame):
    rows, df = frame
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        got = {r["id"]: r["n"] for r in sorted_runs(df, ["k", "t", "id"]).numbered("n").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {r[2]: i + 1 for i, r in enumerate(sorted(rows, key=_order))}


def test_shift_rejects_other_steps(frame):
    with pytest.raises(ValueError):
        sorted_runs(frame[1], ["k", "t", "id"]).shifted(["k"], {"x": "id"}, 2)


def test_empty(spark):
    df = spark.createDataFrame([], "k int, t int, id int, v int")
    assert sorted_runs(df, ["k", "t"]).row_number(["k"]).collect() == []
    assert sorted_runs(df, ["k", "t"]).shifted(["k"], {"x": "t"}, 1).collect() == []
    assert exact_quantiles(df, ["k"], "v", {"m": 0.5}).collect() == []


def test_quantiles(frame):
    rows, df = frame
    probabilities = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.95, "e": 1.0}
    got = {r["k"]: [r[p] for p in probabilities] for r in exact_quantiles(df, ["k"], "t", probabilities).collect()}
    groups = {}
    for k, t, _, _ in rows:
        groups.setdefault(k, []).append(t)
    assert set(got) == set(groups)
    for k, values in groups.items():
        np.testing.assert_allclose(got[k], np.quantile(values, list(probabilities.values())))


def test_quantile_without_keys_and_nulls(spark):
    df = spark.createDataFrame([(None,), (4.0,), (1.0,), (None,), (2.0,)], "v double")
    assert exact_quantiles(df, [], "v", {"m": 0.5}).first()["m"] == 2.0


def test_a_hot_key_is_cut_into_balanced_runs(spark):
    # a third of the rows share one key and one time
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 1000).alias("k"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("t"), "id")
    sizes = [r["count"] for r in sorted_runs(df, ["k", "t", "id"], 8).rows.groupBy("_run").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 30_000 / 8
