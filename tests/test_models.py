"""Models against direct computation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlake.operators import models as MD, monitor as M


def test_weighted_average(spark):
    df = spark.createDataFrame(
        [(0, 10, [1.0, 2.0, 3.0]), (0, 30, [5.0, 6.0, 7.0]), (1, 1, [9.0, 9.0, 9.0])], "round int, n_examples int, weights array<double>")
    got = {r["round"]: (list(r["weights"]), r["n_examples"]) for r in MD.average_weights(df).collect()}
    assert got == {0: ([4.0, 5.0, 6.0], 40), 1: ([9.0, 9.0, 9.0], 1)}


def test_federated_training_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 2))
    y = (x @ [1.5, -1.0] + rng.normal(scale=0.5, size=600) > 0.4).astype(int)
    site = np.where(np.arange(600) < 350, "a", np.where(np.arange(600) < 500, "b", "c"))
    df = spark.createDataFrame([(s, int(t), float(a), float(b)) for s, t, (a, b) in zip(site, y, x)], "site string, y int, a double, b double")
    got = MD.train_federated(df, ["a", "b"], "y", rounds=3, local_epochs=2, rate=0.5).orderBy("round").collect()
    shared, full = np.zeros(3), np.column_stack([x, np.ones(600)])
    for number in range(3):
        parts = []
        for s in ("a", "b", "c"):
            xs, ys = full[site == s], y[site == s]
            importance = np.where(ys == 1, len(ys) / (2 * ys.sum()), len(ys) / (2 * (len(ys) - ys.sum())))
            w = shared.copy()
            for _ in range(2):
                p = 1 / (1 + np.exp(-xs @ w))
                w -= 0.5 * (importance * (p - ys)) @ xs / len(ys)
            parts.append((len(ys), w))
        shared = sum(n * w for n, w in parts) / 600
        np.testing.assert_allclose(got[number]["weights"], shared, rtol=1e-9)
    assert got[2]["loss"] < got[0]["loss"]


def test_oversampling_balances_inside_the_minority_range(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(i % 9 == 0), float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(900, 2)))]
    out = MD.oversample(spark.createDataFrame(rows, "id int, y int, a double, b double"), ["a", "b"], "y", "id").collect()
    assert sum(r["y"] == 1 for r in out) == sum(r["y"] == 0 for r in out) == 800
    assert sum(not r["is_synthetic"] for r in out) == 900 and len({r["id"] for r in out}) == 1600
    minority = np.array([(r["a"], r["b"]) for r in out if r["y"] == 1 and not r["is_synthetic"]])
    made = np.array([(r["a"], r["b"]) for r in out if r["is_synthetic"]])
    assert (made >= minority.min(0) - 1e-9).all() and (made <= minority.max(0) + 1e-9).all()
    # every made row lies on a segment between two minority rows
    for point in made[:40]:
        d = minority - point
        cross = np.abs(d[:, None, 0] * d[None, :, 1] - d[:, None, 1] * d[None, :, 0])
        inside = (d[:, None, :] * d[None, :, :]).sum(-1) <= 1e-9
        assert (cross[inside] < 1e-9).any()


def test_oversampling_of_balanced_or_single_class(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (2, 1, 2.0)], "id int, y int, a double")
    assert MD.oversample(df, ["a"], "y", "id").count() == 2
    assert MD.oversample(df.filter("y = 0"), ["a"], "y", "id").count() == 1


def test_forest_ranks_the_informative_feature_first(spark):
    rng = np.random.default_rng(1)
    rows = [(int(a > 0), float(a), float(b)) for a, b in rng.normal(size=(500, 2))]
    df = spark.createDataFrame(rows, "y int, useful double, noise double")
    top = MD.forest_importances(df, ["useful", "noise"], "y", trees=10, depth=3).first()
    assert top["feature"] == "useful" and top["importance"] > 0.8


def test_sensitivity_modes(spark):
    df = spark.createDataFrame([("x", "k", 0.5), ("x", "k", 0.9), ("y", "k", 0.6), (None, "k", 0.1)], "p string, q string, m double")
    means = MD.sensitivity(df, ["p", "q"], "m").collect()
    assert [r["param"] for r in means] == ["p"] and means[0]["effect_range"] == pytest.approx(0.1)
    assert MD.sensitivity(df, ["p"], "m", mode="extremes").first()["effect_range"] == pytest.approx(0.4)


def test_rolling_accuracy_skips_missing_days(spark):
    df = spark.createDataFrame(
        [("2024-01-01", 10, 5, 0), ("2024-01-03", 10, 9, 0), ("2024-01-12", 10, 1, 0)], "day string, samples_tested int, tp int, tn int"
    ).withColumn("day", F.to_date("day"))
    got = [(r["rolling_accuracy"], r["alert"]) for r in M.rolling_accuracy(df).orderBy("day").collect()]
    assert got == [(0.5, True), (0.7, True), (0.1, True)]


def test_degradation_states(spark):
    def status(accuracies, recall=0.9):
        rows = [(f"2024-01-{i + 1:02d}", 10, a, recall) for i, a in enumerate(accuracies)]
        return M.degradation(spark.createDataFrame(rows, "day string, samples_tested int, accuracy double, recall double")).first()["status"]

    assert status([0.9, 0.9]) == "OK"
    assert status([0.99, 0.9]) == "DEGRADATION DETECTED"
    assert status([0.9, 0.8]) == "RETRAINING NEEDED" and status([0.9, 0.9], 0.6) == "RETRAINING NEEDED"
