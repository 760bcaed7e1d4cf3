"""Privacy rules: gates, noise, identifiers."""

import math

import pytest
from pyspark.sql import functions as F

from cohortlake.functions import generalise as G
from cohortlake.operators import cohorts, privacy as PR


def _answers(spark, rows):
    return spark.createDataFrame(rows, "site string, case_count bigint, deaths bigint, avg_icu_los double, avg_hospital_los double")


def test_small_cohorts_release_nothing(spark):
    df = _answers(spark, [("a", 4, 4, 1.0, 1.0), ("b", 5, 5, 1.0, 2.0), ("c", 6, 0, 1.0, 2.0)])
    rows = {r["site"]: r for r in PR.noisy_counts(df, ["site"]).collect()}
    assert not rows["a"]["k_anonymity_met"] and rows["a"]["cases_found"] == 0
    assert all(rows["a"][c] is None for c in ("survival_rate", "mortality_rate", "avg_icu_los_hours"))
    assert "case_count" not in rows["a"].asDict()
    for site in ("b", "c"):
        assert rows[site]["cases_found"] >= 5 and 0 <= rows[site]["mortality_rate"] <= 1


def test_exact_counts_without_noise(spark):
    row = PR.noisy_counts(_answers(spark, [("b", 8, 2, 10.04, 2.0)]), ["site"], epsilon=None).first()
    assert (row["cases_found"], row["survival_rate"], row["mortality_rate"], row["avg_icu_los_hours"]) == (8, 0.75, 0.25, 10.0)


def test_large_epsilon_tends_to_exact(spark):
    df = _answers(spark, [(f"s{i}", 100 + i, 10, 1.0, 1.0) for i in range(50)])
    got = {r["site"]: r["cases_found"] for r in PR.noisy_counts(df, ["site"], epsilon=1e6).collect()}
    assert got == {f"s{i}": 100 + i for i in range(50)}


def test_seeded_noise_repeats(spark):
    df = _answers(spark, [(f"s{i}", 1000, 10, 1.0, 1.0) for i in range(50)])
    def found(seed):
        return [r["cases_found"] for r in PR.noisy_counts(df, ["site"], seed=seed).orderBy("site").collect()]

    assert found("x") == found("x") != found("y")
    assert len(set(found("x"))) > 10


def test_laplace_distribution(spark):
    row = spark.range(200_000).select(G.laplace(F.rand(7), 10.0).alias("x")).agg(
        F.avg("x").alias("mean"), F.avg(F.abs("x")).alias("scale"), F.max(F.abs("x")).alias("top")).first()
    assert abs(row["mean"]) < 0.2 and row["scale"] == pytest.approx(10.0, rel=0.02)
    assert math.isfinite(row["top"])


def test_k_groups_hide_small_sizes(spark):
    df = spark.createDataFrame([("a",)] * 5 + [("b",)] * 4, "g string")
    found = {(r["g"], r["n"], r["suppressed_groups"]) for r in PR.k_anonymous(df, ["g"]).collect()}
    # the values of a small group are not released
    assert found == {("a", 5, None), (None, None, 1)}


def test_identifiers_are_dropped_whatever_their_case(spark):
    df = spark.createDataFrame([(1, "x", 2)], "Subject_ID int, NAME string, kept int")
    out = PR.drop_identifiers(df)
    assert out.columns == ["kept", "removed_fields"] and out.first()["removed_fields"] == ["Subject_ID", "NAME"]


def test_compliance(spark):
    bad = spark.createDataFrame([(95, "x", "y", "z", 1)], "age_at_admission int, ethnicity string, insurance string, marital_status string, hadm_id int")
    row = PR.compliance(bad).first()
    assert not row["is_compliant"] and len(row["violations"]) == 2 and len(row["warnings"]) == 1
    good = spark.createDataFrame([(89, "y")], "age_at_admission int, insurance string")
    assert PR.compliance(good).first()["is_compliant"]


def test_pattern_scan_reads_whole_texts(spark):
    df = spark.createDataFrame([("x" * 200_000 + " Medical Record 7",), ("clean",)], "text string")
    hits = [r["found_patterns"] for r in PR.pattern_hits(df, F.col("text")).collect()]
    assert hits == [["medical record"], []]
    with pytest.raises(ValueError):
        PR.require_clean(PR.pattern_hits(df, F.col("text")))


def test_fingerprint_depends_only_on_shared_fields(spark):
    schema = "age_bucket string, risk_score_range string, admission_type string, early_icu_score int, icu_type string, other int"
    df = spark.createDataFrame([("60-65", "0.1-0.2", "URGENT", 2, None, 1), ("60-65", "0.1-0.2", "URGENT", 2, None, 2), ("60-65", "0.1-0.2", "URGENT", 3, None, 1)], schema)
    prints = [r["fingerprint"] for r in PR.with_fingerprint(df).collect()]
    assert prints[0] == prints[1] != prints[2] and len(prints[0]) == 64


def test_network_query_against_brute_force(spark, tables):
    stays = tables.site_stays
    requests = spark.createDataFrame(
        [(1, "hospital_a", "60-80", "emergency", 3, None), (2, "hospital_b", "75+", "URGENT", 3, "mixed"),
         (3, "hospital_b", "75+", "URGENT", 3, "mixed"), (4, "hospital_c", "10-12", "elective", 0, "cardiac")],
        "request_id int, requesting_hospital string, age_bucket string, admission_text string, early_icu_score int, icu_text string")
    got = {(r["requesting_hospital"], r["hospital"]): (r["case_count"], r["deaths"])
           for r in cohorts.network_cohorts(requests, stays).collect()}
    rows = [r.asDict() for r in stays.collect()]
    cases = {
        "hospital_a": (60, 80, ["EW EMER.", "DIRECT EMER."], 3, None),
        "hospital_b": (75, 120, ["URGENT"], 3, ["Mixed ICU (2 Units)", "Mixed ICU (3+ Units)"]),
        "hospital_c": (10, 12, ["ELECTIVE"], 0, ["Cardiac ICU"]),
    }
    assert len(got) == 6
    for (asker, peer), answer in got.items():
        low, high, types, score, icu = cases[asker]
        hit = [r for r in rows if r["assigned_hospital"] == peer and low <= r["age_at_admission"] <= high
               and r["admission_type"] in types and r["early_icu_score"] == score and (icu is None or r["icu_type"] in icu)]
        assert answer == (len(hit), sum(r["icu_mortality_label"] for r in hit))
