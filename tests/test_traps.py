"""Hand-written rows for the edges where two readings of a rule differ."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from cohortlake.functions import capacity, clinical as C, generalise as G, scalars as SC, temporal as T, terms, vocabulary as V
from cohortlake.operators import curated, evaluate as E, fairness as FA, prep, thresholds as TH, verification
from cohortlake.sources import schemas


def _values(spark, rows, schema, **columns):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*[c.alias(n) for n, c in columns.items()]).collect()]


def test_day_words_and_iso_strings(spark):
    # fixed values: inputs with known weekend and night flags
    known = [("SATURDAY_NIGHT", 1, 1), ("Monday Morning", 0, 0), ("2025-11-29T17:37:28", 1, 0), ("2025-11-30T02:00:00", 1, 1)]
    got = _values(
        spark, [(k[0],) for k in known], "x string",
        w=T.weekend_from_text(F.col("x")), n=T.night_from_text(F.col("x")))
    assert got == [k[1:] for k in known]


def test_unparsable_text_takes_the_current_time(spark):
    (w, n, now_w, now_n), = _values(
        spark, [("soon",)], "x string", w=T.weekend_from_text(F.col("x")), n=T.night_from_text(F.col("x")),
        a=T.weekend_flag(F.current_timestamp()), b=T.night_flag(F.current_timestamp()))
    assert (w, n) == (now_w, now_n)


@pytest.mark.parametrize("clock, night", [("05:59", 1), ("06:00", 0), ("17:59", 0), ("18:00", 1)])
def test_night_edges(spark, clock, night):
    assert _values(spark, [(f"2024-01-03T{clock}:00",)], "x string", n=T.night_from_text(F.col("x"))) == [(night,)]


@pytest.mark.parametrize("hours, score", [(5, 3), (6, 2), (23, 2), (24, 1), (47, 1), (48, 0)])
def test_early_score_edges(spark, hours, score):
    assert _values(spark, [(hours,)], "h int", s=C.early_score(F.col("h"))) == [(score,)]


def test_whole_units_truncate(spark):
    a, b = datetime(2024, 1, 1, 10, 59), datetime(2024, 1, 1, 12, 1)
    got = _values(
        spark, [(a, b)], "a timestamp_ntz, b timestamp_ntz",
        h=T.whole_units("HOUR", F.col("a"), F.col("b")), back=T.whole_units("HOUR", F.col("b"), F.col("a")),
        d=T.whole_units("DAY", F.col("a"), F.col("b")))
    assert got == [(1, -1, 0)]


def test_risk_level_edges(spark):
    scores = [(0.3,), (0.5,), (0.7,), (None,)]
    inclusive = [r[0] for r in _values(spark, scores, "s double", r=C.risk_level(F.col("s")))]
    exclusive = [r[0] for r in _values(spark, scores, "s double", r=C.risk_level(F.col("s"), inclusive=False))]
    assert inclusive == ["MODERATE", "MODERATE", "HIGH", None]
    assert exclusive == ["LOW", "MODERATE", "MODERATE", None]


def test_age_bins_and_buckets(spark):
    ages = [(a,) for a in (39, 40, 60, 75, 89, 90)]
    labels = ["<40", "40-60", "60-75", "75+"]
    got = _values(
        spark, ages, "a int",
        right=SC.bin_column(F.col("a"), [0, 40, 60, 75, 100], labels, right=True),
        left=SC.bin_column(F.col("a"), [0, 40, 60, 75, 150], labels, right=False),
        bucket=G.age_bucket(F.col("a")), open=G.age_bucket(F.col("a"), cap=False))
    assert got == [
        ("<40", "<40", "35-40", "35-40"), ("<40", "40-60", "40-45", "40-45"), ("40-60", "60-75", "60-65", "60-65"),
        ("60-75", "75+", "75-80", "75-80"), ("75+", "75+", "85-90", "85-90"), ("75+", "75+", "90+", "90-95")]


def test_age_bounds(spark):
    got = _values(spark, [("75-80",), ("85+",), ("42",)], "x string", b=G.age_bounds(F.col("x")))
    assert [tuple(r[0]) for r in got] == [(75, 80), (85, 120), (42, 120)]


def test_emergency_literal_never_matches_stored_types(spark):
    got = _values(
        spark, [(v,) for v in V.ADMISSION_TYPES], "x string", lit=C.emergency_flag(F.col("x")),
        wide=C.emergency_flag(F.col("x"), V.EMERGENCY_ADMISSION_TYPES))
    assert sum(r[0] for r in got) == 0 and sum(r[1] for r in got) == 2


def test_first_key_wins_in_substring_match(spark):
    rows = [("an emergency observation",), ("icu",), ("Urgent ",), ("",), (None,), ("zzz",), ("obs",)]
    got = [r[0] for r in _values(spark, rows, "x string", v=terms.ADMISSION_TYPE.values(F.col("x")))]
    emergency = V.EMERGENCY_ADMISSION_TYPES
    assert got == [emergency, emergency, ["URGENT"], ["EW EMER."], ["EW EMER."], emergency, ["OBSERVATION ADMIT", "EU OBSERVATION"]]


def test_network_terms_prefer_stored_values(spark):
    rows = [("emer",), ("EW EMER.",), ("same day surgery.",), ("ambulatory",)]
    got = [r[0] for r in _values(spark, rows, "x string", v=terms.NETWORK_ADMISSION_TYPE.values(F.col("x")))]
    assert got == [["EW EMER."], ["EW EMER."], ["SURGICAL SAME DAY ADMISSION"], ["AMBULATORY OBSERVATION"]]


def test_transport_and_tier(spark):
    rows = [("hospital_b", "hospital_c"), ("hospital_a", "hospital_x"), (None, "hospital_a")]
    assert [r[0] for r in _values(spark, rows, "a string, b string", m=terms.transport_minutes(F.col("a"), F.col("b")))] == [75, 60, 60]
    tiers = [("Tertiary Care Center",), ("Rural Hospital",), ("Clinic",), (None,)]
    assert [r[0] for r in _values(spark, tiers, "x string", t=terms.tier_priority(F.col("x")))] == [0, 2, 99, 99]


def test_capability_encodings(spark):
    rows = [('{"ecmo": true}',), ('{"specialized_capabilities": {"ecmo": true}}',), ("broken",), (None,)]
    flags = SC.flag_map(F.col("x"))
    assert [r[0] for r in _values(spark, rows, "x string", e=capacity.capability(flags, "ecmo"))] == [True, True, False, False]
    lists = [("['a', 'b']",), ('["c"]',), ("nope",), (None,)]
    assert [r[0] for r in _values(spark, lists, "x string", v=SC.lenient_list(F.col("x")))] == [["a", "b"], ["c"], [], []]


def test_capacity_edges(spark):
    rows = [(0.95, 0), (0.90, 1), (0.70, 3), (0.69, 3)]
    got = [r[0] for r in _values(spark, rows, "r double, b int", s=capacity.capacity_status(F.col("r"), F.col("b")))]
    assert got == [capacity.NO_BEDS, capacity.NEAR, capacity.MODERATE, capacity.GOOD]


def test_casts_with_defaults(spark):
    rows = [("12",), ("x",), (None,), ("NaN",)]
    got = _values(spark, rows, "x string", i=SC.cast_or(F.col("x"), "int", 0), d=SC.cast_or(F.col("x"), "double", -1.0))
    assert got == [(12, 12.0), (0, -1.0), (0, -1.0), (0, -1.0)]


# ---- curated layer -----------------------------------------------------------------


def _clinic(spark):
    at = datetime
    patients = spark.createDataFrame(
        [(1, "F", 40, 2000, "g", None), (2, "M", 70, 2000, "g", date(2002, 1, 1)), (3, "M", 90, 2000, "g", None)], schemas.PATIENTS)
    base = dict(
        deathtime=None, edregtime=None, edouttime=None, admission_location="EMERGENCY ROOM", discharge_location=None,
        insurance="Other", language="ENGLISH", ethnicity="X")
    def admission(hadm, subject, start, end, kind="URGENT", status=None, died=0):
        row = dict(base, hadm_id=hadm, subject_id=subject, admittime=start, dischtime=end, admission_type=kind,
                   marital_status=status, hospital_expire_flag=died)
        return tuple(row[f.name] for f in schemas.ADMISSIONS.fields)

    admissions = spark.createDataFrame([
        admission(10, 1, at(2001, 3, 3, 5, 59), at(2001, 3, 5, 5, 58), status="SINGLE"),
        admission(11, 1, at(2001, 3, 3, 5, 59), at(2001, 3, 4, 6, 0), status="MARRIED"),  # same time as 10
        admission(20, 2, at(2002, 1, 1, 18, 0), at(2002, 1, 9, 18, 0), died=1),
    ], schemas.ADMISSIONS)
    micu, ccu, tsicu = V.ICU_CAREUNITS[2], V.ICU_CAREUNITS[1], V.ICU_CAREUNITS[0]
    transfers = spark.createDataFrame([
        (100, 1, 10, "admit", micu, at(2001, 3, 3, 11, 58), at(2001, 3, 4, 0, 0)),
        (101, 1, 10, "transfer", micu, at(2001, 3, 4, 0, 0), None),
        (102, 1, 10, "transfer", None, at(2001, 3, 4, 2, 0), None),
        (103, 1, 10, "transfer", "Medicine", at(2001, 3, 4, 3, 0), None),
        (200, 2, 20, "admit", ccu, at(2002, 1, 2, 0, 0), at(2002, 1, 2, 12, 0)),
        (201, 2, 20, "transfer", tsicu, at(2002, 1, 2, 12, 0), at(2002, 1, 3, 0, 0)),
        (202, 2, 20, "transfer", micu, at(2002, 1, 3, 0, 0), at(2002, 1, 4, 0, 0)),
        (300, 1, 11, "admit", "Burn ICU", at(2001, 3, 3, 6, 0), at(2001, 3, 3, 7, 0)),  # fallback only
        (400, 2, None, "ED", micu, at(2002, 5, 1), at(2002, 5, 2)),  # no admission
    ], schemas.TRANSFERS)
    return patients, admissions, transfers


def test_tie_on_first_admission_is_stable(spark):
    patients, admissions, _ = _clinic(spark)
    rows = {r["subject_id"]: r for r in curated.dim_patient(patients, admissions).collect()}
    assert rows[1]["marital_status"] == "SINGLE" and rows[3]["ethnicity"] is None
    assert [rows[i]["is_deceased"] for i in (1, 2, 3)] == [0, 1, 0]


def test_icu_stays(spark):
    _, _, transfers = _clinic(spark)
    stays = {(r["subject_id"], r["hadm_id"]): r for r in curated.fact_icu_stay(transfers).collect()}
    assert set(stays) == {(1, 10), (1, 11), (2, 20), (2, None)}
    assert stays[1, 10]["icu_type"] == "Medical ICU" and stays[1, 10]["is_mixed_icu"] == 0
    assert stays[1, 10]["los_icu_hours"] == 12  # the open movement has no end
    assert stays[2, 20]["icu_type"] == "Mixed ICU (3+ Units)" and stays[2, 20]["first_careunit"] == V.ICU_CAREUNITS[1]
    assert stays[1, 11]["icu_type"] == "Other ICU"
    assert [stays[k]["stay_id"] for k in ((1, 10), (1, 11), (2, None), (2, 20))] == [1, 2, 3, 4]


def test_two_icu_predicates_differ_on_the_fallback(spark):
    got = _values(spark, [("Burn ICU",), (None,), ("icu ward",)], "u string", p=C.is_icu_unit(F.col("u")),
                  c=C.care_type(F.col("u")), k=C.mentions_icu(F.col("u")))
    assert got == [(1, "Ward", True), (0, "Unknown", False), (0, "Ward", True)]


def test_clinical_features(spark):
    patients, admissions, transfers = _clinic(spark)
    fact = curated.fact_hospital_admission(admissions, patients)
    dim = curated.dim_patient(patients, admissions)
    rows = {r["hadm_id"]: r for r in curated.site_stays(curated.fact_icu_stay(transfers, False), fact, dim, transfers).collect()}
    assert set(rows) == {10, 11, 20}  # the stay without admission is dropped by the join
    assert (rows[10]["n_icu_transfers"], rows[10]["n_total_transfers"]) == (2, 4)
    assert (rows[11]["n_icu_transfers"], rows[11]["n_total_transfers"]) == (0, 1)  # list-only count
    assert rows[10]["hours_admit_to_icu"] == 5 and rows[10]["early_icu_score"] == 3
    assert rows[20]["early_icu_score"] == 2 and rows[20]["night_admission"] == 1
    assert rows[10]["night_admission"] == 1 and rows[10]["weekend_admission"] == 1
    assert rows[20]["icu_mortality_label"] == 1 and rows[20]["los_hospital_days"] == 8
    assert rows[10]["los_hospital_days"] == 1 and rows[10]["los_hospital_hours"] == 47


def test_assignment_shares(spark):
    df = curated.assign_site_and_split(spark.range(200_000).withColumnRenamed("id", "subject_id"))
    site = {r[0]: r[1] / 200_000 for r in df.groupBy("assigned_hospital").count().collect()}
    split = {r[0]: r[1] / 200_000 for r in df.groupBy("data_split").count().collect()}
    assert site == pytest.approx({"hospital_a": 0.40, "hospital_b": 0.35, "hospital_c": 0.25}, abs=0.01)
    assert split == pytest.approx({"train": 0.70, "validation": 0.15, "test": 0.15}, abs=0.01)


def test_leakage_is_found_and_raised(spark):
    rows = [("hospital_a", 1, "train"), ("hospital_a", 1, "test"), ("hospital_a", 2, "train"), ("hospital_b", 1, "validation")]
    df = spark.createDataFrame(rows, "assigned_hospital string, subject_id int, data_split string")
    found = {r["hospital"]: r for r in verification.split_overlap(df).collect()}
    assert found["hospital_a"]["train_test_overlap"] == 1 and found["hospital_a"]["train_patients"] == 2
    assert found["hospital_b"]["train_test_overlap"] == 0
    with pytest.raises(ValueError):
        verification.require_integrity(verification.split_overlap(df))
    pairs = {(r["site_1"], r["site_2"]): r["overlap"] for r in verification.site_overlap(df).collect()}
    assert pairs["hospital_a", "hospital_b"] == 1 and pairs["hospital_b", "hospital_c"] == 0


# ---- evaluation ----------------------------------------------------------------------

# fixed values: recorded confusion counts with the metrics published for them
RECORDED = [
    ("Youden Index", 1266, 9994, 1190, 224, 0.8496644295302014, 0.5154723127035831, 0.8935979971387696, 0.6416624429802331, 0.9780779017420239, 0.8884330124664668),
    ("F1 Maximum", 1159, 10406, 778, 331, 0.7778523489932886, 0.5983479607640682, 0.9304363376251789, 0.6763933469506858, 0.9691720219800689, 0.9124980274577876),
    ("Cost-Sensitive (10:1)", 1309, 9630, 1554, 181, 0.8785234899328859, 0.4572127139364303, 0.8610515021459227, 0.6014243050769584, 0.9815513199469983, 0.8631055704592079),
    ("Current (0.5)", 1251, 10076, 1108, 239, 0.8395973154362416, 0.5303094531581178, 0.9009298998569385, 0.6500389711613406, 0.9768298594280175, 0.8937194255957077),
]


def test_recorded_metrics(spark):
    df = spark.createDataFrame([r[:5] for r in RECORDED], "method string, tp bigint, tn bigint, fp bigint, fn bigint")
    got = {r["method"]: r for r in E.with_metrics(df).collect()}
    for method, *_, recall, precision, specificity, f1, npv, accuracy in RECORDED:
        row = got[method]
        assert [row[c] for c in ("recall", "precision", "specificity", "f1_score", "npv", "accuracy")] == pytest.approx(
            [recall, precision, specificity, f1, npv, accuracy], abs=1e-12)


def test_recorded_cost_threshold_lies_on_the_grid(spark):
    (value,), = _values(spark, [(30,)], "i int", t=TH.grid_value(F.col("i"), *TH.COST_GRID))
    assert value == pytest.approx(0.3424242424242424, abs=1e-15)


def _scored(spark, rows):
    return spark.createDataFrame(rows, "y_true int, score double")


def test_auc_with_ties_and_reversal(spark):
    rows = [(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1), (0, 0.5), (1, 0.1)]
    df = _scored(spark, rows)
    def auc(frame):
        return E.ranking_metrics(E.curve(frame)).first()["roc_auc"]

    pairs = [(1.0 if a > b else 0.5 if a == b else 0.0) for y, a in rows if y for z, b in rows if not z]
    assert auc(df) == pytest.approx(sum(pairs) / len(pairs))
    assert auc(df.withColumn("score", 1 - F.col("score"))) == pytest.approx(1 - sum(pairs) / len(pairs))


def test_undefined_metrics_are_zero_or_null(spark):
    df = _scored(spark, [(0, 0.2), (0, 0.8)])
    row = E.classification_metrics(df).first()
    assert row["recall"] == 0.0 and row["f1_score"] == 0.0
    ranked = E.ranking_metrics(E.curve(df)).first()
    assert ranked["roc_auc"] is None and ranked["average_precision"] is None


def test_sweep_matches_direct_counts(spark, tables):
    df = tables.predictions
    found = {round(r["threshold"], 9): r for r in TH.sweep(df).collect()}
    assert len(found) == 100
    for threshold in (0.05, 0.95):
        direct = E.classification_metrics(df, threshold=threshold).first()
        assert found[threshold]["tp"] == direct["tp"] and found[threshold]["fp"] == direct["fp"]


def test_sweep_is_exact_on_grid_scores(spark):
    low, high, count = 0.05, 0.95, 100
    step = (high - low) / (count - 1)
    df = spark.createDataFrame([(i % 2, low + float(i) * step) for i in range(count)], "y_true int, score double")
    for r in TH.sweep(df, (low, high, count)).collect():
        i = round((r["threshold"] - low) / step)
        assert r["tp"] + r["fp"] == count - i


def test_threshold_methods(spark):
    df = _scored(spark, [(1, 0.95), (1, 0.8), (0, 0.8), (1, 0.6), (0, 0.4), (0, 0.2)])
    points = E.curve(df)
    assert TH.best_youden(points).first()["threshold"] == 0.6
    assert TH.nearest_recall(points, 0.66).first()["threshold"] == 0.8


def test_slices_without_positives(spark):
    df = spark.createDataFrame(
        [("F", 1, 0.9), ("F", 0, 0.1), ("M", 0, 0.9), ("M", 0, 0.2)], "gender string, y_true int, score double")
    slices = FA.slice_metrics(FA.cells(df, ["gender"]), ["gender"])
    parity = FA.parity(slices).first()
    assert parity["demographic_parity_difference"] == 0.0 and parity["equalized_odds_difference"] == 1.0
    found = FA.violations(FA.parity(slices)).collect()
    assert [(r["metric"], r["severity"]) for r in found] == [("equalized_odds_difference", "high")]


# ---- preparation ------------------------------------------------------------------------


def test_scaling_and_encoding(spark):
    train = spark.createDataFrame([("1", "b", 5.0), ("3", None, 5.0), (None, "a", 5.0), ("x", "b", 5.0)], "n string, c string, k double")
    params = prep.fit_numeric(train, ["n", "k"])
    by_name = {r["column"]: r for r in params.collect()}
    assert by_name["n"]["median"] == 2.0 and by_name["n"]["mean"] == 2.0
    assert by_name["n"]["std"] == pytest.approx(0.5 ** 0.5)
    rows = spark.createDataFrame([("4", "zzz", 6.0), (None, "a", 5.0)], "n string, c string, k double")
    scaled = prep.scale(rows, params, ["n", "k"]).orderBy("c").collect()
    assert [r["k"] for r in scaled] == [0.0, 1.0]  # constant column divides by one
    assert scaled[0]["n"] == 0.0 and scaled[1]["n"] == pytest.approx(2 / 0.5 ** 0.5)
    codes = prep.fit_categories(train, ["c"])
    assert {r["value"]: r["code"] for r in codes.collect()} == {"Unknown": 0, "a": 1, "b": 2}
    coded = {r["n"]: r["c"] for r in prep.encode(rows, codes, ["c"]).collect()}
    assert coded == {"4": -1, None: 1}


def test_missing_columns_fail_loudly(spark):
    df = spark.createDataFrame([("a",)], "ethnicity string")
    with pytest.raises(ValueError):
        prep.fit_categories(df, ["ethnicity", "race"])
    assert prep.fit_categories(df, ["ethnicity", "race"], allow_missing=True).count() == 1


def test_stratified_shares_are_exact(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    counts = {(r["y"], r["split"]): r["count"] for r in prep.stratified_split(df, "y", "id").groupBy("y", "split").count().collect()}
    assert counts == {(0, "train"): 540, (0, "validation"): 180, (0, "test"): 180, (1, "train"): 60, (1, "validation"): 20, (1, "test"): 20}


def test_given_flags_are_kept(spark):
    df = spark.createDataFrame([(1, "EMERGENCY ROOM", 9, 50.0)], "night_admission int, admission_location string, early_icu_score int, hours_admit_to_icu double")
    row = prep.complete_features(df).first()
    assert (row["night_admission"], row["ed_admission_flag"], row["early_icu_score"]) == (1, 1, 0)
    assert row["race"] == "UNKNOWN" and row["los_hospital_days"] == pytest.approx(50 / 24)


def test_missing_values_stay_apart(spark):
    from cohortlake.functions import clinical as C
    from cohortlake.operators import evaluate as E, explore as X, monitor as M, thresholds as H

    scores = spark.createDataFrame([(None,), (-1,), (2,), (9,)], "s int")
    assert [r[0] for r in scores.select(C.valid_early_score(F.col("s"))).collect()] == [2, 0, 2, 3]
    listed = spark.createDataFrame([("k", "a"), ("k", "x"), ("k", None), ("k", "a")], "k string, v string")
    assert X.crosstab_share(listed, "k", "v", ["a", "b"]).first().asDict() == {"k": "k", "a": 50.0, "b": 0.0}
    rows = spark.createDataFrame([(1, 0.9), (0, 0.2), (1, None)], "y_true int, score double")
    assert {r["tp"] + r["fp"] + r["fn"] + r["tn"] for r in H.sweep(rows).collect()} == {2}
    assert sum(r["n"] for r in E.calibration(rows).collect()) == 2
    assert sum(r["n"] for r in E.accuracy_by_class(rows).collect()) == 2
    assert M.distribution_shift(rows, rows.filter("score is not null")).first()["kl"] == 0
