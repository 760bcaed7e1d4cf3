"""Feature preparation, model and experiment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlake.operators import curated, models as MD, neighbours as N, prep
from cohortlake.plans.checks import check
from cohortlake.plans.registry import query
from cohortlake.session import run_path
from cohortlake.sources import tables as S


@query("m01_site_split_assignment", check("""
    SELECT subject_id, anchor_age, anchor_year, anchor_year_group, gender, dod, CAST(dod IS NOT NULL AS INT) AS is_deceased,
      CASE WHEN h < 40 THEN 'hospital_a' WHEN h < 75 THEN 'hospital_b' ELSE 'hospital_c' END AS assigned_hospital,
      CASE WHEN s < 70 THEN 'train' WHEN s < 85 THEN 'validation' ELSE 'test' END AS data_split
    FROM (SELECT *, CAST('0x' || substr(md5(CAST(subject_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 AS h,
      CAST('0x' || substr(md5('split_' || subject_id), 1, 8) AS BIGINT) % 100 AS s FROM patients)"""))
def _(t):
    return curated.patient_split_assignment(t.patients)


@query("m02_stratified_split", check("""
    WITH r AS (SELECT row_id, y_true, row_number() OVER (PARTITION BY y_true ORDER BY u, row_id) AS rn,
      count(*) OVER (PARTITION BY y_true) AS n FROM (SELECT *,
        CAST(CAST('0x' || substr(md5('42' || row_id), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0::DOUBLE AS u FROM predictions))
    SELECT row_id, y_true, CASE WHEN (rn - 1) / CAST(n AS DOUBLE) < 0.6::DOUBLE THEN 'train'
      WHEN (rn - 1) / CAST(n AS DOUBLE) < 0.6::DOUBLE + 0.2::DOUBLE THEN 'validation' ELSE 'test' END AS split FROM r"""))
def _(t):
    return prep.stratified_split(t.predictions.select("row_id", "y_true"), "y_true", "row_id")


_DIRTY = """dirty AS (SELECT row_id, site, data_split, CASE WHEN row_id % 10 = 0 THEN NULL WHEN row_id % 10 = 1 THEN 'n/a'
    ELSE CAST(age AS VARCHAR) END AS age, CASE WHEN row_id % 7 <> 0 THEN CAST(score AS VARCHAR) END AS score,
    '1' AS flat, insurance, race FROM predictions),
  num AS (SELECT row_id, site, data_split, TRY_CAST(age AS DOUBLE) AS age, TRY_CAST(score AS DOUBLE) AS score,
    TRY_CAST(flat AS DOUBLE) AS flat FROM dirty)"""


def _dirty(t):
    key = F.col("row_id")
    return t.predictions.select(
        "row_id", "site", "data_split",
        F.when(key % 10 == 0, None).when(key % 10 == 1, "n/a").otherwise(F.col("age").cast("string")).alias("age"),
        F.when(key % 7 != 0, F.col("score").cast("string")).alias("score"), F.lit("1").alias("flat"),
        "insurance", "race")


_NUMERIC = ["age", "score", "flat"]


@query("m03_numeric_coercion", check(f"WITH {_DIRTY} SELECT row_id, age, score, flat FROM num"))
def _(t):
    return prep.coerce_numeric(_dirty(t), _NUMERIC).select("row_id", *_NUMERIC)


_FIT = f"""{_DIRTY}, med AS (SELECT median(age) AS age, median(score) AS score, median(flat) AS flat FROM num WHERE data_split = 'train'),
  filled AS (SELECT row_id, site, data_split, coalesce(n.age, m.age) AS age, coalesce(n.score, m.score) AS score, coalesce(n.flat, m.flat) AS flat
    FROM num n CROSS JOIN med m),
  par AS (SELECT avg(age) AS age_m, stddev_pop(age) AS age_s, avg(score) AS score_m, stddev_pop(score) AS score_s,
    avg(flat) AS flat_m, stddev_pop(flat) AS flat_s FROM filled WHERE data_split = 'train')"""


@query("m04_median_imputation", check(f"""
    WITH {_FIT} SELECT row_id, round(age, 6) AS age, round(score, 6) AS score FROM filled"""))
def _(t):
    dirty = _dirty(t)
    params = prep.fit_numeric(S.scan_split(dirty, "train"), ["age", "score"])
    medians = {c: params.filter(F.col("column") == c).select("median").scalar() for c in ("age", "score")}
    return prep.coerce_numeric(dirty, ["age", "score"]).select(
        "row_id", *[F.round(F.coalesce(F.col(c), medians[c]), 6).alias(c) for c in ("age", "score")])


@query("m04b_own_median_imputation", check(f"""
    WITH {_DIRTY} SELECT row_id, round(coalesce(age, (SELECT median(age) FROM num)), 6) AS age FROM num"""))
def _(t):
    return prep.impute_own_median(_dirty(t), ["age"]).select("row_id", F.round("age", 6).alias("age"))


@query("m05_standardisation", check(f"""
    WITH {_FIT} SELECT row_id, round((age - age_m) / age_s, 6) AS age, round((score - score_m) / score_s, 6) AS score,
      (flat - flat_m) / 1 AS flat FROM filled CROSS JOIN par"""))
def _(t):
    dirty = _dirty(t)
    params = prep.fit_numeric(S.scan_split(dirty, "train"), _NUMERIC)
    return prep.scale(dirty, params, _NUMERIC).select(
        "row_id", F.round("age", 6).alias("age"), F.round("score", 6).alias("score"), "flat")


_CODES = """fitted AS (SELECT coalesce(race, 'Unknown') AS race FROM predictions WHERE data_split = 'train' AND coalesce(race, 'x') <> 'OTHER'),
  dict AS (SELECT race, CAST(dense_rank() OVER (ORDER BY race) - 1 AS INT) AS code FROM (SELECT DISTINCT race FROM fitted))"""


@query("m06_label_encoding", check(f"""
    WITH {_CODES} SELECT row_id, coalesce(code, -1) AS race FROM predictions p LEFT JOIN dict d ON coalesce(p.race, 'Unknown') = d.race"""))
def _(t):
    train = S.scan_split(t.predictions, "train").filter(F.coalesce("race", F.lit("x")) != "OTHER")
    dictionary = prep.fit_categories(train, ["race"])
    return prep.encode(t.predictions.select("row_id", "race"), dictionary, ["race"])


@query("m07_fit_transform_per_site", check(f"""
    WITH {_DIRTY}, med AS (SELECT site, median(age) AS age FROM num WHERE data_split = 'train' GROUP BY site),
    filled AS (SELECT row_id, n.site, data_split, coalesce(n.age, m.age) AS age FROM num n JOIN med m ON n.site = m.site),
    par AS (SELECT site, avg(age) AS m, stddev_pop(age) AS s FROM filled WHERE data_split = 'train' GROUP BY site),
    dict AS (SELECT site, insurance, CAST(dense_rank() OVER (PARTITION BY site ORDER BY insurance) - 1 AS INT) AS code
      FROM (SELECT DISTINCT site, insurance FROM dirty WHERE data_split = 'train'))
    SELECT f.row_id, f.site, round((f.age - m) / s, 6) AS age, coalesce(code, -1) AS insurance
    FROM filled f JOIN par p ON f.site = p.site JOIN dirty d ON f.row_id = d.row_id
      LEFT JOIN dict ON d.site = dict.site AND d.insurance = dict.insurance"""))
def _(t):
    dirty = _dirty(t)
    train, path = S.scan_split(dirty, "train"), run_path(t.spark, "preprocessor")
    S.write_table(prep.fit_numeric(train, ["age"], ["site"]), f"{path}/numeric")
    S.write_table(prep.fit_categories(train, ["insurance"], ["site"]), f"{path}/categories")
    scaled = prep.scale(dirty, S.read_table(t.spark, f"{path}/numeric"), ["age"], ["site"])
    coded = prep.encode(scaled, S.read_table(t.spark, f"{path}/categories"), ["insurance"], ["site"])
    return coded.select("row_id", "site", F.round("age", 6).alias("age"), "insurance")


@query("m08_request_vectors", check(f"""
    WITH {_FIT}, {_CODES} SELECT n.row_id, round((coalesce(n.age, 0) - age_m) / age_s, 6) AS age, coalesce(code, -1) AS race
    FROM num n CROSS JOIN par JOIN dirty d ON n.row_id = d.row_id LEFT JOIN dict ON d.race = dict.race"""))
def _(t):
    dirty = _dirty(t)
    train = S.scan_split(dirty, "train")
    params = prep.fit_numeric(train, ["age"])
    dictionary = prep.fit_categories(train.filter(F.coalesce("race", F.lit("x")) != "OTHER"), ["race"])
    scaled = prep.scale(dirty, params, ["age"], fill=0)
    return prep.encode(scaled, dictionary, ["race"], missing="unseen").select(
        "row_id", F.round("age", 6).alias("age"), "race")


_WEIGHTS = {"age": 0.03, "risk": 2.5}


@query("m09_batch_scoring", check("""
    WITH z AS (SELECT row_id, 1.0::DOUBLE / (1.0::DOUBLE + exp(-(-3.0::DOUBLE + age * 0.03::DOUBLE + score * 2.5::DOUBLE))) AS p FROM predictions)
    SELECT row_id, round(p, 9) AS score, CAST(p >= 0.5 AS INT) AS predicted,
      CASE WHEN p >= 0.7 THEN 'HIGH' WHEN p >= 0.3 THEN 'MODERATE' ELSE 'LOW' END AS risk_level FROM z"""))
def _(t):
    from cohortlake.functions.clinical import risk_level

    rows = t.predictions.select("row_id", "age", F.col("score").alias("risk"))
    scored = MD.score_rows(rows, _WEIGHTS, -3.0)
    return scored.select(
        "row_id", F.round("score", 9).alias("score"), "predicted", risk_level(F.col("score")).alias("risk_level"))


@query("a60_linear_attribution", check("""
    WITH m AS (SELECT avg(CAST(age AS DOUBLE)) AS a, avg(score) AS s FROM predictions)
    SELECT 'age' AS feature, round(avg(abs(0.03::DOUBLE * (age - a))), 9) AS mean_abs_attribution FROM predictions, m
    UNION ALL SELECT 'risk', round(avg(abs(2.5::DOUBLE * (score - s))), 9) FROM predictions, m"""))
def _(t):
    rows = t.predictions.select("age", F.col("score").alias("risk"))
    return MD.linear_attribution(rows, _WEIGHTS).withColumn(
        "mean_abs_attribution", F.round("mean_abs_attribution", 9))


_PARAMS = ["learning_rate", "local_epochs", "optimizer", "batch_size"]
_RUN_GROUPS = """g AS (SELECT param, value, avg(val_auc) AS mean, min(val_auc) AS lo, max(val_auc) AS hi FROM
    (SELECT val_auc, learning_rate, local_epochs, optimizer, batch_size FROM runs)
    UNPIVOT (value FOR param IN (learning_rate, local_epochs, optimizer, batch_size)) GROUP BY 1, 2)"""


@query("a58_sensitivity_means", check(f"""
    WITH {_RUN_GROUPS} SELECT param, round(min(mean), 9) AS min_metric, round(max(mean), 9) AS max_metric,
      round(max(mean) - min(mean), 9) AS effect_range, count(*) AS n_values FROM g GROUP BY param HAVING count(*) >= 2"""))
def _(t):
    found = MD.sensitivity(t.runs, _PARAMS, "val_auc")
    return found.select("param", *[F.round(c, 9).alias(c) for c in ("min_metric", "max_metric", "effect_range")], "n_values")


@query("a59_sensitivity_extremes", check(f"""
    WITH {_RUN_GROUPS} SELECT param, min(lo) AS min_metric, max(hi) AS max_metric, max(hi) - min(lo) AS effect_range,
      count(*) AS n_values FROM g GROUP BY param HAVING count(*) >= 2"""))
def _(t):
    return MD.sensitivity(t.runs, _PARAMS, "val_auc", mode="extremes")


@query("a61_weight_average", check("""
    WITH e AS (SELECT round, n_examples, unnest(weights) AS w, generate_subscripts(weights, 1) AS pos FROM site_weights),
    a AS (SELECT round, pos, sum(n_examples * w) / sum(n_examples) AS w FROM e GROUP BY 1, 2)
    SELECT a.round, a.pos - 1 AS pos, round(w, 9) AS w, n AS n_examples FROM a
    JOIN (SELECT round, CAST(sum(n_examples) AS BIGINT) AS n FROM site_weights GROUP BY 1) s ON a.round = s.round"""))
def _(t):
    averaged = MD.average_weights(t.site_weights)
    return averaged.select("round", "n_examples", F.posexplode("weights").alias("pos", "w")).select(
        "round", F.col("pos").cast("bigint").alias("pos"), F.round("w", 9).alias("w"), "n_examples")


@query("m10_random_forest")
def _(t):
    rows = t.predictions.select("y_true", F.col("score"), F.col("age").cast("double").alias("age"))
    return MD.forest_importances(rows, ["score", "age"], "y_true", trees=20, depth=5)


@query("m11_oversampling")
def _(t):
    rows = t.predictions.select("row_id", "y_true", "score", "age")
    return MD.oversample(rows, ["score", "age"], "y_true", "row_id")


@query("m11b_oversampled_classes", check("""
    WITH c AS (SELECT y_true, count(*) AS n FROM predictions WHERE y_true IN (0, 1) GROUP BY 1)
    SELECT y_true, (SELECT max(n) FROM c) AS n, n AS n_given FROM c"""))
def _(t):
    rows = t.predictions.select("row_id", "y_true", "score", "age").filter(F.col("y_true").isin(0, 1))
    return MD.oversample(rows, ["score", "age"], "y_true", "row_id").groupBy("y_true").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("is_synthetic")).alias("n_given"))


@query("m11c_neighbour_recall", check("""
    SELECT least(200, count(*)) AS n_queries, true AS recall_holds FROM predictions WHERE y_true = 1"""))
def _(t):
    rows = t.predictions.filter("y_true = 1").select("row_id", "score", "age")
    return N.neighbour_recall(rows, ["score", "age"], "row_id").select(
        "n_queries", (F.col("recall") >= 0.9).alias("recall_holds"))


@query("m14_federated_rounds")
def _(t):
    rows = S.scan_split(t.predictions, "train").select(
        "site", "y_true", (F.col("score") - 0.5).alias("score"), ((F.col("age") - 55) / 20).alias("age"))
    return MD.train_federated(rows, ["score", "age"], "y_true", rounds=2, local_epochs=2)


