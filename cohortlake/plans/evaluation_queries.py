"""Queries over scored rows: metrics, curves, thresholds, fairness, monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlake.functions import clinical as C
from cohortlake.functions.scalars import known, safe_ratio
from cohortlake.operators import evaluate as E, fairness as FA, monitor as M, odds as OD, thresholds as TH
from cohortlake.plans.checks import check
from cohortlake.plans.registry import query


def _counts(threshold="0.5"):
    return f"""count(*) FILTER (score >= {threshold} AND y_true = 1) AS tp,
      count(*) FILTER (score >= {threshold} AND y_true = 0) AS fp,
      count(*) FILTER (score < {threshold} AND y_true = 1) AS fn,
      count(*) FILTER (score < {threshold} AND y_true = 0) AS tn"""


def _ratio(a, b):
    return f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"


_METRICS = f"""tp, fp, fn, tn, tp + fp + fn + tn AS n,
  {_ratio('(tp + tn)', '(tp + fp + fn + tn)')} AS accuracy, {_ratio('tp', '(tp + fp)')} AS precision,
  {_ratio('tp', '(tp + fn)')} AS recall, {_ratio('(2 * tp)', '(2 * tp + fp + fn)')} AS f1_score,
  {_ratio('tn', '(tn + fp)')} AS specificity, {_ratio('tn', '(tn + fn)')} AS npv,
  {_ratio('(tp + fn)', '(tp + fp + fn + tn)')} AS prevalence"""
_RATES = f"""{_METRICS}, {_ratio('(tp + fp)', '(tp + fp + fn + tn)')} AS selection_rate,
  {_ratio('fp', '(fp + tn)')} AS fpr"""

_CURVE = """pts AS (SELECT score AS threshold, count(*) FILTER (y_true = 1) AS pos,
    count(*) FILTER (y_true = 0) AS neg FROM predictions GROUP BY 1),
  crv AS (SELECT threshold, pos, neg, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp,
    CAST(sum(pos) OVER () AS BIGINT) AS p, CAST(sum(neg) OVER () AS BIGINT) AS n FROM pts
    WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)),
  rates AS (SELECT *, tp / CAST(p AS DOUBLE) AS tpr, fp / CAST(n AS DOUBLE) AS fpr,
    tp / CAST(tp + fp AS DOUBLE) AS precision FROM crv)"""
_SITE_CURVE = """pts AS (SELECT site, score AS threshold, count(*) FILTER (y_true = 1) AS pos,
    count(*) FILTER (y_true = 0) AS neg FROM predictions GROUP BY 1, 2),
  crv AS (SELECT *, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp,
    CAST(sum(pos) OVER s AS BIGINT) AS p, CAST(sum(neg) OVER s AS BIGINT) AS n FROM pts
    WINDOW w AS (PARTITION BY site ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING), s AS (PARTITION BY site))"""


def _grid(low, high, count=100):
    return f"""grid AS (SELECT CAST({low} AS DOUBLE) + CAST(i AS DOUBLE) * CAST('{(high - low) / (count - 1)!r}' AS DOUBLE) AS threshold
      FROM range({count}) r(i)),
    swept AS (SELECT g.threshold, count(*) FILTER (score >= g.threshold AND y_true = 1) AS tp,
      count(*) FILTER (score >= g.threshold AND y_true = 0) AS fp,
      count(*) FILTER (score < g.threshold AND y_true = 1) AS fn,
      count(*) FILTER (score < g.threshold AND y_true = 0) AS tn
      FROM grid g CROSS JOIN predictions GROUP BY g.threshold)"""


# ---- class balance and confusion ------------------------------------------------


@query("a34_class_balance", """
    SELECT count(*) FILTER (quality = 0) AS n_negative, count(*) FILTER (quality = 1) AS n_positive,
      count(*) FILTER (quality = 0) / CAST(count(*) FILTER (quality = 1) AS DOUBLE) AS imbalance_ratio FROM labels""")
def _(t):
    return E.class_balance(t.raw("labels"), "quality")


@query("a35_class_weights", """
    SELECT quality, count(*) AS n_class,
      CAST(sum(count(*)) OVER () AS DOUBLE) / (count(*) OVER () * count(*)) AS weight FROM labels GROUP BY quality""")
def _(t):
    return E.class_weights(t.raw("labels"), "quality")


@query("p34_score_class", check("""
    SELECT row_id, CAST(score >= 0.5 AS INT) AS predicted FROM predictions"""))
def _(t):
    return t.predictions.select("row_id", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("a36_confusion_counts", check(f"SELECT {_counts()} FROM predictions"))
def _(t):
    return t.predictions.agg(*E.confusion_counts(0.5))


@query("a37_classification_metrics", check(f"""
    WITH c AS (SELECT site, {_counts()} FROM predictions WHERE data_split = 'test' GROUP BY site)
    SELECT site, {_METRICS} FROM c"""))
def _(t):
    return E.classification_metrics(t.predictions.filter(F.col("data_split") == "test"), ["site"])


@query("a40_site_and_pooled", check(f"""
    WITH c AS (SELECT coalesce(site, 'AGGREGATED') AS site, {_counts()} FROM predictions
      GROUP BY GROUPING SETS ((site), ()))
    SELECT site, {_METRICS} FROM c"""))
def _(t):
    return E.site_and_pooled_metrics(t.predictions)


@query("a66_accuracy_by_class", check("""
    SELECT y_true, count(*) AS n, count(*) FILTER ((score >= 0.5) = (y_true = 1)) AS n_correct,
      avg(CASE WHEN (score >= 0.5) = (y_true = 1) THEN CAST(1 AS DOUBLE) ELSE 0 END) AS accuracy
    FROM predictions GROUP BY y_true"""))
def _(t):
    return E.accuracy_by_class(t.predictions)


# ---- ranking metrics and curves ---------------------------------------------------


@query("a38_roc_auc", check(f"""
    WITH {_SITE_CURVE}
    SELECT site, sum(CAST(neg AS DOUBLE) * (tp - pos / CAST(2 AS DOUBLE))) / (CAST(max(p) AS DOUBLE) * max(n)) AS roc_auc
    FROM crv GROUP BY site"""))
def _(t):
    return E.ranking_metrics(E.curve(t.predictions, ["site"]), ["site"]).select("site", "roc_auc")


@query("a39_average_precision", check(f"""
    WITH {_SITE_CURVE}
    SELECT site, round(sum(pos * (CAST(tp AS DOUBLE) / (tp + fp))) / max(p), 9) AS average_precision FROM crv GROUP BY site"""))
def _(t):
    found = E.ranking_metrics(E.curve(t.predictions, ["site"]), ["site"])
    return found.select("site", F.round("average_precision", 9).alias("average_precision"))


@query("a41_roc_pr_points", check(f"""
    WITH {_CURVE} SELECT threshold, fpr, tpr, precision, tpr AS recall FROM rates"""))
def _(t):
    points = E.pr_points(E.roc_points(E.curve(t.predictions)))
    return points.select("threshold", "fpr", "tpr", "precision", "recall")


@query("w07_cumulative_counts", check(f"""
    WITH {_SITE_CURVE} SELECT site, threshold, tp, fp, p, n FROM crv"""))
def _(t):
    return E.curve(t.predictions, ["site"]).select("site", "threshold", "tp", "fp", "p", "n")


@query("a42_calibration", check("""
    SELECT CAST(greatest(0, least(9, ceil(score * 10) - 1)) AS INT) AS bin, round(avg(score), 9) AS mean_score,
      avg(CAST(y_true AS DOUBLE)) AS observed_rate, count(*) AS n FROM predictions GROUP BY 1"""))
def _(t):
    return E.calibration(t.predictions).withColumn("mean_score", F.round("mean_score", 9))


@query("a43_metric_melt", check(f"""
    WITH c AS (SELECT coalesce(site, 'AGGREGATED') AS site, {_counts()} FROM predictions
      GROUP BY GROUPING SETS ((site), ())), m AS (SELECT site, {_METRICS} FROM c)
    SELECT site, metric, value FROM m UNPIVOT (value FOR metric IN (accuracy, precision, recall, f1_score))"""))
def _(t):
    wide = E.site_and_pooled_metrics(t.predictions)
    return E.melt_metrics(wide, ["site"], ["accuracy", "precision", "recall", "f1_score"])


# ---- thresholds -------------------------------------------------------------------


@query("a44_threshold_sweep", check(f"WITH {_grid(0.05, 0.95)} SELECT threshold, {_METRICS} FROM swept"))
def _(t):
    return TH.sweep(t.predictions)


@query("a45_youden", check(f"""
    WITH {_CURVE} SELECT threshold, tpr - fpr AS youden_j FROM rates ORDER BY tpr - fpr DESC, threshold DESC LIMIT 1"""))
def _(t):
    return TH.best_youden(E.curve(t.predictions))


_F1 = "2 * (precision * tpr) / (precision + tpr + 1e-10)"


@query("a46_best_f1", check(f"""
    WITH {_CURVE} SELECT threshold, {_F1} AS f1 FROM rates ORDER BY {_F1} DESC, threshold LIMIT 1"""))
def _(t):
    return TH.best_f1(E.curve(t.predictions))


@query("a47_target_recall", check(f"""
    WITH {_CURVE} (SELECT 0.85::DOUBLE AS target, threshold, tpr AS recall FROM rates ORDER BY abs(tpr - 0.85::DOUBLE), threshold LIMIT 1)
    UNION ALL (SELECT 0.80::DOUBLE, threshold, tpr FROM rates ORDER BY abs(tpr - 0.80::DOUBLE), threshold LIMIT 1)"""))
def _(t):
    points = E.curve(t.predictions)

    def found(target):
        return TH.nearest_recall(points, target).withColumn("target", F.lit(target))

    return found(0.85).unionByName(found(0.80))


@query("a48_cost_minimum", check(f"""
    WITH {_grid(0.1, 0.9)} SELECT threshold, 10 * fn + fp AS cost FROM swept ORDER BY 10 * fn + fp, threshold LIMIT 1"""))
def _(t):
    return TH.cheapest(t.predictions)


_METHODS = f"""WITH {_CURVE}, {_grid(0.1, 0.9)},
  methods AS (
    (SELECT 'Youden Index' AS method, threshold AS t FROM rates ORDER BY tpr - fpr DESC, threshold DESC LIMIT 1)
    UNION ALL (SELECT 'F1 Maximum', threshold FROM rates ORDER BY {_F1} DESC, threshold LIMIT 1)
    UNION ALL (SELECT 'Target Recall 85%', threshold FROM rates ORDER BY abs(tpr - 0.85::DOUBLE), threshold LIMIT 1)
    UNION ALL (SELECT 'Target Recall 80%', threshold FROM rates ORDER BY abs(tpr - 0.80::DOUBLE), threshold LIMIT 1)
    UNION ALL (SELECT 'Cost-Sensitive (10:1)', threshold FROM swept ORDER BY 10 * fn + fp, threshold LIMIT 1)
    UNION ALL (SELECT 'Current (0.5)', CAST(0.5 AS DOUBLE))),
  c AS (SELECT method, t AS threshold, {_counts('t')} FROM methods CROSS JOIN predictions GROUP BY 1, 2),
  results AS (SELECT method, threshold, {_METRICS}, tp + fn AS total_deaths, tp AS deaths_caught, fn AS deaths_missed FROM c)"""


@query("a49_threshold_report", check(f"{_METHODS} SELECT * FROM results"))
def _(t):
    return TH.evaluate_thresholds(t.predictions, TH.optimal_thresholds(t.predictions))


@query("a50_scenarios", check(f"""{_METHODS} SELECT CASE method WHEN 'Target Recall 85%' THEN 'screening'
      WHEN 'Youden Index' THEN 'balanced' WHEN 'F1 Maximum' THEN 'specific' ELSE 'current' END AS scenario,
      method, threshold, recall, precision, deaths_missed FROM results
    WHERE method IN ('Target Recall 85%', 'Youden Index', 'F1 Maximum', 'Current (0.5)')"""))
def _(t):
    found = TH.evaluate_thresholds(t.predictions, TH.optimal_thresholds(t.predictions))
    return TH.recommend(found).select("scenario", "method", "threshold", "recall", "precision", "deaths_missed")


# ---- fairness -----------------------------------------------------------------------

_SLICED = """sliced AS (SELECT row_id, site, y_true, score, gender, insurance, coalesce(race, 'Unknown') AS race,
    CASE WHEN age < 40 THEN '<40' WHEN age < 60 THEN '40-60' WHEN age < 75 THEN '60-75' ELSE '75+' END AS age_group
    FROM predictions WHERE data_split = 'test')"""
_SLICES = f"""{_SLICED},
  long AS (SELECT y_true, score, feature, slice_value FROM sliced
    UNPIVOT (slice_value FOR feature IN (gender, age_group, insurance, race))),
  sc AS (SELECT feature, slice_value, {_counts()} FROM long GROUP BY 1, 2),
  slices AS (SELECT feature, slice_value, {_RATES} FROM sc),
  parity AS (SELECT feature, max(selection_rate) - min(selection_rate) AS demographic_parity_difference,
    greatest(max(recall) - min(recall), max(fpr) - min(fpr)) AS equalized_odds_difference FROM slices GROUP BY feature)"""


def _test_slices(t):
    return FA.with_slices(t.predictions.filter(F.col("data_split") == "test"))


def _slices(t):
    return FA.slice_metrics(FA.cells(_test_slices(t)))


@query("a51_slice_metrics", check(f"WITH {_SLICES} SELECT * FROM slices"))
def _(t):
    return _slices(t)


@query("a52_intersections", check(f"""
    WITH {_SLICED}, c AS (SELECT gender, age_group, insurance, {_counts()} FROM sliced GROUP BY 1, 2, 3)
    SELECT gender, age_group, insurance, {_RATES} FROM c"""))
def _(t):
    return FA.intersection_metrics(FA.cells(_test_slices(t)), ["gender", "age_group", "insurance"])


@query("a53_demographic_parity", check(f"WITH {_SLICES} SELECT feature, demographic_parity_difference FROM parity"))
def _(t):
    return FA.parity(_slices(t)).select("feature", "demographic_parity_difference")


@query("a54_equalized_odds", check(f"WITH {_SLICES} SELECT feature, equalized_odds_difference FROM parity"))
def _(t):
    return FA.parity(_slices(t)).select("feature", "equalized_odds_difference")


@query("a55_performance_gaps", check(f"""
    WITH {_SLICES}, m AS (SELECT feature, metric, value FROM slices
      UNPIVOT (value FOR metric IN (accuracy, precision, recall, f1_score, selection_rate)))
    SELECT feature, metric, max(value) - min(value) AS gap,
      CASE WHEN max(value) > 0 THEN min(value) / max(value) ELSE CAST(0 AS DOUBLE) END AS ratio FROM m GROUP BY 1, 2"""))
def _(t):
    return FA.gaps(_slices(t))


@query("a56_fairness_violations", check(f"""
    WITH {_SLICES}, m AS (SELECT feature, metric, value FROM parity
      UNPIVOT (value FOR metric IN (demographic_parity_difference, equalized_odds_difference)))
    SELECT feature, metric, value, CAST(0.03 AS DOUBLE) AS threshold,
      CASE WHEN abs(value) > 2 * 0.03::DOUBLE THEN 'high' ELSE 'medium' END AS severity,
      (SELECT count(*) = 0 FROM m WHERE abs(value) > 0.03::DOUBLE) AS bias_check_passed
    FROM m WHERE abs(value) > 0.03::DOUBLE"""))
def _(t):
    parities = FA.parity(_slices(t))
    gate = FA.fairness_gate(parities, 0.03, 0.03).select("bias_check_passed", F.lit(0.03).alias("threshold"))
    # the gate is one row
    return FA.violations(parities, 0.03, 0.03).join(F.broadcast(gate), "threshold")


@query("a57_site_deviation", check(f"""
    WITH c AS (SELECT coalesce(site, 'AGGREGATED') AS site, {_counts()} FROM predictions
      GROUP BY GROUPING SETS ((site), ())), m AS (SELECT site, {_METRICS} FROM c)
    SELECT s.site, abs(p.accuracy - s.accuracy) AS accuracy_gap, abs(p.recall - s.recall) AS recall_gap,
      abs(p.accuracy - s.accuracy) > 0.05 OR abs(p.recall - s.recall) > 0.07 AS bias_detected
    FROM m s CROSS JOIN m p WHERE s.site <> 'AGGREGATED' AND p.site = 'AGGREGATED'"""))
def _(t):
    return FA.site_deviation(E.site_and_pooled_metrics(t.predictions))


@query("j17_scores_with_attributes", check("""
    SELECT row_id, score, gender, insurance FROM predictions"""))
def _(t):
    return FA.join_attributes(
        t.predictions.select("row_id", "score"), t.predictions.select("row_id", "gender", "insurance"))


@query("m12_group_thresholds", check("""
    WITH grid AS (SELECT CAST(0.05 AS DOUBLE) + CAST(i AS DOUBLE) * CAST('%r' AS DOUBLE) AS threshold FROM range(100) r(i)),
    c AS (SELECT gender, threshold, count(*) FILTER (score >= threshold AND y_true = 1) AS tp,
        count(*) FILTER (score >= threshold AND y_true = 0) AS fp, count(*) FILTER (score < threshold AND y_true = 1) AS fn,
        count(*) FILTER (score < threshold AND y_true = 0) AS tn FROM grid CROSS JOIN predictions GROUP BY 1, 2),
    r AS (SELECT gender, threshold, fp, fn, tp / CAST(tp + fn AS DOUBLE) AS recall, tn / CAST(tn + fp AS DOUBLE) AS spec FROM c),
    best AS (SELECT level, gender, max(threshold) AS threshold FROM range(101) l(level)
      JOIN r ON floor(recall * 100 + 1e-9) >= level GROUP BY 1, 2),
    b AS (SELECT level, r.* FROM best JOIN r USING (gender, threshold)),
    s AS (SELECT level, count(*) AS n, greatest(max(recall) - min(recall), max(spec) - min(spec)) AS odds_gap,
      CAST(sum(fp + fn) AS BIGINT) AS errors FROM b GROUP BY level HAVING count(*) = (SELECT count(DISTINCT gender) FROM r)),
    chosen AS (SELECT level, odds_gap FROM s ORDER BY CASE WHEN odds_gap <= 0.05::DOUBLE THEN 0 ELSE 1 END,
      CASE WHEN odds_gap <= 0.05::DOUBLE THEN CAST(errors AS DOUBLE) ELSE odds_gap END, level LIMIT 1)
    SELECT gender, threshold, recall, fp, fn, odds_gap FROM b JOIN chosen USING (level)""" % ((0.95 - 0.05) / 99)))
def _(t):
    return FA.group_thresholds(t.predictions, "gender")


_HULL = """
    s AS (SELECT coalesce(gender, 'Unknown') AS gender, score, count(*) FILTER (y_true = 1) AS pos, count(*) FILTER (y_true <> 1) AS neg
      FROM predictions WHERE score IS NOT NULL GROUP BY 1, 2),
    c AS (SELECT gender, score AS threshold, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
      sum(pos) OVER (PARTITION BY gender) AS p, sum(neg) OVER (PARTITION BY gender) AS n FROM s
      WINDOW w AS (PARTITION BY gender ORDER BY score DESC)),
    d AS (SELECT gender, fp, max(tp) AS tp, arg_max(threshold, tp) AS threshold, max(p) AS p, max(n) AS n FROM
      (SELECT * FROM c UNION ALL SELECT DISTINCT gender, NULL, 0, 0, p, n FROM c) GROUP BY gender, fp),
    hull AS (SELECT gender, CAST(fp AS BIGINT) AS fp, CAST(tp AS BIGINT) AS tp, threshold, CAST(p AS BIGINT) AS p,
      CAST(n AS BIGINT) AS n FROM d WHERE coalesce(
      (SELECT min((d.tp - u.tp) / CAST(d.fp - u.fp AS DOUBLE)) FROM d u WHERE u.gender = d.gender AND u.fp < d.fp)
      > (SELECT max((v.tp - d.tp) / CAST(v.fp - d.fp AS DOUBLE)) FROM d v WHERE v.gender = d.gender AND v.fp > d.fp), true))"""


@query("m12b_roc_hull", check(f"WITH {_HULL} SELECT * FROM hull"))
def _(t):
    return OD.roc_hull(E.curve(t.predictions.withColumn("gender", known(F.col("gender"))), ["gender"]), "gender")


@query("m12c_equalized_odds", check(f"""
    WITH {_HULL},
    e AS (SELECT gender, fp / CAST(n AS DOUBLE) AS x1, tp / CAST(p AS DOUBLE) AS y1, threshold AS t1,
      lag(fp / CAST(n AS DOUBLE)) OVER w AS x0, lag(tp / CAST(p AS DOUBLE)) OVER w AS y0, lag(threshold) OVER w AS t0,
      fp * 1000 // n AS upto, coalesce(lag(fp * 1000 // n) OVER w, -1) AS after FROM hull WINDOW w AS (PARTITION BY gender ORDER BY fp)),
    cells AS (SELECT *, CAST(unnest(range(after + 1, upto + 1)) AS BIGINT) AS i FROM e),
    r AS (SELECT gender, i, i / 1000.0::DOUBLE AS x, t0, t1,
      CASE WHEN x0 IS NULL THEN 1.0::DOUBLE ELSE (i / 1000.0::DOUBLE - x0) / (x1 - x0) END AS w, x0, y0, y1 FROM cells),
    y AS (SELECT *, CASE WHEN x0 IS NULL THEN y1 ELSE y0 + w * (y1 - y0) END AS y FROM r),
    total AS (SELECT CAST(sum(p) AS DOUBLE) AS p, CAST(sum(n) AS DOUBLE) AS n, count(*) AS k FROM (SELECT DISTINCT gender, p, n FROM hull)),
    common AS (SELECT i, x, min(y) AS recall FROM y GROUP BY i, x HAVING count(*) = (SELECT k FROM total)),
    best AS (SELECT i, recall FROM common, total ORDER BY p * recall + n * (1 - x) DESC, i LIMIT 1)
    SELECT gender, t0 AS strict_threshold, t1 AS lenient_threshold, w AS lenient_weight,
      CASE WHEN y - x > 0 THEN (y - recall) / (y - x) ELSE 0.0::DOUBLE END AS ignored, x AS fpr, recall
    FROM y JOIN best USING (i)"""))
def _(t):
    return OD.equalized_odds(t.predictions, "gender")


@query("m13_variant_comparison", check(f"""
    WITH v AS (SELECT 'baseline' AS variant, gender, y_true, CAST(score >= 0.5 AS DOUBLE) AS score FROM predictions
      UNION ALL SELECT 'lower_cut', gender, y_true, CAST(score >= 0.4 AS DOUBLE) FROM predictions
      UNION ALL SELECT 'group_cut', gender, y_true,
        CAST(score >= CASE WHEN gender = 'F' THEN 0.45 ELSE 0.5 END AS DOUBLE) FROM predictions),
    g AS (SELECT variant, gender, {_counts()} FROM v GROUP BY 1, 2), s AS (SELECT variant, gender, {_RATES} FROM g),
    pc AS (SELECT variant, {_counts()} FROM v GROUP BY 1), pm AS (SELECT variant, {_METRICS} FROM pc),
    par AS (SELECT variant, max(selection_rate) - min(selection_rate) AS demographic_parity_difference,
      greatest(max(recall) - min(recall), max(fpr) - min(fpr)) AS equalized_odds_difference FROM s GROUP BY 1),
    j AS (SELECT * FROM pm JOIN par USING (variant))
    SELECT 'gender' AS feature, variant, accuracy, recall, precision, demographic_parity_difference,
      equalized_odds_difference,
      row_number() OVER (ORDER BY equalized_odds_difference, accuracy DESC, variant) = 1 AS is_chosen FROM j"""))
def _(t):
    cut = F.when(F.col("gender") == "F", 0.45).otherwise(0.5)

    def at(limit):
        return t.predictions.withColumn("predicted", (F.col("score") >= limit).cast("int"))

    variants = {"baseline": at(0.5), "lower_cut": at(0.4), "group_cut": at(cut)}
    return FA.compare_variants(variants, "gender")


# ---- monitoring ----------------------------------------------------------------------

_DAILY = f"""daily AS (SELECT CAST(scored_at AS DATE) AS day, {_counts()} FROM predictions GROUP BY 1),
  perf AS (SELECT day, {_METRICS} FROM daily)"""


@query("a63_retrain_decision", check(f"""
    WITH {_DAILY}, f AS (SELECT day, accuracy, recall,
      CASE WHEN accuracy < 0.85 THEN 'Accuracy (' || printf('%.2f', accuracy * 100) || '%) < 85.00%' END AS a,
      CASE WHEN recall < 0.70 THEN 'Recall (' || printf('%.2f', recall * 100) || '%) < 70.00%' END AS r FROM perf)
    SELECT day, accuracy, recall, concat_ws('; ', a, r) AS reasons, a IS NOT NULL OR r IS NOT NULL AS needs_retraining FROM f"""))
def _(t):
    daily = M.daily_performance(t.predictions)
    return M.retrain_decision(daily).select("day", "accuracy", "recall", "reasons", "needs_retraining")


_DEGRADED = f"""WITH {_DAILY}, l AS (SELECT accuracy, recall FROM perf ORDER BY day DESC LIMIT 1),
    b AS (SELECT avg(accuracy) AS avg_acc FROM perf)
    SELECT l.accuracy AS current_accuracy, round(b.avg_acc, 9) AS baseline_accuracy,
      round(l.accuracy - b.avg_acc, 9) AS accuracy_diff,
      CASE WHEN l.accuracy < 0.85 OR l.recall < 0.70 THEN 'RETRAINING NEEDED'
        WHEN l.accuracy < b.avg_acc - 0.02 THEN 'DEGRADATION DETECTED' ELSE 'OK' END AS status FROM l, b"""


def _degradation(t):
    return M.degradation(M.daily_performance(t.predictions)).withColumn(
        "baseline_accuracy", F.round("baseline_accuracy", 9)
    ).withColumn("accuracy_diff", F.round("accuracy_diff", 9))


query("a64_degradation", check(_DEGRADED))(_degradation)


@query("j11_latest_and_baseline", check(f"""
    WITH {_DAILY}, l AS (SELECT tp, fn FROM perf ORDER BY day DESC LIMIT 1),
    b AS (SELECT min(day) AS first_day, max(day) AS last_day, count(*) AS n_days FROM perf)
    SELECT * FROM l, b"""))
def _(t):
    # both one-row relations come from one aggregate, so nothing is cross joined
    return M.daily_performance(t.predictions).agg(
        F.max_by("tp", "day").alias("tp"), F.max_by("fn", "day").alias("fn"),
        F.min("day").alias("first_day"), F.max("day").alias("last_day"),
        F.count(F.lit(1)).alias("n_days"))


@query("p21_measured_rows", check(f"""
    WITH {_DAILY} SELECT day, n AS samples_tested, round(accuracy * 100, 2) AS accuracy_pct,
      round(recall, 4) AS recall, round(precision, 4) AS precision FROM perf WHERE n > 0 ORDER BY day DESC"""))
def _(t):
    daily = M.daily_performance(t.predictions).filter(F.col("samples_tested") > 0)
    return daily.select(
        "day", "samples_tested", F.round(F.col("accuracy") * 100, 2).alias("accuracy_pct"),
        F.round("recall", 4).alias("recall"), F.round("precision", 4).alias("precision"),
    ).orderBy(F.col("day").desc())


@query("a65_quality_gate", check(f"""
    WITH c AS (SELECT coalesce(site, 'AGGREGATED') AS site, {_counts()} FROM predictions
      GROUP BY GROUPING SETS ((site), ())), m AS (SELECT site, {_METRICS} FROM c)
    SELECT site, accuracy, recall, accuracy >= 0.85 AND recall >= 0.70 AS gate_passed FROM m"""))
def _(t):
    return M.quality_gate(E.site_and_pooled_metrics(t.predictions)).select("site", "accuracy", "recall", "gate_passed")


@query("a65b_regression_gate", check("""
    SELECT run_id, accuracy, lag(accuracy) OVER (ORDER BY finished_at, run_id) AS previous_accuracy,
      coalesce(accuracy < lag(accuracy) OVER (ORDER BY finished_at, run_id) - 0.02::DOUBLE, false) AS regressed FROM runs"""))
def _(t):
    return M.regression_gate(t.runs).select("run_id", "accuracy", "previous_accuracy", "regressed")


@query("a67_latest_run_card", check("""
    SELECT run_id, learning_rate, optimizer, val_auc FROM runs ORDER BY val_auc DESC, run_id LIMIT 1"""))
def _(t):
    card = F.struct("run_id", "learning_rate", "optimizer", "val_auc")
    return t.runs.agg(F.max_by(card, F.struct("val_auc", -F.col("run_id"))).alias("card")).select("card.*")


@query("w08_rolling_accuracy", check(f"""
    WITH d AS (SELECT site, CAST(scored_at AS DATE) AS day, count(*) AS n,
      count(*) FILTER ((score >= 0.5) = (y_true = 1)) AS good FROM predictions GROUP BY 1, 2),
    r AS (SELECT site, day, sum(good) OVER w / CAST(sum(n) OVER w AS DOUBLE) AS rolling_accuracy FROM d
      WINDOW w AS (PARTITION BY site ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW))
    SELECT site, day, rolling_accuracy, rolling_accuracy < 0.80 AS alert FROM r"""))
def _(t):
    return M.rolling_accuracy(M.daily_performance(t.predictions, ["site"]), by=["site"])


@query("q08_distribution_shift", check("""
    WITH h AS (SELECT bin, 1 + count(*) FILTER (data_split = 'test') AS p, 1 + count(*) FILTER (data_split = 'train') AS q
      FROM range(10) r(bin) LEFT JOIN predictions ON least(CAST(floor(score * 10) AS INT), 9) = bin GROUP BY bin),
    s AS (SELECT p / CAST(sum(p) OVER () AS DOUBLE) AS p, q / CAST(sum(q) OVER () AS DOUBLE) AS q FROM h)
    SELECT round(sum(p * ln(p / q)), 9) AS kl, sum(p * ln(p / q)) > 0.1 AS retrain FROM s"""))
def _(t):
    p = t.predictions
    found = M.distribution_shift(p.filter(F.col("data_split") == "test"), p.filter(F.col("data_split") == "train"))
    return found.withColumn("kl", F.round("kl", 9))


@query("q10_calibration_gate", check("""
    SELECT site, round(avg((score - y_true) * (score - y_true)), 9) AS brier,
      avg((score - y_true) * (score - y_true)) < 0.15 AS passed FROM predictions GROUP BY site"""))
def _(t):
    return E.brier(t.predictions, by=["site"]).withColumn("brier", F.round("brier", 9))


@query("p25_risk_level", check("""
    SELECT row_id, CASE WHEN score >= 0.7 THEN 'HIGH' WHEN score >= 0.3 THEN 'MODERATE' ELSE 'LOW' END AS inclusive_level,
      CASE WHEN score > 0.7 THEN 'HIGH' WHEN score > 0.3 THEN 'MODERATE' ELSE 'LOW' END AS exclusive_level
    FROM predictions"""))
def _(t):
    return t.predictions.select(
        "row_id", C.risk_level(F.col("score")).alias("inclusive_level"),
        C.risk_level(F.col("score"), inclusive=False).alias("exclusive_level"))


@query("a62_round_rollup", check("""
    WITH c AS (SELECT CAST(row_id % 4 AS INT) AS round, site, count(*) AS n_examples,
        count(*) FILTER (score >= 0.5 AND y_true = 1) AS tp, count(*) FILTER (score >= 0.5) AS pp,
        count(*) FILTER (y_true = 1) AS ap FROM predictions GROUP BY 1, 2),
    m AS (SELECT *, tp / CAST(pp AS DOUBLE) AS precision, tp / CAST(ap AS DOUBLE) AS recall FROM c),
    r AS (SELECT round, count(*) AS n_clients, CAST(sum(n_examples) AS BIGINT) AS n_examples,
      sum(precision * n_examples) / sum(n_examples) AS p, sum(recall * n_examples) / sum(n_examples) AS r FROM m GROUP BY 1)
    SELECT round, n_clients, n_examples, round(p, 9) AS precision, round(r, 9) AS recall,
      round(2 * p * r / (p + r), 9) AS f1 FROM r"""))
def _(t):
    scored = t.predictions.withColumn("round", (F.col("row_id") % 4).cast("int"))
    clients = E.classification_metrics(scored, ["round", "site"]).withColumnRenamed("n", "n_examples")
    out = M.round_metrics(clients)
    for name in ("precision", "recall", "f1"):
        out = out.withColumn(name, F.round(name, 9))
    return out


@query("f13_safe_ratio", check("""
    SELECT site, count(*) FILTER (race IS NULL) AS n_unknown,
      CASE WHEN count(*) FILTER (age > 200) > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS empty_ratio,
      count(*) FILTER (y_true = 1) / CAST(count(*) AS DOUBLE) AS rate FROM predictions GROUP BY site"""))
def _(t):
    counted = t.predictions.groupBy("site").agg(
        F.count_if(F.col("race").isNull()).alias("n_unknown"), F.count_if(F.col("age") > 200).alias("none"),
        F.count_if(F.col("y_true") == 1).alias("p"), F.count(F.lit(1)).alias("n"))
    return counted.select(
        "site", "n_unknown", safe_ratio(F.col("n"), F.col("none")).alias("empty_ratio"),
        safe_ratio(F.col("p"), F.col("n")).alias("rate"))
