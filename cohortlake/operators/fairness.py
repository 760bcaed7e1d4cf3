"""Fairness audits over sensitive slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cohortlake.functions.scalars import bin_column, known, safe_ratio
from cohortlake.operators import evaluate as E, thresholds as TH

FEATURES = ["gender", "age_group", "insurance", "race"]
AGE_EDGES, AGE_LABELS = [0, 40, 60, 75, 150], ["<40", "40-60", "60-75", "75+"]
METRICS = ["accuracy", "precision", "recall", "f1_score", "selection_rate"]


def with_slices(df: DataFrame) -> DataFrame:
    """Sensitive columns as known strings, age as a left-closed group."""
    group = bin_column(F.col("age"), AGE_EDGES, AGE_LABELS, right=False)
    out = df.withColumn("age_group", known(group))
    for name in ("gender", "insurance", "race"):
        out = out.withColumn(name, known(F.col(name)))
    return out


def join_attributes(scores: DataFrame, attributes: DataFrame, key: str = "row_id") -> DataFrame:
    """Scores with sensitive attributes by row id."""
    return scores.join(attributes, key)


def cells(df: DataFrame, features: Sequence[str] = FEATURES, threshold: float = 0.5) -> DataFrame:
    """Confusion counts per combination of slices.

    Every slice statistic is a sum over these few rows, so the scores are read once.
    """
    return df.groupBy(*features).agg(*E.confusion_counts(threshold))


def _with_rates(df: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in E.COUNTS)
    return (
        E.with_metrics(df)
        .withColumn("selection_rate", safe_ratio(tp + fp, tp + fp + fn + tn))
        .withColumn("fpr", safe_ratio(fp, fp + tn))
    )


def slice_metrics(counted: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Metrics per (feature, value)."""
    long = counted.unpivot(E.COUNTS, list(features), "feature", "slice_value")
    return _with_rates(
        long.groupBy("feature", "slice_value").agg(*[F.sum(c).alias(c) for c in E.COUNTS])
    )


def intersection_metrics(counted: DataFrame, features: Sequence[str]) -> DataFrame:
    """Metrics per combination of features."""
    return _with_rates(counted.groupBy(*features).agg(*[F.sum(c).alias(c) for c in E.COUNTS]))


def _spread(column: str) -> Column:
    return F.max(column) - F.min(column)


def parity(slices: DataFrame) -> DataFrame:
    """Demographic parity and equalized odds differences per feature."""
    return slices.groupBy("feature").agg(
        _spread("selection_rate").alias("demographic_parity_difference"),
        F.greatest(_spread("recall"), _spread("fpr")).alias("equalized_odds_difference"),
    )


def gaps(slices: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Gap max - min and ratio min / max of each metric per feature."""
    long = slices.unpivot(["feature", "slice_value"], list(metrics), "metric", "value")
    return long.groupBy("feature", "metric").agg(
        _spread("value").alias("gap"), safe_ratio(F.min("value"), F.max("value")).alias("ratio")
    )


def violations(parities: DataFrame, dp_limit: float = 0.1, eo_limit: float = 0.1) -> DataFrame:
    """One row per exceeded limit with its severity."""
    names = ["demographic_parity_difference", "equalized_odds_difference"]
    long = parities.unpivot(["feature"], names, "metric", "value")
    limit = F.when(F.col("metric") == names[0], F.lit(dp_limit)).otherwise(F.lit(eo_limit))
    return (
        long.withColumn("threshold", limit)
        .filter(F.abs("value") > F.col("threshold"))
        .withColumn("severity", F.when(F.abs("value") > 2 * F.col("threshold"), "high").otherwise("medium"))
    )


def fairness_gate(parities: DataFrame, dp_limit: float = 0.1, eo_limit: float = 0.1) -> DataFrame:
    """Largest differences and whether all limits hold."""
    return parities.agg(
        F.max("demographic_parity_difference").alias("max_demographic_parity"),
        F.max("equalized_odds_difference").alias("max_equalized_odds"),
    ).withColumn(
        "bias_check_passed",
        (F.col("max_demographic_parity") <= dp_limit) & (F.col("max_equalized_odds") <= eo_limit),
    )


def site_deviation(metrics: DataFrame, accuracy_limit: float = 0.05, recall_limit: float = 0.07) -> DataFrame:
    """Sites whose accuracy or recall is far from the pooled value."""
    pooled = metrics.filter(F.col("site") == "AGGREGATED").select(
        F.lit("AGGREGATED").alias("_p"), F.col("accuracy").alias("_acc"), F.col("recall").alias("_rec")
    )
    sites = metrics.filter(F.col("site") != "AGGREGATED").withColumn("_p", F.lit("AGGREGATED"))
    # the right side is the single pooled row
    return sites.join(F.broadcast(pooled), "_p").select(
        "site",
        F.abs(F.col("_acc") - F.col("accuracy")).alias("accuracy_gap"),
        F.abs(F.col("_rec") - F.col("recall")).alias("recall_gap"),
    ).withColumn(
        "bias_detected",
        (F.col("accuracy_gap") > accuracy_limit) | (F.col("recall_gap") > recall_limit),
    )


def group_thresholds(
    df: DataFrame, group: str, max_gap: float = 0.05, levels: int = 100,
    grid: tuple[float, float, int] = TH.SWEEP,
) -> DataFrame:
    """A threshold per group under equalized odds.

    For each target recall level, every group takes its highest grid threshold that
    reaches the level; among levels whose recall and false-positive gaps stay within
    ``max_gap`` the one with fewest errors wins (else the one with the smallest gap). A null
    group is the group ``Unknown``.
    """
    points = TH.sweep(df.withColumn(group, known(F.col(group))), grid, [group]).select(
        group, "threshold", "recall", "specificity", "fp", "fn"
    )
    # a grid point reaches the levels up to its recall: at most grid x levels rows per group
    reach = F.floor(F.col("recall") * levels + F.lit(1e-9)).cast("int")
    reached = points.withColumn("level", F.explode(F.sequence(F.lit(0), reach)))
    best = reached.groupBy("level", group).agg(
        F.max_by(
            F.struct("threshold", "recall", "specificity", "fp", "fn"), F.col("threshold")
        ).alias("b")
    ).select("level", group, "b.*")
    n_groups = points.agg(F.countDistinct(group).alias("n")).first()["n"]
    scored = best.groupBy("level").agg(
        F.count(F.lit(1)).alias("n"),
        F.greatest(_spread("recall"), _spread("specificity")).alias("odds_gap"),
        F.sum(F.col("fp") + F.col("fn")).alias("errors"),
    ).filter(F.col("n") == n_groups)
    fits = F.col("odds_gap") <= max_gap
    order = F.struct(
        F.when(fits, 0).otherwise(1),
        F.when(fits, F.col("errors").cast("double")).otherwise(F.col("odds_gap")),
        F.col("level"),
    )
    chosen = scored.agg(
        F.min_by("level", order).alias("level"), F.min_by("odds_gap", order).alias("odds_gap")
    )
    # one row
    return best.join(F.broadcast(chosen), "level").select(group, "threshold", "recall", "fp", "fn", "odds_gap")


def compare_variants(variants: dict[str, DataFrame], feature: str) -> DataFrame:
    """Accuracy, recall and parity of scoring variants side by side, with the choice.

    A variant is a frame of scored rows with a 0/1 ``predicted`` column.
    """
    from functools import reduce

    rows = []
    for name, df in variants.items():
        flagged = df.withColumn("score", F.col("predicted").cast("double"))
        counted = cells(flagged, [feature], 0.5)
        slices = slice_metrics(counted, [feature])
        pooled = E.with_metrics(slices.agg(*[F.sum(c).alias(c) for c in E.COUNTS]))
        left = pooled.select(F.lit(feature).alias("feature"), "accuracy", "recall", "precision")
        # one row on each side
        rows.append(
            left.join(F.broadcast(parity(slices)), "feature").withColumn("variant", F.lit(name))
        )
    table = reduce(DataFrame.unionByName, rows)
    best = table.agg(
        F.min_by("variant", F.struct("equalized_odds_difference", -F.col("accuracy"), "variant")).alias("chosen"),
        F.lit(feature).alias("feature"),
    )
    return table.join(F.broadcast(best), "feature").withColumn(
        "is_chosen", F.col("variant") == F.col("chosen")
    ).drop("chosen")
