"""Classification metrics, ranking metrics and curves over scored rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cohortlake.functions.scalars import safe_ratio
from cohortlake.operators.joins import join_small
from cohortlake.operators.runs import sorted_runs

COUNTS = ["tp", "fp", "fn", "tn"]


def scored(df: DataFrame, score: str = "score") -> DataFrame:
    """The rows that have a score: a row without one is neither positive nor negative, and in no bin."""
    return df.filter(F.col(score).isNotNull())


def confusion_counts(
    threshold: float | Column = 0.5, label: str = "y_true", score: str = "score"
) -> list[Column]:
    """The four confusion counts as aggregates."""
    positive = F.col(score) >= threshold
    actual = F.col(label) == 1
    return [
        F.count_if(positive & actual).alias("tp"),
        F.count_if(positive & ~actual).alias("fp"),
        F.count_if(~positive & actual).alias("fn"),
        F.count_if(~positive & ~actual).alias("tn"),
    ]


def with_metrics(df: DataFrame) -> DataFrame:
    """Ratios over confusion counts, 0 where undefined."""
    tp, fp, fn, tn = (F.col(c) for c in COUNTS)
    n = tp + fp + fn + tn
    return df.select(
        "*",
        n.alias("n"),
        safe_ratio(tp + tn, n).alias("accuracy"),
        safe_ratio(tp, tp + fp).alias("precision"),
        safe_ratio(tp, tp + fn).alias("recall"),
        safe_ratio(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
        safe_ratio(tn, tn + fp).alias("specificity"),
        safe_ratio(tn, tn + fn).alias("npv"),
        safe_ratio(tp + fn, n).alias("prevalence"),
    )


def classification_metrics(
    df: DataFrame, by: Sequence[str] = (), threshold: float = 0.5
) -> DataFrame:
    return with_metrics(df.groupBy(*by).agg(*confusion_counts(threshold)))


def site_and_pooled_metrics(df: DataFrame, site: str = "site", threshold: float = 0.5) -> DataFrame:
    """Metrics per site and pooled in one pass; the pooled row is named AGGREGATED."""
    sets = df.groupingSets([[site], []], site).agg(
        F.grouping(site).alias("_pooled"), *confusion_counts(threshold)
    )
    name = F.when(F.col("_pooled") == 1, "AGGREGATED").otherwise(F.col(site))
    return with_metrics(sets.withColumn(site, name).drop("_pooled"))


def score_points(
    df: DataFrame, by: Sequence[str] = (), label: str = "y_true", score: str = "score"
) -> DataFrame:
    """Positives and negatives per distinct score."""
    return df.groupBy(*by, F.col(score).alias("threshold")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")
    )


def curve(
    df: DataFrame, by: Sequence[str] = (), label: str = "y_true", score: str = "score"
) -> DataFrame:
    """Cumulative counts at every distinct threshold, ties kept together.

    Columns: by, threshold, pos, neg, tp, fp, p, n. Rows are reduced to distinct scores
    first; the ordered sum runs over balanced runs, whatever the number of scores.
    """
    by = list(by)
    points = score_points(df, by, label, score)
    runs = sorted_runs(points, [*by, F.col("threshold").desc()])
    placed = runs.running(by, {"tp": F.col("pos"), "fp": F.col("neg")})
    totals = runs.rows.groupBy(*by).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    if by:
        return join_small(placed, totals, by)
    total = totals.first()  # two numbers
    return placed.withColumn("p", F.lit(total["p"] or 0)).withColumn("n", F.lit(total["n"] or 0))


def ranking_metrics(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Exact ROC AUC and average precision from a curve."""
    tp, fp, pos, neg = (F.col(c).cast("double") for c in ("tp", "fp", "pos", "neg"))
    p, n = F.max("p").cast("double"), F.max("n").cast("double")
    area = F.sum(neg * (tp - pos / 2))
    return points.groupBy(*by).agg(
        F.when(p * n > 0, area / (p * n)).alias("roc_auc"),
        F.when(p > 0, F.sum(pos * (tp / (tp + fp))) / p).alias("average_precision"),
    )


def roc_points(points: DataFrame) -> DataFrame:
    """False and true positive rate at every threshold."""
    return points.withColumn("fpr", safe_ratio(F.col("fp"), F.col("n"))).withColumn(
        "tpr", safe_ratio(F.col("tp"), F.col("p"))
    )


def pr_points(points: DataFrame) -> DataFrame:
    """Precision and recall at every threshold."""
    return points.withColumn(
        "precision", safe_ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    ).withColumn("recall", safe_ratio(F.col("tp"), F.col("p")))


def calibration(df: DataFrame, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Mean score and observed rate in uniform right-closed score bins (A42); empty bins are absent.

    Rows without a score are left out.
    """
    df = scored(df)
    last = F.lit(bins - 1)
    index = F.greatest(F.lit(0), F.least(last, F.ceil(F.col("score") * bins) - 1)).cast("int")
    return df.groupBy(*by, index.alias("bin")).agg(
        F.avg("score").alias("mean_score"),
        F.avg(F.col("y_true").cast("double")).alias("observed_rate"),
        F.count(F.lit(1)).alias("n"),
    )


def melt_metrics(df: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Wide metrics to (metric, value) rows."""
    return df.unpivot(list(ids), list(metrics), "metric", "value")


def accuracy_by_class(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Share of correct rows per true class (A66), over the rows with a score."""
    df = scored(df)
    right = (F.col("score") >= threshold).cast("int") == F.col("y_true")
    return df.groupBy("y_true").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(right).alias("n_correct"),
        F.avg(right.cast("double")).alias("accuracy"),
    )


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Class counts and imbalance ratio."""
    return df.agg(
        F.count_if(F.col(label) == 0).alias("n_negative"),
        F.count_if(F.col(label) == 1).alias("n_positive"),
    ).withColumn("imbalance_ratio", safe_ratio(F.col("n_negative"), F.col("n_positive")))


def class_weights(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Balanced class weights n / (k * n_c)."""
    from pyspark.sql import Window

    counts = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n_class"))
    # one row per class: bounded by the number of classes
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    n, k = F.sum("n_class").over(group), F.count(F.lit(1)).over(group)
    return counts.withColumn("weight", n.cast("double") / (k * F.col("n_class")))


def brier(df: DataFrame, limit: float = 0.15, by: Sequence[str] = ()) -> DataFrame:
    """Brier score and calibration gate (Q10)."""
    gap = F.col("score") - F.col("y_true")
    return df.groupBy(*by).agg(F.avg(gap * gap).alias("brier")).withColumn(
        "passed", F.col("brier") < limit
    )
