"""Model monitoring: daily performance, decisions, gates, shift measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlake.functions.scalars import safe_ratio
from cohortlake.operators import evaluate as E
from cohortlake.operators.runs import sorted_runs

ACCURACY_LIMIT, RECALL_LIMIT = 0.85, 0.70


def daily_performance(df: DataFrame, by: Sequence[str] = (), ts: str = "scored_at") -> DataFrame:
    """Confusion counts and metrics per day."""
    counted = df.groupBy(F.to_date(ts).alias("day"), *by).agg(*E.confusion_counts())
    return E.with_metrics(counted).select(
        "day", *by, F.col("n").alias("samples_tested"), "accuracy", "recall", "precision", *E.COUNTS
    )


def _percent(value: Column) -> Column:
    """Percent with two digits; an exact tie (an odd number of eighths) goes to the even digit."""
    pct = value * 100
    even = F.when(F.pmod(pct * 8, F.lit(2.0)) == 1, F.bround(pct, 2)).otherwise(pct)
    return F.concat(F.format_string("%.2f", even), F.lit("%"))


def retrain_decision(
    metrics: DataFrame, accuracy: float = ACCURACY_LIMIT, recall: float = RECALL_LIMIT
) -> DataFrame:
    """Reasons to retrain and the decision."""
    def reason(column: str, label: str, limit: float) -> Column:
        text = F.concat(
            F.lit(f"{label} ("), _percent(F.col(column)), F.lit(f") < {limit * 100:.2f}%")
        )
        return F.when(F.col(column) < limit, text)

    reasons = F.array_compact(
        F.array(reason("accuracy", "Accuracy", accuracy), reason("recall", "Recall", recall))
    )
    return metrics.withColumn("reasons", F.array_join(reasons, "; ")).withColumn(
        "needs_retraining", F.size(reasons) > 0
    )


def degradation(history: DataFrame, ts: str = "day") -> DataFrame:
    """Latest performance against the historical mean, in one pass."""
    used = history.filter(F.col("samples_tested") > 0)
    row = used.agg(
        F.max_by("accuracy", ts).alias("current_accuracy"),
        F.max_by("recall", ts).alias("_recall"),
        F.avg("accuracy").alias("baseline_accuracy"),
    )
    status = (
        F.when(
            (F.col("current_accuracy") < ACCURACY_LIMIT) | (F.col("_recall") < RECALL_LIMIT),
            "RETRAINING NEEDED",
        )
        .when(F.col("current_accuracy") < F.col("baseline_accuracy") - 0.02, "DEGRADATION DETECTED")
        .otherwise("OK")
    )
    return row.select(
        "current_accuracy",
        "baseline_accuracy",
        (F.col("current_accuracy") - F.col("baseline_accuracy")).alias("accuracy_diff"),
        status.alias("status"),
    )


def quality_gate(metrics: DataFrame, accuracy: float = ACCURACY_LIMIT, recall: float = RECALL_LIMIT) -> DataFrame:
    """Whether metrics reach the minimum."""
    return metrics.withColumn(
        "gate_passed", (F.col("accuracy") >= accuracy) & (F.col("recall") >= recall)
    )


def regression_gate(runs: DataFrame, ts: str = "finished_at", tolerance: float = 0.02) -> DataFrame:
    """Each run against the one before it."""
    ordered = sorted_runs(runs, [ts, "run_id"])
    paired = ordered.shifted([], {"previous_accuracy": "accuracy"}, 1)
    return paired.withColumn(
        "regressed",
        F.coalesce(F.col("accuracy") < F.col("previous_accuracy") - tolerance, F.lit(False)),
    )


def rolling_accuracy(history: DataFrame, days: int = 7, limit: float = 0.80, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy over the last ``days`` days.

    Runs on daily counts: one row per day and group, so a group is bounded by the
    length of the calendar.
    """
    keys = list(by) or [F.lit(1)]
    window = Window.partitionBy(*keys).orderBy(F.unix_date("day")).rangeBetween(-(days - 1), 0)
    right = F.sum(F.col("tp") + F.col("tn")).over(window)
    total = F.sum("samples_tested").over(window)
    return history.select(
        "day", *by, safe_ratio(right, total).alias("rolling_accuracy")
    ).withColumn("alert", F.col("rolling_accuracy") < limit)


def distribution_shift(
    current: DataFrame, baseline: DataFrame, bins: int = 10, limit: float = 0.1
) -> DataFrame:
    """KL divergence of two score distributions over uniform bins (Q08).

    Counts get one added per bin, so empty bins stay finite. Rows without a score are left out.
    """
    bucket = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")

    def counted(df: DataFrame, p: int) -> DataFrame:
        return E.scored(df).select(bucket.alias("bin"), F.lit(p).alias("p"), F.lit(1 - p).alias("q"))

    every = current.agg(F.count(F.lit(1)).alias("_n")).select(
        F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"),
        F.lit(1).alias("p"), F.lit(1).alias("q"),
    )
    hist = (
        counted(current, 1).unionByName(counted(baseline, 0)).unionByName(every)
        .groupBy("bin").agg(F.sum("p").cast("double").alias("p"), F.sum("q").cast("double").alias("q"))
    )
    # one row per bin
    total = Window.partitionBy(F.lit(1))
    shares = hist.select(
        (F.col("p") / F.sum("p").over(total)).alias("p"), (F.col("q") / F.sum("q").over(total)).alias("q")
    )
    return shares.agg(F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))).alias("kl")).withColumn(
        "retrain", F.col("kl") > limit
    )


def round_metrics(clients: DataFrame) -> DataFrame:
    """Metrics of a federated round, clients weighted by examples."""
    def mean(c: str) -> Column:
        return F.sum(F.col(c) * F.col("n_examples")) / F.sum("n_examples")

    rolled = clients.groupBy("round").agg(
        F.count(F.lit(1)).alias("n_clients"),
        F.sum("n_examples").alias("n_examples"),
        mean("precision").alias("precision"),
        mean("recall").alias("recall"),
    )
    p, r = F.col("precision"), F.col("recall")
    return rolled.withColumn("f1", safe_ratio(2 * p * r, p + r))
