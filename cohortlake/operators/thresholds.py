"""Decision threshold search."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlake.functions.scalars import safe_ratio
from cohortlake.operators import evaluate as E

# fixed values: method names, grids and scenario assignment
YOUDEN, F1, RECALL_85, RECALL_80, COST, CURRENT = (
    "Youden Index", "F1 Maximum", "Target Recall 85%", "Target Recall 80%",
    "Cost-Sensitive (10:1)", "Current (0.5)",
)
SWEEP = (0.05, 0.95, 100)
COST_GRID = (0.1, 0.9, 100)
SCENARIOS = {"screening": RECALL_85, "balanced": YOUDEN, "specific": F1, "current": CURRENT}
# end of fixed values


def grid_value(i: Column, low: float, high: float, count: int) -> Column:
    """The i-th of ``count`` evenly spaced values, i from 0."""
    return F.lit(low) + i.cast("double") * F.lit((high - low) / (count - 1))


def _passed(score: Column, low: float, high: float, count: int) -> Column:
    """How many grid values are <= score, exact at the grid values."""
    guess = F.floor((score - low) / ((high - low) / (count - 1)))

    def at(i):
        return grid_value(i, low, high, count)

    i = guess + F.when(at(guess + 1) <= score, 1).when(at(guess) > score, -1).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(count), i + 1)).cast("int")


def sweep(
    df: DataFrame, grid: tuple[float, float, int] = SWEEP, by: Sequence[str] = ()
) -> DataFrame:
    """Confusion counts and metrics at every grid threshold.

    Each row is counted once, in the grid cell of its score; thresholds are suffix sums
    over at most ``count + 1`` cells per group. Rows without a score are left out.
    """
    df = E.scored(df)
    by = list(by)
    count = grid[2]
    cells = df.groupBy(*by, _passed(F.col("score"), *grid).alias("cell")).agg(
        F.count_if(F.col("y_true") == 1).alias("pos"), F.count_if(F.col("y_true") != 1).alias("neg")
    )
    every = F.explode(F.sequence(F.lit(0), F.lit(count))).alias("cell")
    zero = F.lit(0).cast("bigint")
    groups = cells.select(*by).distinct() if by else cells.agg(F.count(F.lit(1)).alias("_n"))
    blank = groups.select(*by, every).withColumn("pos", zero).withColumn("neg", zero)
    full = cells.unionByName(blank).groupBy(*by, "cell").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
    # at most count + 1 rows per group
    keys = by or [F.lit(1)]
    above = Window.partitionBy(*keys).orderBy(F.col("cell").desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    whole = Window.partitionBy(*keys)
    counted = (
        full.withColumn("tp", F.sum("pos").over(above))
        .withColumn("fp", F.sum("neg").over(above))
        .withColumn("fn", F.sum("pos").over(whole) - F.col("tp"))
        .withColumn("tn", F.sum("neg").over(whole) - F.col("fp"))
        .filter(F.col("cell") > 0)
        .withColumn("threshold", grid_value(F.col("cell") - 1, *grid))
    )
    return E.with_metrics(counted.select(*by, "threshold", *E.COUNTS))


def _youden() -> Column:
    return F.col("tpr") - F.col("fpr")


def _f1() -> Column:
    p, r = F.col("precision"), F.col("recall")
    return 2 * (p * r) / (p + r + F.lit(1e-10))


def _youden_pick() -> Column:
    """Threshold of the largest TPR - FPR, the highest on ties."""
    return F.max_by("threshold", F.struct(_youden(), F.col("threshold")))


def _f1_pick() -> Column:
    """Threshold of the largest F1, the lowest on ties."""
    return F.max_by("threshold", F.struct(_f1(), -F.col("threshold")))


def _recall_order(target: float) -> Column:
    """Distance of the recall from a target, the lowest threshold first on ties."""
    return F.struct(F.abs(F.col("recall") - F.lit(target)), F.col("threshold"))


def best_youden(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Threshold that maximises Youden's index."""
    return E.roc_points(points).groupBy(*by).agg(
        _youden_pick().alias("threshold"), F.max(_youden()).alias("youden_j")
    )


def best_f1(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Threshold that maximises F1."""
    return E.pr_points(points).groupBy(*by).agg(_f1_pick().alias("threshold"), F.max(_f1()).alias("f1"))


def nearest_recall(points: DataFrame, target: float, by: Sequence[str] = ()) -> DataFrame:
    """Threshold whose recall is nearest to a target."""
    order = _recall_order(target)
    return E.pr_points(points).groupBy(*by).agg(
        F.min_by("threshold", order).alias("threshold"), F.min_by("recall", order).alias("recall")
    )


def cheapest(
    df: DataFrame, fn_cost: float = 10, fp_cost: float = 1,
    grid: tuple[float, float, int] = COST_GRID, by: Sequence[str] = (),
) -> DataFrame:
    """Grid threshold of the lowest cost, the lowest on ties."""
    cost = F.col("fn") * F.lit(fn_cost) + F.col("fp") * F.lit(fp_cost)
    return sweep(df, grid, by).groupBy(*by).agg(
        F.min_by("threshold", F.struct(cost, F.col("threshold"))).alias("threshold"),
        F.min(cost).cast("bigint").alias("cost"),
    )


def optimal_thresholds(df: DataFrame) -> dict[str, float]:
    """The threshold of every method; one pass over the curve and one over the grid.

    Six numbers reach the driver.
    """
    picks = E.pr_points(E.roc_points(E.curve(df))).agg(
        _youden_pick().alias("youden"),
        _f1_pick().alias("f1"),
        F.min_by("threshold", _recall_order(0.85)).alias("r85"),
        F.min_by("threshold", _recall_order(0.80)).alias("r80"),
    ).first()
    return {
        YOUDEN: picks["youden"],
        F1: picks["f1"],
        RECALL_85: picks["r85"],
        RECALL_80: picks["r80"],
        COST: cheapest(df).first()["threshold"],
        CURRENT: 0.5,
    }


def evaluate_thresholds(df: DataFrame, methods: Mapping[str, float]) -> DataFrame:
    """Metrics of several thresholds in one pass, one row per method."""
    aggs, rows = [], []
    for i, (method, threshold) in enumerate(methods.items()):
        names = [f"{c}_{i}" for c in E.COUNTS]
        aggs += [c.alias(n) for c, n in zip(E.confusion_counts(threshold), names)]
        rows.append(
            F.struct(
                F.lit(method).alias("method"),
                F.lit(float(threshold)).alias("threshold"),
                *[F.col(n).alias(c) for c, n in zip(E.COUNTS, names)],
            )
        )
    long = df.agg(*aggs).select(F.inline(F.array(*rows)))
    return (
        E.with_metrics(long)
        .withColumn("total_deaths", F.col("tp") + F.col("fn"))
        .withColumn("deaths_caught", F.col("tp"))
        .withColumn("deaths_missed", F.col("fn"))
    )


def recommend(results: DataFrame) -> DataFrame:
    """Result row of each clinical scenario."""
    scenario = None
    for name, method in SCENARIOS.items():
        test = F.col("method") == method
        scenario = F.when(test, name) if scenario is None else scenario.when(test, name)
    return results.withColumn("scenario", scenario).filter(F.col("scenario").isNotNull())


def missed_share(results: DataFrame) -> DataFrame:
    return results.withColumn(
        "missed_share", safe_ratio(F.col("deaths_missed"), F.col("total_deaths"))
    )
