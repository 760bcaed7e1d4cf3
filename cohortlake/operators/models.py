"""Models on tables: linear scoring, forest, over-sampling, federated training, sensitivity."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cohortlake.functions.scalars import hash_unit
from cohortlake.operators import evaluate as E
from cohortlake.operators.neighbours import nearest
from cohortlake.operators.runs import POS, ROW, RUN, sorted_runs
from cohortlake.session import materialise


# ---- scoring --------------------------------------------------------------------------


def linear_score(weights: Mapping[str, float], bias: float) -> Column:
    """Logistic score of a weighted sum of columns."""
    z = F.lit(float(bias))
    for name, weight in weights.items():
        z = z + F.col(name) * F.lit(float(weight))
    return 1.0 / (1.0 + F.exp(-z))


def score_rows(df: DataFrame, weights: Mapping[str, float], bias: float, threshold: float = 0.5) -> DataFrame:
    """Rows with score and class."""
    return df.withColumn("score", linear_score(weights, bias)).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )


def linear_attribution(df: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """Mean absolute contribution |w * (x - mean)| per feature of a linear score."""
    names = list(weights)
    means = df.agg(*[F.avg(F.col(n).cast("double")).alias(n) for n in names]).agg(
        F.first(F.struct(*names))
    ).scalar()
    rows = df.select(*names, means.alias("_mean"))
    out = rows.agg(
        *[F.avg(F.abs(F.lit(float(weights[n])) * (F.col(n) - F.col(f"_mean.{n}")))).alias(n) for n in names]
    )
    return out.unpivot([], names, "feature", "mean_abs_attribution")


# ---- experiment runs ----------------------------------------------------------------------


def _run_values(runs: DataFrame, params: Sequence[str], metric: str) -> DataFrame:
    text = runs.select(*[F.col(p).cast("string").alias(p) for p in params], metric)
    return text.unpivot([metric], list(params), "param", "value").filter(
        F.col("value").isNotNull() & F.col(metric).isNotNull()
    )


def sensitivity(runs: DataFrame, params: Sequence[str], metric: str, mode: str = "means") -> DataFrame:
    """Effect of each parameter that has two or more values, largest first.

    ``mode='means'`` is the range of the group means; ``mode='extremes'`` the largest
    maximum minus the smallest minimum.
    """
    groups = _run_values(runs, params, metric).groupBy("param", "value").agg(
        F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"),
        F.count(F.lit(1)).alias("count"), F.min(metric).alias("min"), F.max(metric).alias("max"),
    )
    high, low = ("mean", "mean") if mode == "means" else ("max", "min")
    return (
        groups.groupBy("param")
        .agg(
            F.min(low).alias("min_metric"),
            F.max(high).alias("max_metric"),
            (F.max(high) - F.min(low)).alias("effect_range"),
            F.count(F.lit(1)).alias("n_values"),
        )
        .filter(F.col("n_values") >= 2)
        .orderBy(F.col("effect_range").desc(), "param")
    )


# ---- weight averaging and federated training ------------------------------------------------


def average_weights(updates: DataFrame, by: Sequence[str] = ("round",)) -> DataFrame:
    """Weighted average of parameter vectors, position by position.

    The sums combine map-side per (round, position); only the averaged vector, as long
    as one input vector, is put together at the end.
    """
    by = list(by)
    parts = updates.select(*by, "n_examples", F.posexplode("weights").alias("pos", "w"))
    sums = parts.groupBy(*by, "pos").agg(
        (F.sum(F.col("n_examples") * F.col("w")) / F.sum("n_examples")).alias("w"),
        F.sum("n_examples").alias("n_examples"),
    )
    return sums.groupBy(*by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda x: x["w"]).alias("weights"),
        F.max("n_examples").alias("n_examples"),
    )


def train_federated(
    df: DataFrame, features: Sequence[str], label: str, site: str = "site",
    rounds: int = 2, local_epochs: int = 2, rate: float = 0.5, balanced: bool = True,
) -> DataFrame:
    """Federated logistic regression by site-local full-batch gradient steps.

    The feature rows are stored once. Every step is one grouped aggregate over them, with
    the sites' parameters joined as a table of one row per site; what reaches the driver is
    one gradient per site. Rows without a site or label teach nothing. Returns one row per round with the averaged
    weights (bias last), the examples and the loss before the round.
    """
    names, width = list(features), len(features) + 1
    x = F.array(*[F.col(n).cast("double") for n in names], F.lit(1.0))
    rows = materialise(
        df.select(F.col(site).alias("_site"), F.col(label).cast("double").alias("_y"), x.alias("_x"))
        .filter(F.col("_site").isNotNull() & F.col("_y").isNotNull())
    )
    counts = {
        r["_site"]: (r["n"], r["p"])
        for r in rows.groupBy("_site").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("p")).collect()
    }
    sites = sorted(counts)

    def weight_of(site_name: str, y: int) -> float:
        n, p = counts[site_name]
        size = p if y else n - p
        return n / (2.0 * size) if balanced and size else 1.0

    importance = F.when(F.col("_y") == 1, F.col("_i1")).otherwise(F.col("_i0"))
    kind = dict(df.dtypes)[site]

    def step(current: Mapping[str, list[float]]) -> dict[str, tuple[list[float], float]]:
        # one row per site
        parameters = df.sparkSession.createDataFrame(
            [(s, weight_of(s, 0), weight_of(s, 1), current[s]) for s in sites],
            f"_site {kind}, _i0 double, _i1 double, _w array<double>",
        )
        dot = F.aggregate(
            F.zip_with(F.col("_x"), F.col("_w"), lambda a, w: a * w), F.lit(0.0), lambda acc, v: acc + v
        )
        scored = rows.join(F.broadcast(parameters), "_site").withColumn(
            "_p", 1.0 / (1.0 + F.exp(-dot))).withColumn("_i", importance)
        error = F.col("_i") * (F.col("_p") - F.col("_y"))
        safe = F.greatest(F.lit(1e-12), F.when(F.col("_y") == 1, F.col("_p")).otherwise(1 - F.col("_p")))
        found = scored.groupBy("_site").agg(
            *[F.avg(error * F.col("_x")[i]).alias(f"g{i}") for i in range(width)],
            F.avg(-F.col("_i") * F.log(safe)).alias("loss"),
        ).collect()
        return {r["_site"]: ([r[f"g{i}"] for i in range(width)], r["loss"]) for r in found}

    shared, history = [0.0] * width, []
    total = sum(n for n, _ in counts.values())
    for number in range(rounds):
        local = {s: list(shared) for s in sites}
        first_loss = None
        for _ in range(local_epochs):
            gradients = step(local)
            if first_loss is None:
                first_loss = sum(counts[s][0] * gradients[s][1] for s in sites) / total
            local = {s: [w - rate * g for w, g in zip(local[s], gradients[s][0])] for s in sites}
        shared = [sum(counts[s][0] * local[s][i] for s in sites) / total for i in range(width)]
        history.append((number, total, float(first_loss), shared))
    return df.sparkSession.createDataFrame(
        history, "round int, n_examples bigint, loss double, weights array<double>"
    )


# ---- forest ---------------------------------------------------------------------------------


def fit_forest(
    df: DataFrame, features: Sequence[str], label: str, trees: int = 100, depth: int = 5, seed: int = 42
):
    """Class-weighted random forest (M10); returns the fitted model and its vector assembler."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    weights = E.class_weights(df, label).select(label, F.col("weight").alias("_weight"))
    assembler = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="error")
    # one row per class
    rows = assembler.transform(df.join(F.broadcast(weights), label))
    forest = RandomForestClassifier(
        featuresCol="_features", labelCol=label, weightCol="_weight",
        numTrees=trees, maxDepth=depth, seed=seed,
    )
    return forest.fit(rows), assembler


def forest_importances(df: DataFrame, features: Sequence[str], label: str, **options) -> DataFrame:
    """Feature importances of a fitted forest."""
    model, _ = fit_forest(df, features, label, **options)
    rows = [(n, float(v)) for n, v in zip(features, model.featureImportances.toArray())]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(
        F.col("importance").desc(), "feature"
    )


# ---- over-sampling ----------------------------------------------------------------------------


def oversample(
    df: DataFrame, features: Sequence[str], label: str, key: str, k: int = 5, seed: int = 42, **search
) -> DataFrame:
    """Minority rows plus synthetic ones until the classes are even.

    A synthetic row lies between a minority row and one of its k nearest, drawn by a hash of
    its key and copy number. ``search`` goes to ``neighbours.nearest``. Keys are unique; rows of
    the minority that lack a feature are refused. A lone minority row is copied.
    """
    names = list(features)
    balance = df.agg(
        F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"),
    ).first()
    minority, n_min = (1, balance["p"]) if balance["p"] <= balance["n"] else (0, balance["n"])
    needed = abs(balance["p"] - balance["n"])
    rows = df.select(F.col(key).cast("string").alias(key), *[F.col(c).cast("double").alias(c) for c in names], label)
    kept = rows.withColumn("is_synthetic", F.lit(False))
    if n_min == 0 or needed == 0:
        return kept
    small = rows.filter(F.col(label) == minority)
    near = nearest(small, names, key, k, seed=seed, **search)
    # the copies of a row follow from its position, so their total is exactly ``needed``
    placed = sorted_runs(small, [key]).rows.drop(RUN, ROW)
    share = lambda p: F.floor(p * F.lit(needed) / F.lit(n_min))
    copies = (share(F.col(POS) + 1) - share(F.col(POS))).cast("int")
    made = placed.withColumn("_copies", copies).filter(F.col("_copies") > 0).join(near, key).withColumn(
        "_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    tag = F.concat_ws("#", F.col(key), F.col("_copy").cast("string"))
    drawn = F.floor(hash_unit(tag, f"{seed}k") * F.size("near")).cast("int")
    made = made.withColumn("_u", hash_unit(tag, f"{seed}u")).withColumn(
        "_to", F.coalesce(F.get("near", drawn)["key"], F.col(key)))
    other = small.select(F.col(key).alias("_to"), *[F.col(c).alias(f"_b_{c}") for c in names])
    synthetic = made.join(other, "_to").select(
        tag.alias(key),
        *[(F.col(c) + F.col("_u") * (F.col(f"_b_{c}") - F.col(c))).alias(c) for c in names],
        F.lit(minority).cast(df.schema[label].dataType).alias(label),
        F.lit(True).alias("is_synthetic"),
    )
    return kept.unionByName(synthetic)


def log_loss(scored: DataFrame) -> float:
    """Mean log loss of scored rows."""
    p = F.greatest(F.lit(1e-12), F.when(F.col("y_true") == 1, F.col("score")).otherwise(1 - F.col("score")))
    value = scored.agg(F.avg(-F.log(p)).alias("loss")).first()["loss"]
    return math.nan if value is None else float(value)
