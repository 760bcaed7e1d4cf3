"""Exploratory aggregates: counts, rates, distributions, patient flow."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cohortlake.functions import temporal as T
from cohortlake.operators.joins import null_safe
from cohortlake.operators.runs import exact_quantiles, sorted_runs


def missing_values(df: DataFrame) -> DataFrame:
    """Missing count and share per column, in one pass."""
    n = F.count(F.lit(1)).alias("_n")
    counts = df.agg(n, *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    long = counts.unpivot(["_n"], df.columns, "column", "n_missing")
    share = F.when(F.col("_n") > 0, F.col("n_missing") / F.col("_n").cast("double") * 100).otherwise(0.0)
    return long.select("column", "n_missing", share.alias("missing_pct"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Count and share per value.

    The total is a scalar over the grouped rows and shares their exchange: one scan, no
    global window.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / counts.agg(F.sum("n").cast("double")).scalar())


def top_categories(df: DataFrame, column: str, n: int) -> DataFrame:
    """Rows whose category is among the n most frequent."""
    top = value_counts(df, column).orderBy(F.col("n").desc(), column).limit(n).select(column)
    # at most n rows
    return df.join(F.broadcast(top), column, "left_semi")


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, std, min, exact quartiles and max per column."""
    long = df.select([F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], list(columns), "column", "v"
    )
    basic = long.groupBy("column").agg(
        F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"),
    )
    quartiles = exact_quantiles(long, ["column"], "v", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return basic.join(quartiles, "column", "left")


def group_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, exact median and count of a measure per group."""
    keys = list(keys)
    basic = df.groupBy(*keys).agg(
        F.avg(F.col(value).cast("double")).alias("mean"), F.count(value).alias("count")
    )
    medians = exact_quantiles(df, keys, value, {"median": 0.5})
    joined = basic.alias("b").join(medians.alias("m"), null_safe("b", "m", keys), "left")
    return joined.select(*[F.col(f"b.{k}") for k in keys], "mean", "median", "count")


def rate_by(df: DataFrame, keys: Sequence[str | Column], flag: str) -> DataFrame:
    """Events, rows and event rate in percent per group."""
    return df.groupBy(*keys).agg(
        F.sum(flag).cast("bigint").alias("events"),
        F.count(flag).alias("total"),
        (F.avg(F.col(flag).cast("double")) * 100).alias("rate_pct"),
    )


def crosstab_share(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Row-normalised cross-tabulation in percent, one column per value.

    The share is of all rows of a key, also of those whose value is not listed or NULL.
    """
    total = F.count(F.lit(1)).cast("double")
    return df.groupBy(row).agg(*[
        (F.count_if(F.col(column) == v) / total * 100).alias(v) for v in values
    ])


def correlations(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Pearson correlation of each column with the target, in one pass."""
    row = df.agg(
        *[F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(c) for c in columns]
    )
    return row.unpivot([], list(columns), "column", "correlation")


def quantile_cap(df: DataFrame, column: str, p: float = 0.95) -> DataFrame:
    """The exact p-quantile of a column."""
    return exact_quantiles(df, [], column, {"cap": p})


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Counts in equal-width bins between minimum and maximum."""
    v = F.col(column).cast("double")
    # one scan for both bounds, one for the counts
    bounds = df.agg(F.struct(F.min(v).alias("low"), F.max(v).alias("high"))).scalar()
    low, width = bounds["low"], bounds["high"] - bounds["low"]
    at = F.when(F.col("_w") > 0, F.floor((F.col("_v") - F.col("_l")) / F.col("_w") * bins)).otherwise(0)
    return (
        df.filter(v.isNotNull())
        .select(v.alias("_v"), low.alias("_l"), width.alias("_w"))
        .groupBy(F.least(at, F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def child_summary(children: DataFrame, key: str, flag: Column) -> DataFrame:
    """Number of child rows per parent and whether any is flagged."""
    return children.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_children"), F.bool_or(flag).cast("int").alias("any_flagged")
    )


def with_child_summary(parents: DataFrame, children: DataFrame, key: str, flag: Column) -> DataFrame:
    """Parents with their child summary, 0 without children."""
    return parents.join(child_summary(children, key, flag), key, "left").fillna(
        0, ["n_children", "any_flagged"]
    )


def share_of(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """Count and share in percent of rows that pass each test, in one pass."""
    counted = df.agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(t).alias(name) for name, t in tests.items()]
    )
    long = counted.unpivot(["_n"], list(tests), "test", "n")
    return long.select("test", "n", (F.col("n") / F.col("_n").cast("double") * 100).alias("pct"))


def _factor_rates(df: DataFrame, factors: Sequence[str], flag: str) -> DataFrame:
    # rows are summed per combination of factors first, then per factor
    cells = df.select(*[F.col(f).cast("string").alias(f) for f in factors], flag).groupBy(*factors).agg(
        F.sum(flag).alias("events"), F.count(flag).alias("total")
    )
    long = cells.unpivot(["events", "total"], list(factors), "factor", "level")
    return long.filter(F.col("level").isNotNull()).groupBy("factor", "level").agg(
        (F.sum("events") / F.sum("total").cast("double")).alias("rate")
    )


def effect_ranking(df: DataFrame, factors: Sequence[str], flag: str) -> DataFrame:
    """Rate gap between the levels of each factor, largest first."""
    return (
        _factor_rates(df, factors, flag)
        .groupBy("factor")
        .agg((F.max("rate") - F.min("rate")).alias("effect"))
        .orderBy(F.col("effect").desc(), "factor")
    )


def disparity(df: DataFrame, factors: Sequence[str], flag: str) -> DataFrame:
    """Levels of the highest and lowest rate and their ratio per factor."""
    top, low = F.max("rate"), F.min("rate")
    return _factor_rates(df, factors, flag).groupBy("factor").agg(
        F.max_by("level", F.struct("rate", "level")).alias("highest"),
        F.min_by("level", F.struct("rate", "level")).alias("lowest"),
        F.when(low > 0, top / low).alias("ratio"),
    )


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """Rows with a flag for keys that occur more than once."""
    counts = df.groupBy(key).agg((F.count(F.lit(1)) > 1).cast("int").alias("is_repeated"))
    return df.join(counts, key)


def readmissions(admissions: DataFrame, within_days: int = 30) -> DataFrame:
    """Days since the previous discharge of the same patient."""
    rows = admissions.select("subject_id", "hadm_id", "admittime", "dischtime")
    placed = sorted_runs(rows, ["subject_id", "admittime", "hadm_id"])
    paired = placed.shifted(["subject_id"], {"prev_discharge": "dischtime"}, 1)
    days = T.elapsed_days(F.col("prev_discharge"), F.col("admittime"))
    return paired.withColumn("days_to_readmission", days).withColumn(
        "is_early", F.coalesce(days <= within_days, F.lit(False)).cast("int")
    )


def unit_transitions(transfers: DataFrame, top: int | None = 10) -> DataFrame:
    """Most frequent moves from one unit to the next inside an admission."""
    rows = transfers.select("subject_id", "hadm_id", "intime", "transfer_id", "careunit")
    placed = sorted_runs(rows, ["subject_id", "hadm_id", "intime", "transfer_id", "careunit"])
    moves = placed.shifted(["subject_id", "hadm_id"], {"next_careunit": "careunit"}, -1)
    counts = (
        moves.filter(F.col("careunit").isNotNull() & F.col("next_careunit").isNotNull())
        .groupBy("careunit", "next_careunit")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ordered = counts.orderBy(F.col("n").desc(), "careunit", "next_careunit")
    return ordered.limit(top) if top else counts


def counts_in_order(df: DataFrame, value: Column, order: Sequence[str]) -> DataFrame:
    """Counts of the given values in the given order, 0 where absent."""
    counts = df.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    wanted = df.sparkSession.createDataFrame(
        [(i, v) for i, v in enumerate(order)], "position int, value string"
    )
    return (
        wanted.join(counts, "value", "left")
        .select("position", "value", F.coalesce("n", F.lit(0)).alias("n"))
        .orderBy("position")
    )


def children_per_parent(parents: DataFrame, children: DataFrame) -> DataFrame:
    """Average number of children per parent from two counts."""
    tagged = parents.select(F.lit(1).alias("p"), F.lit(0).alias("c")).unionByName(
        children.select(F.lit(0).alias("p"), F.lit(1).alias("c"))
    )
    return tagged.agg(F.sum("p").alias("n_parents"), F.sum("c").alias("n_children")).withColumn(
        "average", F.when(F.col("n_parents") > 0, F.col("n_children") / F.col("n_parents").cast("double"))
    )


def ranked_runs(runs: DataFrame, metric: str, baseline_id: int) -> DataFrame:
    """Runs in metric order with rank and baseline marker."""
    placed = sorted_runs(runs, [F.col(metric).desc(), "run_id"]).numbered("rank")
    return placed.withColumn("is_baseline", F.col("run_id") == baseline_id)
