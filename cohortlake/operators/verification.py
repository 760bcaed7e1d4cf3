"""Leakage checks, dataset statistics, integrity gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cohortlake.functions import vocabulary as V
from cohortlake.functions.scalars import safe_ratio


def split_overlap(df: DataFrame, key: str = "subject_id", site: str = "assigned_hospital") -> DataFrame:
    """Patients per split and overlaps between splits, per site.

    Rows are first reduced to one per (site, key) with three membership flags; no
    self-join is needed.
    """
    def member(split: str) -> Column:
        return F.bool_or(F.col("data_split") == split).alias(split)

    flags = df.groupBy(site, key).agg(*[member(s) for s in V.SPLITS])
    train, val, test = (F.col(s) for s in V.SPLITS)
    return flags.groupBy(F.col(site).alias("hospital")).agg(
        F.count_if(train).alias("train_patients"),
        F.count_if(val).alias("val_patients"),
        F.count_if(test).alias("test_patients"),
        F.count_if(train & val).alias("train_val_overlap"),
        F.count_if(train & test).alias("train_test_overlap"),
        F.count_if(val & test).alias("val_test_overlap"),
    )


def site_overlap(df: DataFrame, key: str = "subject_id", site: str = "assigned_hospital") -> DataFrame:
    """Keys seen at more than one site, per pair of sites."""
    member = [F.bool_or(F.col(site) == s).alias(s) for s in V.SITES]
    flags = df.groupBy(key).agg(*member)
    pairs = [(a, b) for i, a in enumerate(V.SITES) for b in V.SITES[i + 1:]]
    counted = flags.agg(
        *[F.count_if(F.col(a) & F.col(b)).alias(f"{a}|{b}") for a, b in pairs]
    )
    long = counted.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "overlap")
    return long.select(
        F.split_part("pair", F.lit("|"), F.lit(1)).alias("site_1"),
        F.split_part("pair", F.lit("|"), F.lit(2)).alias("site_2"),
        "overlap",
    )


def integrity_gate(overlaps: DataFrame) -> DataFrame:
    """Sum of all overlaps and whether it is zero (Q07)."""
    total = F.sum(
        F.col("train_val_overlap") + F.col("train_test_overlap") + F.col("val_test_overlap")
    )
    return overlaps.agg(F.coalesce(total, F.lit(0)).alias("total_overlap")).withColumn(
        "passed", (F.col("total_overlap") == 0)
    )


def require_integrity(overlaps: DataFrame) -> None:
    """Raise when a patient is in more than one split (Q07)."""
    row = integrity_gate(overlaps).first()
    if not row["passed"]:
        raise ValueError(f"data leakage: {row['total_overlap']} overlapping patients")


def dataset_statistics(df: DataFrame) -> DataFrame:
    """Stays, patients, deaths and means per site and split."""
    return df.groupBy(F.col("assigned_hospital").alias("hospital"), "data_split").agg(
        F.count(F.lit(1)).alias("n_icu_stays"),
        F.countDistinct("subject_id").alias("n_patients"),
        F.sum("icu_mortality_label").alias("n_deaths"),
        F.round(F.avg("icu_mortality_label"), 4).alias("mortality_rate"),
        F.round(F.avg("age_at_admission"), 1).alias("mean_age"),
        F.round(F.avg("los_icu_hours"), 1).alias("mean_icu_los_hours"),
    )


def network_statistics(stats: DataFrame, weighted: bool = False) -> DataFrame:
    """Totals per site, per split, per cell and overall (A10).

    ``weighted=False`` averages the cell averages; ``True`` weights cells by stays.
    """
    def mean(column: str, digits: int) -> Column:
        if weighted:
            value = F.sum(F.col(column) * F.col("n_icu_stays")) / F.sum("n_icu_stays")
        else:
            value = F.avg(column)
        return F.round(value, digits)

    sets = stats.groupingSets(
        [["hospital", "data_split"], ["hospital"], ["data_split"], []], "hospital", "data_split"
    )
    level = (
        F.when(F.grouping("hospital") + F.grouping("data_split") == 2, "network")
        .when(F.grouping("data_split") == 1, "site")
        .when(F.grouping("hospital") == 1, "split")
        .otherwise("cell")
    )
    return sets.agg(
        level.alias("level"),
        F.sum("n_patients").alias("total_patients"),
        F.sum("n_deaths").alias("total_deaths"),
        mean("mortality_rate", 4).alias("avg_mortality_rate"),
        mean("mean_age", 1).alias("avg_age"),
        mean("mean_icu_los_hours", 1).alias("avg_icu_los_hours"),
    ).withColumn(
        "overall_mortality_rate",
        F.round(safe_ratio(F.col("total_deaths"), F.col("total_patients")), 4),
    )
