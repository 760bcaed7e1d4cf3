"""Cohort queries over stay rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from cohortlake.functions import clinical as C, generalise as G, terms, vocabulary as V
from cohortlake.functions.scalars import safe_ratio
from cohortlake.operators.joins import join_small, null_safe
from cohortlake.session import materialise


def all_of(*tests: Column | None) -> Column:
    """Conjunction of the tests that are given."""
    given = [t for t in tests if t is not None]
    return reduce(lambda a, b: a & b, given, F.lit(True))


def optional(column: str, low=None, high=None, equals=None, among: Sequence | None = None) -> Column | None:
    """Test for whichever bounds are given."""
    c = F.col(column)
    tests = [
        None if low is None else c >= low,
        None if high is None else c <= high,
        None if equals is None else c == equals,
        None if among is None else c.isin(list(among)),
    ]
    given = [t for t in tests if t is not None]
    return all_of(*given) if given else None


def restrict_types(column: str, values: Sequence[str], everything: Sequence[str]) -> Column | None:
    """Membership test, left out when every type is meant."""
    return None if set(values) >= set(everything) else F.col(column).isin(list(values))


def rate(flag: str, value: int) -> Column:
    """Share of rows whose flag has a value; NULL counts as no."""
    return F.avg(F.when(F.col(flag) == value, F.lit(1.0)).otherwise(F.lit(0.0)))


def known_rows() -> Column:
    """Rows usable for look-ups: test rows stay hidden."""
    return F.col("data_split").isin("train", "validation")


def similar_cases(
    stays: DataFrame, age: int, admission_types: Sequence[str], early_score: int,
    icu_types: Sequence[str] = tuple(V.ICU_TYPES), tolerance: int = 5,
) -> DataFrame:
    """Outcomes of cases like one patient."""
    cohort = stays.filter(
        all_of(
            F.col("age_at_admission").between(age - tolerance, age + tolerance),
            F.col("admission_type").isin(list(admission_types)),
            F.col("early_icu_score") == early_score,
            known_rows(),
            restrict_types("icu_type", icu_types, V.ICU_TYPES),
        )
    )
    return cohort.agg(
        F.count(F.lit(1)).alias("case_count"),
        F.countDistinct("subject_id").alias("unique_patients"),
        rate("icu_mortality_label", 0).alias("survival_rate"),
        rate("icu_mortality_label", 1).alias("mortality_rate"),
        F.avg("los_icu_days").alias("avg_los_days"),
    )


def outcomes_by_admission_type(
    stays: DataFrame, admission_types: Sequence[str], age_min: int | None = None, age_max: int | None = None
) -> DataFrame:
    """Outcomes per admission type, most patients first."""
    return (
        stays.filter(
            all_of(
                F.col("admission_type").isin(list(admission_types)),
                known_rows(),
                optional("age_at_admission", age_min, age_max),
            )
        )
        .groupBy("admission_type")
        .agg(
            F.countDistinct("hadm_id").alias("patient_count"),
            rate("icu_mortality_label", 0).alias("survival_rate"),
            F.avg("los_icu_days").alias("avg_icu_los"),
            F.avg("los_hospital_days").alias("avg_hospital_los"),
        )
        .orderBy(F.col("patient_count").desc(), "admission_type")
    )


def outcomes_by_icu_type(
    stays: DataFrame, icu_types: Sequence[str], early_score: int | None = None
) -> DataFrame:
    """Outcomes per ICU type, most stays first."""
    return (
        stays.filter(
            all_of(
                F.col("icu_type").isin(list(icu_types)),
                known_rows(),
                optional("early_icu_score", equals=early_score),
            )
        )
        .groupBy("icu_type")
        .agg(
            F.countDistinct("subject_id", "hadm_id").alias("stay_count"),
            F.countDistinct("subject_id").alias("patient_count"),
            rate("icu_mortality_label", 0).alias("survival_rate"),
            F.avg("los_icu_days").alias("avg_icu_los"),
            F.avg("early_icu_score").alias("avg_severity"),
        )
        .orderBy(F.col("stay_count").desc(), "icu_type")
    )


def common_treatments(
    prescriptions: DataFrame, stays: DataFrame, test: Column | None = None,
    least: int = 2, routes: int = 3, top: int = 10,
) -> DataFrame:
    """Most frequent drugs of a cohort with up to ``routes`` routes each.

    The routes shown are the first in alphabetical order, so the answer is stable.
    """
    cohort = stays.filter(all_of(test)).select("hadm_id")
    joined = prescriptions.join(cohort, "hadm_id")
    # one row per (drug, admission, route) before the counts: a frequent drug is reduced early
    thin = joined.select("drug", "drug_type", "hadm_id", "route").distinct()
    return (
        thin.groupBy("drug", "drug_type")
        .agg(
            F.countDistinct("hadm_id").alias("prescription_count"),
            F.slice(F.array_sort(F.collect_set("route")), 1, routes).alias("common_routes"),
        )
        .filter(F.col("prescription_count") >= least)
        .orderBy(F.col("prescription_count").desc(), "drug", "drug_type")
        .limit(top)
    )


def peer_aggregates(stays: DataFrame, test: Column, requester: str) -> DataFrame:
    """Exact cohort aggregates per peer site in one scan."""
    hit = F.col("assigned_hospital") != requester
    return (
        stays.filter(hit & test)
        .groupBy(F.col("assigned_hospital").alias("hospital"))
        .agg(
            F.count(F.lit(1)).alias("case_count"),
            F.sum("icu_mortality_label").alias("deaths"),
            F.avg("los_icu_hours").alias("avg_icu_los"),
            F.avg("los_hospital_days").alias("avg_hospital_los"),
        )
    )


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Count per value, NULL shown as 'NULL', with the total."""
    counts = df.groupBy(F.coalesce(F.col(column), F.lit("NULL")).alias(column)).agg(
        F.count(F.lit(1)).alias("n")
    )
    # a scalar over the grouped rows shares their exchange, so the table is scanned once
    return counts.select(column, "n", counts.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar().alias("total"))


def capacity_by_type(stays: DataFrame, split: str = "train") -> DataFrame:
    """Historical patients and stay length per ICU type."""
    return (
        stays.filter(F.col("data_split") == split)
        .groupBy("icu_type")
        .agg(
            F.count(F.lit(1)).alias("historical_patients"),
            F.round(F.avg("los_icu_days"), 1).alias("avg_los_days"),
        )
        .withColumn("icu_type_category", C.icu_category(F.col("icu_type")))
        .orderBy(F.col("historical_patients").desc(), "icu_type")
    )


def cohort_cells(stays: DataFrame) -> DataFrame:
    """Stays summed per (site, age, admission type, ICU type, score).

    The keys are small coded domains, so the cells are a few thousand rows whatever the
    number of stays; every cohort query is a sum over cells.
    """
    return stays.groupBy(
        "assigned_hospital", "age_at_admission", "admission_type", "icu_type", "early_icu_score"
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("icu_mortality_label").alias("deaths"),
        F.sum("los_icu_hours").alias("icu_hours"),
        F.count("los_icu_hours").alias("n_icu_hours"),
        F.sum("los_hospital_days").alias("hospital_days"),
        F.count("los_hospital_days").alias("n_hospital_days"),
    )


def network_cohorts(requests: DataFrame, stays: DataFrame) -> DataFrame:
    """Peer-site aggregates for many requests at once (V13, before the privacy gates).

    Requests: request_id, requesting_hospital, age_bucket, admission_text, early_icu_score,
    icu_text (NULL: any). Equal requests are answered once: the join runs between the
    distinct parameter sets and the cells, on (admission type, score).
    """
    parameters = ["requesting_hospital", "age_bucket", "admission_text", "early_icu_score", "icu_text"]
    bounds = G.age_bounds(F.col("age_bucket"))
    icu = terms.NETWORK_ICU_TYPE.values(F.col("icu_text"))
    asked = requests.select(*parameters).distinct()
    shaped = asked.select(
        *parameters,
        bounds["low"].alias("_low"),
        bounds["high"].alias("_high"),
        icu.alias("_icu"),
        F.explode(terms.NETWORK_ADMISSION_TYPE.values(F.col("admission_text"))).alias("admission_type"),
    )
    cells = materialise(cohort_cells(stays))
    hits = join_small(shaped, cells, ["admission_type", "early_icu_score"]).filter(
        F.col("age_at_admission").between(F.col("_low"), F.col("_high"))
        & F.array_contains(F.col("_icu"), F.col("icu_type"))
        & (F.col("assigned_hospital") != F.col("requesting_hospital"))
    )
    answers = hits.groupBy(*parameters, F.col("assigned_hospital").alias("hospital")).agg(
        F.sum("n").alias("case_count"),
        F.sum("deaths").alias("deaths"),
        safe_ratio(F.sum("icu_hours"), F.sum("n_icu_hours")).alias("avg_icu_los"),
        safe_ratio(F.sum("hospital_days"), F.sum("n_hospital_days")).alias("avg_hospital_los"),
    )
    peers = F.explode(
        F.filter(F.array(*[F.lit(s) for s in V.SITES]), lambda s: s != F.col("requesting_hospital"))
    )
    expected = asked.select(*parameters, peers.alias("hospital"))
    joined = expected.alias("e").join(
        answers.alias("a"), null_safe("e", "a", [*parameters, "hospital"]), "left"
    )
    return joined.select(
        *[F.col(f"e.{n}") for n in [*parameters, "hospital"]],
        F.coalesce("a.case_count", F.lit(0)).alias("case_count"),
        F.coalesce("a.deaths", F.lit(0)).alias("deaths"),
        "a.avg_icu_los",
        "a.avg_hospital_los",
    )
