"""Curated layer: dimensions, facts and the stay-level feature table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlake.functions import clinical as C, temporal as T, vocabulary as V
from cohortlake.functions.scalars import stable_bucket
from cohortlake.operators.runs import sorted_runs


def first_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """The given columns of the first row of each key.

    An aggregate in place of a row-number window: it combines map-side, so a hot key
    is reduced before the shuffle.
    """
    picked = F.min_by(F.struct(*columns), F.struct(*order)).alias("_first")
    return df.groupBy(*keys).agg(picked).select(*keys, "_first.*")


def dim_patient(patients: DataFrame, admissions: DataFrame) -> DataFrame:
    """Patients with the demographics of their first admission."""
    first = first_per_key(
        admissions,
        ["subject_id"],
        ["admittime", "hadm_id"],
        ["ethnicity", "marital_status", "language", "insurance"],
    )
    return patients.select(
        "subject_id",
        "gender",
        "anchor_age",
        "anchor_year",
        "anchor_year_group",
        F.col("dod").alias("death_date"),
        C.present_flag(F.col("dod")).alias("is_deceased"),
    ).join(first, "subject_id", "left")


def fact_hospital_admission(admissions: DataFrame, patients: DataFrame) -> DataFrame:
    """Admissions with length of stay and age."""
    anchors = patients.select("subject_id", "anchor_age", "anchor_year")
    start, end = F.col("admittime"), F.col("dischtime")
    return (
        admissions.join(anchors, "subject_id")
        .withColumn("los_hospital_days", T.whole_units("DAY", start, end))
        .withColumn("los_hospital_hours", T.whole_units("HOUR", start, end))
        .withColumn("age_at_admission", T.age_at(F.col("anchor_age"), F.col("anchor_year"), start))
        .drop("anchor_age", "anchor_year")
    )


def fact_transfers(transfers: DataFrame) -> DataFrame:
    """All movements with hours and unit class."""
    return transfers.select(
        "transfer_id",
        "subject_id",
        "hadm_id",
        "eventtype",
        "careunit",
        "intime",
        "outtime",
        T.whole_units("HOUR", F.col("intime"), F.col("outtime")).alias("los_hours"),
        C.care_type(F.col("careunit")).alias("care_type"),
    )


def movement_groups(transfers: DataFrame) -> DataFrame:
    """One row per (subject, admission) with its ICU movements and movement counts.

    One aggregate serves both. The unit set of a group is bounded by the unit vocabulary,
    and every aggregate combines map-side.
    """
    unit, icu = F.col("careunit"), F.col("_icu")
    # classified once per movement, not once per aggregate
    rows = transfers.select(
        "subject_id", "hadm_id", "careunit", "intime", "outtime", "transfer_id",
        (C.is_icu_unit(unit) == 1).alias("_icu"),
        (C.care_type(unit) == "ICU").cast("int").alias("_listed"),
    )

    def at_icu(value: Column) -> Column:
        return F.when(icu, value)

    first = at_icu(F.struct("intime", "transfer_id", "careunit"))
    return (
        rows.groupBy("subject_id", "hadm_id")
        .agg(
            F.min(at_icu(F.col("intime"))).alias("icu_intime"),
            F.max(at_icu(F.col("outtime"))).alias("icu_outtime"),
            F.min(at_icu(F.col("transfer_id"))).alias("first_icu_transfer_id"),
            F.collect_set(at_icu(unit)).alias("_units"),
            F.min(first)["careunit"].alias("first_careunit"),
            F.sum("_listed").alias("n_icu_transfers"),
            F.count(F.lit(1)).alias("n_total_transfers"),
        )
        .withColumn("icu_units", F.array_join(F.array_sort("_units"), ","))
        .withColumn("n_distinct_icu_units", F.size("_units").cast("bigint"))
        .drop("_units")
    )


def icu_groups(transfers: DataFrame) -> DataFrame:
    """The groups with at least one ICU movement."""
    icu = transfers.filter(C.is_icu_unit(F.col("careunit")) == 1)
    return movement_groups(icu).drop("n_icu_transfers", "n_total_transfers")


STAY_COLUMNS = [
    "subject_id", "hadm_id", "first_icu_transfer_id", "icu_intime", "icu_outtime",
    "los_icu_hours", "los_icu_days", "icu_units", "first_careunit",
    "n_distinct_icu_units", "icu_type", "is_mixed_icu",
]


def _typed_stays(groups: DataFrame) -> DataFrame:
    n, start, end = (F.col(c) for c in ("n_distinct_icu_units", "icu_intime", "icu_outtime"))
    return (
        groups.withColumn("los_icu_hours", T.whole_units("HOUR", start, end))
        .withColumn("los_icu_days", T.whole_units("DAY", start, end))
        .withColumn("icu_type", C.icu_type(F.col("icu_units"), n))
        .withColumn("is_mixed_icu", C.mixed_flag(n))
    )


def fact_icu_stay(transfers: DataFrame, surrogate_key: bool = True) -> DataFrame:
    """ICU stays derived from movements.

    ``surrogate_key=False`` leaves out stay_id and with it the global sort.
    """
    stays = _typed_stays(icu_groups(transfers)).select(*STAY_COLUMNS)
    if not surrogate_key:
        return stays
    return sorted_runs(stays, ["subject_id", "hadm_id"]).numbered("stay_id").select("stay_id", *STAY_COLUMNS)


def counted_stays(transfers: DataFrame) -> DataFrame:
    """Stays of known admissions with their movement counts, from one scan of the movements.

    Counts are per admission, over all its subjects. The window needs the rows by
    hadm_id, which is also what the join with the admissions needs, and an admission has
    one row per subject.
    """
    admission = Window.partitionBy("hadm_id")
    groups = movement_groups(transfers.filter(F.col("hadm_id").isNotNull()))
    counts = {c: F.sum(c).over(admission) for c in ("n_icu_transfers", "n_total_transfers")}
    counted = groups.withColumns(counts).filter(F.col("n_distinct_icu_units") > 0)
    return _typed_stays(counted).select(*STAY_COLUMNS, *counts)


def transfer_counts(transfers: DataFrame) -> DataFrame:
    """Movements and ICU movements per admission in one pass."""
    return transfers.filter(F.col("hadm_id").isNotNull()).groupBy("hadm_id").agg(
        F.count_if(C.care_type(F.col("careunit")) == "ICU").alias("n_icu_transfers"),
        F.count(F.lit(1)).alias("n_total_transfers"),
    )


def stay_frame(
    stays: DataFrame, admissions: DataFrame, patients: DataFrame, transfers: DataFrame | None
) -> DataFrame:
    """Stays joined with admission, patient and movement counts.

    Stays that carry their counts (``counted_stays``) need no movements.
    """
    adm = admissions.select(
        "hadm_id", "admittime", "age_at_admission", "los_hospital_days", "los_hospital_hours",
        "admission_type", "admission_location", "insurance", "hospital_expire_flag", "deathtime",
    )
    who = patients.select("subject_id", "gender", "ethnicity", "marital_status", "death_date")
    hours = T.whole_units("HOUR", F.col("admittime"), F.col("icu_intime"))
    rows = stays.join(adm, "hadm_id")
    if "n_total_transfers" not in stays.columns:
        # joined on hadm_id right after the admissions: both joins share one shuffle
        rows = rows.join(transfer_counts(transfers), "hadm_id", "left")
    return (
        rows.join(who, "subject_id")
        .withColumn("n_icu_transfers", F.coalesce("n_icu_transfers", F.lit(0)))
        .withColumn("n_total_transfers", F.coalesce("n_total_transfers", F.lit(0)))
        .withColumn("ed_admission_flag", C.ed_flag(F.col("admission_location")))
        .withColumn("emergency_admission_flag", C.emergency_flag(F.col("admission_type")))
        .withColumn("hours_admit_to_icu", hours)
        .withColumn("early_icu_score", C.early_score(hours))
        .withColumn("weekend_admission", T.weekend_flag(F.col("admittime")))
        .withColumn("night_admission", T.night_flag(F.col("admittime")))
    )


FEATURE_COLUMNS = [
    "stay_id", "subject_id", "hadm_id", "icu_intime", "icu_outtime", "los_icu_hours",
    "los_icu_days", "icu_type", "first_careunit", "n_distinct_icu_units", "is_mixed_icu",
    "age_at_admission", "los_hospital_days", "los_hospital_hours", "admission_type",
    "admission_location", "insurance", "gender", "ethnicity", "marital_status",
    "n_icu_transfers", "n_total_transfers", "ed_admission_flag", "emergency_admission_flag",
    "hours_admit_to_icu", "early_icu_score", "weekend_admission", "night_admission",
]


def _features(frame: DataFrame) -> list[str]:
    return [c for c in FEATURE_COLUMNS if c in frame.columns]


def clinical_features(
    stays: DataFrame, admissions: DataFrame, patients: DataFrame, transfers: DataFrame | None = None
) -> DataFrame:
    """Feature table, one row per ICU stay."""
    frame = stay_frame(stays, admissions, patients, transfers)
    return frame.select(*_features(frame))


def assign_site_and_split(patients: DataFrame) -> DataFrame:
    """Site (40/35/25) and split (70/15/15) from two independent hash buckets."""
    site, split = stable_bucket(F.col("subject_id")), stable_bucket(F.col("subject_id"), "split_")
    return patients.withColumn(
        "assigned_hospital",
        F.when(site < 40, V.SITES[0]).when(site < 75, V.SITES[1]).otherwise(V.SITES[2]),
    ).withColumn(
        "data_split",
        F.when(split < 70, "train").when(split < 85, "validation").otherwise("test"),
    )


def patient_split_assignment(patients: DataFrame) -> DataFrame:
    """Assignment table, one row per patient."""
    return assign_site_and_split(patients).select(
        "subject_id", "anchor_age", "anchor_year", "anchor_year_group", "gender", "dod",
        C.present_flag(F.col("dod")).alias("is_deceased"),
        "assigned_hospital", "data_split",
    )


def site_stays(
    stays: DataFrame, admissions: DataFrame, patients: DataFrame, transfers: DataFrame | None = None
) -> DataFrame:
    """Feature rows of every site in one table.

    The assignment is a function of subject_id, so it is computed in place instead of
    joined. Write it with ``partitionBy("assigned_hospital", "data_split")``: a site
    table is then a pruned read.
    """
    frame = assign_site_and_split(stay_frame(stays, admissions, patients, transfers))
    return frame.select(
        *_features(frame),
        "hospital_expire_flag",
        "deathtime",
        "death_date",
        "assigned_hospital",
        "data_split",
        F.coalesce(F.col("hospital_expire_flag") == 1, F.lit(False)).cast("int").alias("icu_mortality_label"),
    )


def site_table(stays: DataFrame, site: str) -> DataFrame:
    """Rows of one site."""
    return stays.filter(F.col("assigned_hospital") == site)
