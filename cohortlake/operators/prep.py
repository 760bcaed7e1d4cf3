"""Feature preparation: defaults, imputation, scaling, encoding, splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cohortlake.functions import clinical as C, temporal as T
from cohortlake.functions.scalars import hash_unit, known
from cohortlake.operators.joins import join_small
from cohortlake.operators.runs import exact_quantiles, sorted_runs

# fixed values: what a missing request feature is taken to be
FEATURE_DEFAULTS = {
    "age_at_admission": 65,
    "gender": "M",
    "race": "UNKNOWN",
    "marital_status": "UNKNOWN",
    "insurance": "Other",
    "admission_type": "EMERGENCY",
    "admission_location": "EMERGENCY ROOM",
    "hours_admit_to_icu": 24.0,
    "early_icu_score": 1,
    "icu_type": "Medical ICU",
    "first_careunit": "Medical Intensive Care Unit (MICU)",
    "weekend_admission": 0,
    "night_admission": 0,
    "ed_admission_flag": 0,
    "emergency_admission_flag": 0,
    "los_hospital_days": 0.0,
    "los_hospital_hours": 0.0,
    "los_icu_hours": 0.0,
    "los_icu_days": 0.0,
    "n_icu_transfers": 0,
    "n_total_transfers": 0,
    "n_distinct_icu_units": 1,
    "is_mixed_icu": 0,
}


def complete_features(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """All model features from whichever are present.

    Flags and stay lengths that are absent are derived from the admission time, place,
    type and hours to ICU when those are present; the rest takes defaults. The severity
    score always follows from the hours when they are given.
    """
    derived: dict[str, Column] = {}
    if "admittime" in df.columns:
        derived["weekend_admission"] = T.weekend_flag(F.col("admittime"))
        derived["night_admission"] = T.night_flag(F.col("admittime"))
    if "admission_location" in df.columns:
        derived["ed_admission_flag"] = C.ed_flag(F.col("admission_location"), ignore_case=True)
    if "admission_type" in df.columns:
        derived["emergency_admission_flag"] = C.emergency_flag(F.col("admission_type"))
    if "hours_admit_to_icu" in df.columns:
        hours = F.col("hours_admit_to_icu")
        derived["los_hospital_hours"] = hours.cast("double")
        derived["los_hospital_days"] = hours / 24.0

    def feature(name: str, default) -> Column:
        options = [F.col(name)] if name in df.columns else []
        if name in derived:
            options.append(derived[name])
        if name == "early_icu_score" and "hours_admit_to_icu" in df.columns:
            options.insert(0, F.when(hours.isNotNull(), C.early_score(hours)))
        return F.coalesce(*options, F.lit(default)).alias(name)

    return df.select(*keep, *[feature(n, d) for n, d in FEATURE_DEFAULTS.items()])


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns as double, NULL where unparsable."""
    values = {c: F.col(c).try_cast("double") for c in columns}
    return df.withColumns({c: F.when(~F.isnan(v), v) for c, v in values.items()})


def _require(df: DataFrame, columns: Sequence[str], allow_missing: bool) -> list[str]:
    absent = [c for c in columns if c not in df.columns]
    if absent and not allow_missing:
        raise ValueError(f"missing columns: {absent}")
    return [c for c in columns if c in df.columns]


def fit_numeric(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), allow_missing: bool = False
) -> DataFrame:
    """Median, and mean and population std after imputation, per (keys, column).

    Two aggregates over the rows: exact medians, then mean and std with the medians in
    place, all columns at once.
    """
    keys, columns = list(keys), _require(df, columns, allow_missing)
    numeric = coerce_numeric(df.select(*keys, *columns), columns)
    medians = exact_quantiles(numeric.unpivot(keys, columns, "column", "v"), [*keys, "column"], "v", {"median": 0.5})
    packed = medians.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("column", "median"))).alias("_m")
    )
    rows = join_small(numeric, packed, keys, "left") if keys else numeric.withColumn("_m", packed.select("_m").scalar())
    filled = rows.withColumns({c: F.coalesce(F.col(c), F.try_element_at("_m", F.lit(c))) for c in columns})
    wide = filled.groupBy(*keys).agg(
        F.any_value("_m").alias("_m"),
        *[F.avg(c).alias(f"avg_{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(c).alias(f"std_{i}") for i, c in enumerate(columns)],
    )
    entries = [
        F.struct(
            F.lit(c).alias("column"), F.try_element_at("_m", F.lit(c)).alias("median"),
            F.col(f"avg_{i}").alias("mean"), F.col(f"std_{i}").alias("std"),
        )
        for i, c in enumerate(columns)
    ]
    return wide.select(*keys, F.inline(F.array(*entries)))


def _parameter_map(params: DataFrame, keys: Sequence[str]) -> DataFrame:
    # a handful of features per key
    entry = F.struct("column", F.struct("median", "mean", "std"))
    return params.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("_params"))


def scale(
    df: DataFrame, params: DataFrame, columns: Sequence[str], keys: Sequence[str] = (),
    fill: float | str = "median",
) -> DataFrame:
    """Columns imputed and standardised with fitted parameters.

    ``fill`` is 'median' (of the training rows), or a number used for missing values.
    A zero standard deviation divides by one.
    """
    keys, columns = list(keys), list(columns)
    packed = _parameter_map(params, keys)
    if keys:
        rows = join_small(df, packed, keys, "left")
    else:
        rows = df.withColumn("_params", packed.scalar())
    rows = coerce_numeric(rows, columns)

    def scaled(name: str) -> Column:
        p = F.try_element_at(F.col("_params"), F.lit(name))
        missing = p["median"] if fill == "median" else F.lit(float(fill))
        std = F.when(p["std"] == 0, F.lit(1.0)).otherwise(p["std"])
        return (F.coalesce(F.col(name), missing) - p["mean"]) / std

    return rows.withColumns({c: scaled(c) for c in columns}).drop("_params")


def impute_own_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing values as the median of this frame rather than of training."""
    numeric = coerce_numeric(df, columns)
    long = numeric.unpivot([], list(columns), "column", "v")
    packed = exact_quantiles(long, ["column"], "v", {"median": 0.5}).agg(
        F.map_from_entries(F.collect_list(F.struct("column", "median")))
    ).scalar()
    rows = numeric.withColumn("_m", packed)
    return rows.withColumns(
        {c: F.coalesce(F.col(c), F.try_element_at("_m", F.lit(c))) for c in columns}
    ).drop("_m")


def fit_categories(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), allow_missing: bool = False
) -> DataFrame:
    """Alphabetical integer codes per (keys, column), NULL as 'Unknown' (M06)."""
    keys, columns = list(keys), _require(df, columns, allow_missing)
    values = df.select(*keys, *[known(F.col(c)).alias(c) for c in columns])
    distinct = values.unpivot(keys, columns, "column", "value").distinct()
    group = [*keys, "column"]
    coded = sorted_runs(distinct, [*group, "value"]).row_number(group, "_rn")
    return coded.select(*group, "value", (F.col("_rn") - 1).cast("int").alias("code"))


def encode(
    df: DataFrame, dictionary: DataFrame, columns: Sequence[str], keys: Sequence[str] = (),
    missing: str = "Unknown",
) -> DataFrame:
    """Columns as codes; unseen values become -1.

    ``missing='Unknown'`` codes NULL like the category 'Unknown'; ``missing='unseen'``
    gives -1.
    """
    rows = df
    for name in columns:
        codes = dictionary.filter(F.col("column") == name).select(
            *keys, F.col("value").alias(f"_v_{name}"), F.col("code").alias(f"_c_{name}")
        )
        value = known(F.col(name)) if missing == "Unknown" else F.col(name).cast("string")
        rows = join_small(
            rows.withColumn(f"_v_{name}", value), codes, [*keys, f"_v_{name}"], "left"
        )
        rows = rows.withColumn(name, F.coalesce(f"_c_{name}", F.lit(-1))).drop(f"_v_{name}", f"_c_{name}")
    return rows


def stratified_split(
    df: DataFrame, label: str, key: str, shares: tuple[float, float, float] = (0.6, 0.2, 0.2), seed: int = 42
) -> DataFrame:
    """Exact-share train / validation / test split inside each class.

    Rows of a class are put in salted-hash order and cut by rank. The ranks come from
    balanced runs: two classes do not mean two tasks.
    """
    hashed = df.withColumn("_u", hash_unit(F.col(key), str(seed)))
    ranked = sorted_runs(hashed, [label, "_u", key]).row_number([label], "_rn")
    totals = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    position = (F.col("_rn") - 1) / F.col("_n").cast("double")
    train, validation, _ = shares
    # one row per class
    return join_small(ranked, totals, label).withColumn(
        "split",
        F.when(position < train, "train")
        .when(position < train + validation, "validation")
        .otherwise("test"),
    ).drop("_u", "_rn", "_n")
