"""The layered build: curated tables in order, then sites, then verification."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from cohortlake.functions import vocabulary as V
from cohortlake.operators import curated, verification
from cohortlake.sources import colocated, tables as S

CURATED, FEDERATED, VERIFICATION = "curated", "federated", "verification"

# each builder sees the source tables and everything built before it
BUILDERS = {
    CURATED: {
        "dim_patient": lambda b: curated.dim_patient(b["patients"], b["admissions"]),
        "fact_hospital_admission": lambda b: curated.fact_hospital_admission(
            b["admissions"], b["patients"]
        ),
        "fact_transfers": lambda b: curated.fact_transfers(b["transfers"]),
        # movements are read from the stored table, so that their source is evaluated once
        "fact_icu_stay": lambda b: curated.fact_icu_stay(b["fact_transfers"]),
        "clinical_features": lambda b: curated.clinical_features(
            b["fact_icu_stay"], b["fact_hospital_admission"], b["dim_patient"], b["fact_transfers"]
        ),
        "patient_split_assignment": lambda b: curated.patient_split_assignment(b["patients"]),
    },
    FEDERATED: {
        "site_data": lambda b: curated.site_stays(
            b["fact_icu_stay"], b["fact_hospital_admission"], b["dim_patient"], b["fact_transfers"]
        ),
    },
    VERIFICATION: {
        "dataset_statistics": lambda b: verification.dataset_statistics(b["site_data"]),
        "data_leakage_check": lambda b: verification.split_overlap(b["site_data"]),
    },
}
PARTITIONS = {"site_data": ("assigned_hospital", "data_split")}
# the key that joins of a table use first
BUCKET_KEYS = {
    "patients": "subject_id", "admissions": "subject_id", "transfers": "hadm_id",
    "dim_patient": "subject_id", "fact_hospital_admission": "hadm_id",
    "fact_transfers": "hadm_id", "fact_icu_stay": "hadm_id",
}


def build_layers(sources: Mapping[str, DataFrame]) -> dict[str, dict[str, DataFrame]]:
    """Every table as a lazy DataFrame, keyed by layer and table."""
    built: dict[str, DataFrame] = dict(sources)
    out: dict[str, dict[str, DataFrame]] = {}
    for layer, builders in BUILDERS.items():
        out[layer] = {}
        for name, build in builders.items():
            built[name] = out[layer][name] = build(built)
    return out


def write_layers(
    spark: SparkSession, sources: Mapping[str, DataFrame], folder: str, prefix: str = "",
    files_per_partition: int | None = None, buckets: int | None = None,
) -> dict[str, dict[str, DataFrame]]:
    """Build and store every table in order; later tables read the stored earlier ones.

    Site and split have nine combinations, so large ones are split by their measured size;
    ``files_per_partition`` sets instead how many tasks
    write each of them; raise it with the size of the data. With ``buckets`` the curated tables
    are stored in that many buckets of their join key (see ``colocated.store``).
    """
    names = {layer: f"{prefix}{layer}" for layer in BUILDERS}
    S.ensure_layers(spark, list(names.values()), folder)
    built: dict[str, DataFrame] = dict(sources)
    out: dict[str, dict[str, DataFrame]] = {}
    for layer, builders in BUILDERS.items():
        out[layer] = {}
        for name, build in builders.items():
            df = build(built)
            if buckets is not None and name in BUCKET_KEYS:
                built[name] = out[layer][name] = colocated.store(
                    df, f"`{names[layer]}`.`{name}`", BUCKET_KEYS[name], f"{folder}/{layer}/{name}", buckets)
                continue
            if name in PARTITIONS:
                df = S.spread(df, PARTITIONS[name], "subject_id", files_per_partition)
            writer = df.write.mode("overwrite").option("path", f"{folder}/{layer}/{name}")
            if name in PARTITIONS:
                writer = writer.partitionBy(*PARTITIONS[name])
            writer.saveAsTable(f"`{names[layer]}`.`{name}`")
            built[name] = out[layer][name] = spark.table(f"`{names[layer]}`.`{name}`")
    return out


def colocated_sources(
    spark: SparkSession, sources: Mapping[str, DataFrame], folder: str, prefix: str = "",
    buckets: int = colocated.BUCKETS,
) -> dict[str, DataFrame]:
    """The source tables stored in buckets: persons and admissions by person, movements by admission.

    Each is shuffled once, here; first rows per person, the joins of admissions with persons
    and the counts per admission over them need no further shuffle.
    """
    layer = f"{prefix}sources"
    S.ensure_layers(spark, [layer], folder)
    return {name: colocated.store(df, f"`{layer}`.`{name}`", BUCKET_KEYS[name], f"{folder}/sources/{name}", buckets)
            for name, df in sources.items()}


def site_views(site_data: DataFrame) -> dict[str, DataFrame]:
    """One pruned view per site over the partitioned table."""
    return {site: curated.site_table(site_data, site) for site in V.SITES}
