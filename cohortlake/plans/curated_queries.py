"""Queries of the curated, site and verification layers: joins, windows, statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cohortlake.functions import clinical as C
from cohortlake.functions import vocabulary as V
from cohortlake.operators import curated, verification
from cohortlake.operators.runs import sorted_runs
from cohortlake.plans import layers
from cohortlake.plans.checks import check
from cohortlake.plans.registry import query
from cohortlake.session import run_path

# ---- joins ------------------------------------------------------------------

query("j01_fact_admission", check("SELECT * FROM fact_admission"))(lambda t: t.fact_admission)
query("j02_dim_patient", check("SELECT * FROM dim_patient"))(lambda t: t.dim_patient)


@query("j03_clinical_features", check("""
    SELECT * EXCLUDE (hospital_expire_flag, deathtime, death_date, assigned_hospital, data_split,
      icu_mortality_label) FROM site_stays"""))
def _(t):
    return curated.clinical_features(curated.counted_stays(t.transfers), t.fact_admission, t.dim_patient)


@query("j03b_clinical_features_from_facts", check("""
    SELECT hadm_id, subject_id, icu_type, n_icu_transfers, n_total_transfers, early_icu_score FROM site_stays"""))
def _(t):
    # stays and movements as separate tables, as in the stored layers
    features = curated.clinical_features(t.icu_stays, t.fact_admission, t.dim_patient, t.transfers)
    return features.select("hadm_id", "subject_id", "icu_type", "n_icu_transfers", "n_total_transfers", "early_icu_score")


@query("j04_site_stays", check("SELECT * FROM site_stays"))
def _(t):
    a, b, c = (curated.site_table(t.site_stays, site) for site in V.SITES)
    return a.union(b).union(c)


@query("j05_transfer_counts", check("""
    SELECT a.hadm_id,
      (SELECT count(*) FROM fact_transfers t WHERE t.hadm_id = a.hadm_id AND care_type = 'ICU') AS n_icu_transfers,
      (SELECT count(*) FROM fact_transfers t WHERE t.hadm_id = a.hadm_id) AS n_total_transfers
    FROM admissions a"""))
def _(t):
    counts = curated.transfer_counts(t.transfers)
    return t.admissions.select("hadm_id").join(counts, "hadm_id", "left").fillna(0)


def _colocated(t):
    given = {"patients": t.patients, "admissions": t.admissions, "transfers": t.transfers}
    return layers.colocated_sources(
        t.spark, given, run_path(t.spark, "colocated"), f"run_{uuid.uuid4().hex[:12]}_", buckets=8)


@query("j01b_colocated_admissions", check("SELECT * FROM fact_admission"))
def _(t):
    stored = _colocated(t)
    return curated.fact_hospital_admission(stored["admissions"], stored["patients"])


@query("j02b_colocated_patients", check("SELECT * FROM dim_patient"))
def _(t):
    stored = _colocated(t)
    return curated.dim_patient(stored["patients"], stored["admissions"])


_OVERLAP_SQL = check("""
    WITH l AS (SELECT assigned_hospital AS hospital, subject_id, data_split FROM site_stays)
    SELECT hospital,
      count(DISTINCT subject_id) FILTER (data_split = 'train') AS train_patients,
      count(DISTINCT subject_id) FILTER (data_split = 'validation') AS val_patients,
      count(DISTINCT subject_id) FILTER (data_split = 'test') AS test_patients,
      (SELECT count(DISTINCT a.subject_id) FROM l a JOIN l b USING (hospital, subject_id)
        WHERE a.hospital = l.hospital AND a.data_split = 'train' AND b.data_split = 'validation') AS train_val_overlap,
      (SELECT count(DISTINCT a.subject_id) FROM l a JOIN l b USING (hospital, subject_id)
        WHERE a.hospital = l.hospital AND a.data_split = 'train' AND b.data_split = 'test') AS train_test_overlap,
      (SELECT count(DISTINCT a.subject_id) FROM l a JOIN l b USING (hospital, subject_id)
        WHERE a.hospital = l.hospital AND a.data_split = 'validation' AND b.data_split = 'test') AS val_test_overlap
    FROM l GROUP BY hospital""")
query("j06_split_overlap", _OVERLAP_SQL)(lambda t: verification.split_overlap(t.site_stays))


@query("a09_dataset_statistics", check("""
    SELECT assigned_hospital AS hospital, data_split, count(*) AS n_icu_stays,
      count(DISTINCT subject_id) AS n_patients, CAST(sum(icu_mortality_label) AS BIGINT) AS n_deaths,
      round(avg(icu_mortality_label), 4) AS mortality_rate, round(avg(age_at_admission), 1) AS mean_age,
      round(avg(los_icu_hours), 1) AS mean_icu_los_hours
    FROM site_stays GROUP BY 1, 2 ORDER BY 1, 2"""))
def _(t):
    return verification.dataset_statistics(t.site_stays).orderBy("hospital", "data_split")


# ---- windows ----------------------------------------------------------------


@query("w03_surrogate_key", check("SELECT * FROM numbered_stays"))
def _(t):
    return curated.fact_icu_stay(t.transfers)


@query("w02_transfer_sequence", check("""
    SELECT transfer_id, subject_id, hadm_id, intime, careunit, row_number() OVER (
      PARTITION BY subject_id, hadm_id ORDER BY intime, transfer_id, careunit, outtime NULLS FIRST) AS rn
    FROM transfers WHERE careunit IS NOT NULL"""))
def _(t):
    known = t.transfers.filter(F.col("careunit").isNotNull())
    order = ["subject_id", "hadm_id", "intime", "transfer_id", "careunit", "outtime"]
    placed = sorted_runs(known, order).row_number(["subject_id", "hadm_id"])
    return placed.select("transfer_id", "subject_id", "hadm_id", "intime", "careunit", "rn")
