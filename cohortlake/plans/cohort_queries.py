"""Cohort, exploration, ranking and resource queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlake.functions import clinical as C, temporal as T, terms, vocabulary as V
from cohortlake.functions.scalars import bin_column, percent_text
from cohortlake.operators import cohorts, curated, explore as X, placement as PL, resources as R, verification
from cohortlake.plans.checks import check, inlist, lst
from cohortlake.plans.registry import query

_EMER = inlist(V.EMERGENCY_ADMISSION_TYPES)
_KNOWN = "data_split IN ('train', 'validation')"
_SURVIVED = "avg(CASE WHEN icu_mortality_label = 0 THEN CAST(1 AS DOUBLE) ELSE 0 END)"
_DIED = "avg(CASE WHEN icu_mortality_label = 1 THEN CAST(1 AS DOUBLE) ELSE 0 END)"

# ---- cohorts --------------------------------------------------------------------


@query("a01_similar_cases", check(f"""
    SELECT count(*) AS case_count, count(DISTINCT subject_id) AS unique_patients, {_SURVIVED} AS survival_rate,
      {_DIED} AS mortality_rate, avg(los_icu_days) AS avg_los_days FROM site_stays
    WHERE age_at_admission BETWEEN 60 AND 70 AND admission_type IN {_EMER} AND early_icu_score = 2 AND {_KNOWN}
      AND icu_type IN ('Mixed ICU (2 Units)', 'Mixed ICU (3+ Units)')"""))
def _(t):
    return cohorts.similar_cases(
        t.site_stays, 65, V.EMERGENCY_ADMISSION_TYPES, 2, V.ICU_TYPE_TERMS["mixed"])


@query("a02_conditional_rate", check(f"""
    SELECT assigned_hospital, {_SURVIVED} AS survival_rate, {_DIED} AS mortality_rate FROM site_stays GROUP BY 1"""))
def _(t):
    return t.site_stays.groupBy("assigned_hospital").agg(
        cohorts.rate("icu_mortality_label", 0).alias("survival_rate"),
        cohorts.rate("icu_mortality_label", 1).alias("mortality_rate"))


@query("a03_outcomes_by_admission_type", check(f"""
    SELECT admission_type, count(DISTINCT hadm_id) AS patient_count, {_SURVIVED} AS survival_rate,
      avg(los_icu_days) AS avg_icu_los, avg(los_hospital_days) AS avg_hospital_los FROM site_stays
    WHERE admission_type IN {inlist(V.ADMISSION_TYPE_TERMS['observation'])} AND {_KNOWN} AND age_at_admission >= 40
    GROUP BY admission_type ORDER BY 2 DESC, 1"""))
def _(t):
    return cohorts.outcomes_by_admission_type(t.site_stays, V.ADMISSION_TYPE_TERMS["observation"], age_min=40)


@query("a04_outcomes_by_icu_type", check(f"""
    SELECT icu_type, count(DISTINCT (subject_id, hadm_id)) AS stay_count, count(DISTINCT subject_id) AS patient_count,
      {_SURVIVED} AS survival_rate, avg(los_icu_days) AS avg_icu_los, avg(early_icu_score) AS avg_severity
    FROM site_stays WHERE icu_type IN {inlist(V.ICU_TYPES)} AND {_KNOWN} GROUP BY icu_type ORDER BY 2 DESC, 1"""))
def _(t):
    return cohorts.outcomes_by_icu_type(t.site_stays, V.ICU_TYPES)


@query("a05_common_treatments", check("""
    SELECT p.drug, p.drug_type, count(DISTINCT p.hadm_id) AS prescription_count,
      list_sort(list(DISTINCT p.route) FILTER (p.route IS NOT NULL))[1:3] AS common_routes
    FROM prescriptions p JOIN site_stays s ON p.hadm_id = s.hadm_id
    WHERE age_at_admission >= 65 AND assigned_hospital = 'hospital_a'
    GROUP BY p.drug, p.drug_type HAVING count(DISTINCT p.hadm_id) >= 2 ORDER BY 3 DESC, 1, 2 LIMIT 10"""))
def _(t):
    test = cohorts.all_of(
        cohorts.optional("age_at_admission", low=65), cohorts.optional("assigned_hospital", equals="hospital_a"))
    return cohorts.common_treatments(t.prescriptions, t.site_stays, test)


_COHORT = f"age_at_admission BETWEEN 60 AND 65 AND admission_type IN {_EMER} AND early_icu_score = 3"


@query("a06_peer_aggregates", check(f"""
    SELECT assigned_hospital AS hospital, count(*) AS case_count, CAST(sum(icu_mortality_label) AS BIGINT) AS deaths,
      avg(los_icu_hours) AS avg_icu_los, avg(los_hospital_days) AS avg_hospital_los FROM site_stays
    WHERE assigned_hospital <> 'hospital_a' AND {_COHORT} GROUP BY 1"""))
def _(t):
    test = (F.col("age_at_admission").between(60, 65)
            & F.col("admission_type").isin(V.EMERGENCY_ADMISSION_TYPES) & (F.col("early_icu_score") == 3))
    return cohorts.peer_aggregates(t.site_stays, test, "hospital_a")


@query("a07_type_distribution", check("""
    SELECT coalesce(marital_status, 'NULL') AS marital_status, count(*) AS n, (SELECT count(*) FROM admissions) AS total
    FROM admissions GROUP BY 1"""))
def _(t):
    return cohorts.distribution(t.admissions, "marital_status")


@query("a08_capacity_by_type", check("""
    SELECT icu_type, count(*) AS historical_patients, round(avg(los_icu_days), 1) AS avg_los_days,
      CASE WHEN icu_type LIKE 'Cardiac%' THEN 'CARDIAC' WHEN icu_type LIKE 'Medical%' THEN 'MEDICAL'
        WHEN icu_type LIKE 'Surgical%' THEN 'SURGICAL' WHEN icu_type LIKE 'Neuro%' THEN 'NEURO'
        WHEN icu_type LIKE 'Mixed%' THEN 'MIXED' ELSE 'OTHER' END AS icu_type_category
    FROM site_stays WHERE data_split = 'train' GROUP BY icu_type ORDER BY 2 DESC, 1"""))
def _(t):
    return cohorts.capacity_by_type(t.site_stays)


_STATS = """st AS (SELECT assigned_hospital AS hospital, data_split, count(*) AS n_icu_stays,
    count(DISTINCT subject_id) AS n_patients, sum(icu_mortality_label) AS n_deaths,
    round(avg(icu_mortality_label), 4) AS mortality_rate, round(avg(age_at_admission), 1) AS mean_age,
    round(avg(los_icu_hours), 1) AS mean_icu_los_hours FROM site_stays GROUP BY 1, 2)"""
_LEVEL = """CASE WHEN grouping(hospital) = 1 AND grouping(data_split) = 1 THEN 'network'
    WHEN grouping(data_split) = 1 THEN 'site' WHEN grouping(hospital) = 1 THEN 'split' ELSE 'cell' END"""


def _network_sql(mean):
    return check(f"""WITH {_STATS} SELECT hospital, data_split, {_LEVEL} AS level,
      CAST(sum(n_patients) AS BIGINT) AS total_patients, CAST(sum(n_deaths) AS BIGINT) AS total_deaths,
      round({mean.format('mortality_rate')}, 4) AS avg_mortality_rate, round({mean.format('mean_age')}, 1) AS avg_age,
      round({mean.format('mean_icu_los_hours')}, 1) AS avg_icu_los_hours,
      round(sum(n_deaths) / CAST(sum(n_patients) AS DOUBLE), 4) AS overall_mortality_rate
    FROM st GROUP BY GROUPING SETS ((hospital, data_split), (hospital), (data_split), ())""")


@query("a10_network_statistics", _network_sql("avg({})"))
def _(t):
    return verification.network_statistics(verification.dataset_statistics(t.site_stays))


@query("a10b_network_statistics_weighted", _network_sql("(sum({} * n_icu_stays) / sum(n_icu_stays))"))
def _(t):
    return verification.network_statistics(verification.dataset_statistics(t.site_stays), weighted=True)


# ---- aggregates of the curated layer ------------------------------------------------


@query("a11_group_extremes", check("""
    SELECT subject_id, hadm_id, icu_intime, icu_outtime, first_icu_transfer_id FROM icu_groups"""))
def _(t):
    return curated.icu_groups(t.transfers).select(
        "subject_id", "hadm_id", "icu_intime", "icu_outtime", "first_icu_transfer_id")


query("a12_ordered_unit_list", check("SELECT subject_id, hadm_id, icu_units FROM icu_groups"))(
    lambda t: curated.icu_groups(t.transfers).select("subject_id", "hadm_id", "icu_units"))
query("a13_distinct_units", check("SELECT subject_id, hadm_id, n_distinct_icu_units FROM icu_groups"))(
    lambda t: curated.icu_groups(t.transfers).select("subject_id", "hadm_id", "n_distinct_icu_units"))
query("a14_first_unit", check("SELECT subject_id, hadm_id, first_careunit FROM icu_groups"))(
    lambda t: curated.icu_groups(t.transfers).select("subject_id", "hadm_id", "first_careunit"))


@query("j07_split_counts", check("""
    SELECT count(DISTINCT subject_id) FILTER (data_split = 'train') AS train_patients,
      count(DISTINCT subject_id) FILTER (data_split = 'validation') AS val_patients,
      count(DISTINCT subject_id) FILTER (data_split = 'test') AS test_patients FROM predictions"""))
def _(t):
    # one row of flags per patient in place of three distinct counts
    splits = {"train_patients": "train", "val_patients": "validation", "test_patients": "test"}
    held = t.predictions.filter(F.col("subject_id").isNotNull()).groupBy("subject_id").agg(
        *[F.bool_or(F.col("data_split") == split).alias(name) for name, split in splits.items()])
    return held.agg(*[F.count_if(name).alias(name) for name in splits])


@query("j08_prescriptions_of_cohort", check("""
    SELECT p.hadm_id, drug, drug_type, route FROM prescriptions p
    JOIN (SELECT hadm_id FROM admissions WHERE admission_type = 'URGENT') a ON p.hadm_id = a.hadm_id"""))
def _(t):
    urgent = t.admissions.filter(F.col("admission_type") == "URGENT").select("hadm_id")
    return t.prescriptions.join(urgent, "hadm_id").select("hadm_id", "drug", "drug_type", "route")


# ---- exploration ----------------------------------------------------------------------


@query("a21_missing_values", check("""
    WITH m AS (SELECT count(*) AS n, count(*) FILTER (deathtime IS NULL) AS deathtime,
      count(*) FILTER (edregtime IS NULL) AS edregtime, count(*) FILTER (marital_status IS NULL) AS marital_status,
      count(*) FILTER (discharge_location IS NULL) AS discharge_location FROM admissions)
    SELECT "column", n_missing, n_missing / CAST(n AS DOUBLE) * 100 AS missing_pct FROM m
      UNPIVOT (n_missing FOR "column" IN (deathtime, edregtime, marital_status, discharge_location))"""))
def _(t):
    return X.missing_values(t.admissions.select("deathtime", "edregtime", "marital_status", "discharge_location"))


@query("a22_value_counts", check("""
    SELECT insurance, count(*) AS n, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share
    FROM admissions GROUP BY insurance ORDER BY 2 DESC, 1"""))
def _(t):
    return X.value_counts(t.admissions, "insurance").orderBy(F.col("n").desc(), "insurance")


_LOS = "(epoch_us(dischtime) - epoch_us(admittime)) / CAST(86400000000 AS DOUBLE)"


def _with_los(t):
    return t.admissions.withColumn("los_days", T.elapsed_days(F.col("admittime"), F.col("dischtime")))


@query("a23_describe", check(f"""
    WITH v AS (SELECT 'los_days' AS "column", {_LOS} AS v FROM admissions
      UNION ALL SELECT 'anchor_age', CAST(anchor_age AS DOUBLE) FROM patients)
    SELECT "column", count(v) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v) AS min,
      max(v) AS max, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS q50,
      round(quantile_cont(v, 0.75), 6) AS q75 FROM v GROUP BY 1"""))
def _(t):
    both = X.describe(_with_los(t), ["los_days"]).unionByName(X.describe(t.patients, ["anchor_age"]))
    return both.select(
        "column", "count", "min", "max", *[F.round(c, 6).alias(c) for c in ("mean", "std", "q25", "q50", "q75")])


@query("a24_group_summary", check(f"""
    WITH v AS (SELECT admission_type, {_LOS} AS v FROM admissions)
    SELECT admission_type, round(avg(v), 6) AS mean, round(median(v), 6) AS median, count(v) AS count FROM v GROUP BY 1"""))
def _(t):
    found = X.group_summary(_with_los(t), ["admission_type"], "los_days")
    return found.withColumn("mean", F.round("mean", 6)).withColumn("median", F.round("median", 6))


@query("a25_event_rate", check("""
    SELECT insurance, CAST(sum(hospital_expire_flag) AS BIGINT) AS events, count(*) AS total,
      avg(CAST(hospital_expire_flag AS DOUBLE)) * 100 AS rate_pct FROM admissions GROUP BY 1"""))
def _(t):
    return X.rate_by(t.admissions, ["insurance"], "hospital_expire_flag")


@query("a26_crosstab_share", check("""
    SELECT admission_type, count(*) FILTER (insurance = 'Medicare') / CAST(count(*) AS DOUBLE) * 100 AS "Medicare",
      count(*) FILTER (insurance = 'Private') / CAST(count(*) AS DOUBLE) * 100 AS "Private",
      count(*) FILTER (insurance = 'Other') / CAST(count(*) AS DOUBLE) * 100 AS "Other",
      count(*) FILTER (insurance = 'Medicaid') / CAST(count(*) AS DOUBLE) * 100 AS "Medicaid",
      count(*) FILTER (insurance = 'No charge') / CAST(count(*) AS DOUBLE) * 100 AS "No charge"
    FROM admissions GROUP BY 1"""))
def _(t):
    return X.crosstab_share(t.admissions, "admission_type", "insurance", V.INSURANCES)


@query("a27_correlation", check(f"""
    SELECT 'los_days' AS "column", round(corr({_LOS}, CAST(hospital_expire_flag AS DOUBLE)), 9) AS correlation FROM admissions
    UNION ALL SELECT 'subject_id', round(corr(CAST(subject_id AS DOUBLE), CAST(hospital_expire_flag AS DOUBLE)), 9) FROM admissions"""))
def _(t):
    found = X.correlations(_with_los(t), ["los_days", "subject_id"], "hospital_expire_flag")
    return found.withColumn("correlation", F.round("correlation", 9))


@query("a28_quantile_cap", check(f"SELECT round(quantile_cont({_LOS}, 0.95), 9) AS cap FROM admissions"))
def _(t):
    return X.quantile_cap(_with_los(t), "los_days").select(F.round("cap", 9).alias("cap"))


@query("a29_histogram", check("""
    WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) - min(o_totalprice) AS w FROM orders)
    SELECT CAST(least(floor((o_totalprice - lo) / w * 30), 29) AS INT) AS bin, count(*) AS n FROM orders, b GROUP BY 1"""))
def _(t):
    return X.histogram(t.raw("orders"), "o_totalprice", 30)


_ICU_WORD = "regexp_matches(coalesce(careunit, ''), 'ICU|INTENSIVE|CCU|SICU|MICU|CVICU|TSICU', 'i')"
_CHILD = f"""c AS (SELECT hadm_id, count(*) AS n_children, CAST(bool_or({_ICU_WORD}) AS INT) AS any_flagged
    FROM transfers WHERE hadm_id IS NOT NULL GROUP BY 1)"""


def _placed(t):
    return t.transfers.filter(F.col("hadm_id").isNotNull())


@query("a30_child_summary", check(f"WITH {_CHILD} SELECT * FROM c"))
def _(t):
    return X.child_summary(_placed(t), "hadm_id", C.mentions_icu(F.col("careunit")))


@query("j09_with_child_summary", check(f"""
    WITH {_CHILD} SELECT hadm_id, admission_type, coalesce(n_children, 0) AS n_children,
      coalesce(any_flagged, 0) AS any_flagged FROM admissions LEFT JOIN c USING (hadm_id)"""))
def _(t):
    return X.with_child_summary(
        t.admissions.select("hadm_id", "admission_type"), _placed(t), "hadm_id", C.mentions_icu(F.col("careunit")))


@query("p24_keyword_predicate", check(f"SELECT transfer_id, careunit, CAST({_ICU_WORD} AS INT) AS mentions_icu FROM transfers"))
def _(t):
    return t.transfers.select(
        "transfer_id", "careunit", C.mentions_icu(F.col("careunit")).cast("int").alias("mentions_icu"))


@query("a31_threshold_shares", check(f"""
    WITH c AS (SELECT count(*) AS n, count(*) FILTER ({_LOS} < 1) AS under_1_day,
      count(*) FILTER ({_LOS} > 14) AS over_14_days FROM admissions)
    SELECT test, v AS n, v / CAST(n AS DOUBLE) * 100 AS pct FROM c UNPIVOT (v FOR test IN (under_1_day, over_14_days))"""))
def _(t):
    los = F.col("los_days")
    return X.share_of(_with_los(t), {"under_1_day": los < 1, "over_14_days": los > 14})


_FACTORS = """r AS (SELECT factor, level, sum(f) / CAST(count(f) AS DOUBLE) AS rate FROM
      (SELECT hospital_expire_flag AS f, insurance, admission_type, language, marital_status FROM admissions)
      UNPIVOT (level FOR factor IN (insurance, admission_type, language, marital_status)) GROUP BY 1, 2)"""
_FACTOR_NAMES = ["insurance", "admission_type", "language", "marital_status"]


@query("a32_effect_ranking", check(f"""
    WITH {_FACTORS} SELECT factor, max(rate) - min(rate) AS effect FROM r GROUP BY 1 ORDER BY 2 DESC, 1"""))
def _(t):
    return X.effect_ranking(t.admissions, _FACTOR_NAMES, "hospital_expire_flag")


@query("a33_disparity", check(f"""
    WITH {_FACTORS} SELECT factor, first(level ORDER BY rate DESC, level DESC) AS highest,
      first(level ORDER BY rate, level) AS lowest, max(rate) / min(rate) AS ratio FROM r GROUP BY 1"""))
def _(t):
    return X.disparity(t.admissions, _FACTOR_NAMES, "hospital_expire_flag")


@query("a68_children_per_parent", check("""
    SELECT (SELECT count(*) FROM patients) AS n_parents, (SELECT count(*) FROM admissions) AS n_children,
      (SELECT count(*) FROM admissions) / CAST((SELECT count(*) FROM patients) AS DOUBLE) AS average"""))
def _(t):
    return X.children_per_parent(t.patients, t.admissions)


@query("j10_repeated_patients", check("""
    SELECT hadm_id, subject_id, CAST(count(*) OVER (PARTITION BY subject_id) > 1 AS INT) AS is_repeated FROM admissions"""))
def _(t):
    return X.repeated_keys(t.admissions.select("hadm_id", "subject_id"), "subject_id")


# ---- windows -----------------------------------------------------------------------------


@query("w01_first_admission", check("""
    SELECT subject_id, hadm_id, admittime FROM admissions
    QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY admittime, hadm_id) = 1"""))
def _(t):
    return curated.first_per_key(t.admissions, ["subject_id"], ["admittime", "hadm_id"], ["hadm_id", "admittime"])


@query("w04_readmissions", check("""
    WITH p AS (SELECT subject_id, hadm_id, admittime, lag(dischtime) OVER
      (PARTITION BY subject_id ORDER BY admittime, hadm_id) AS prev_discharge FROM admissions),
    d AS (SELECT *, (epoch_us(admittime) - epoch_us(prev_discharge)) / CAST(86400000000 AS DOUBLE) AS days_to_readmission FROM p)
    SELECT subject_id, hadm_id, prev_discharge, days_to_readmission,
      CAST(coalesce(days_to_readmission <= 30, false) AS INT) AS is_early FROM d"""))
def _(t):
    return X.readmissions(t.admissions).select(
        "subject_id", "hadm_id", "prev_discharge", "days_to_readmission", "is_early")


@query("w05_unit_transitions", check("""
    WITH n AS (SELECT careunit, lead(careunit) OVER (PARTITION BY subject_id, hadm_id
      ORDER BY intime, transfer_id, careunit NULLS FIRST) AS next_careunit FROM transfers)
    SELECT careunit, next_careunit, count(*) AS n FROM n WHERE careunit IS NOT NULL AND next_careunit IS NOT NULL
    GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 10"""))
def _(t):
    return X.unit_transitions(t.transfers)


@query("w06_run_ranking", check("""
    SELECT run_id, val_auc, row_number() OVER (ORDER BY val_auc DESC, run_id) AS rank, run_id = 3 AS is_baseline FROM runs"""))
def _(t):
    return X.ranked_runs(t.runs.select("run_id", "val_auc"), "val_auc", 3)


# ---- sorts and limits ------------------------------------------------------------------------


@query("t01_ordered_result", check("SELECT subject_id, gender, anchor_age FROM patients ORDER BY gender, subject_id"))
def _(t):
    return t.patients.select("subject_id", "gender", "anchor_age").orderBy("gender", "subject_id")


@query("t02_top_groups", check("""
    SELECT drug, count(*) AS n FROM prescriptions GROUP BY drug ORDER BY n DESC, drug LIMIT 10"""))
def _(t):
    counts = t.prescriptions.groupBy("drug").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), "drug").limit(10)


@query("t03_latest_rows", check("""
    SELECT hadm_id, admittime FROM admissions ORDER BY admittime DESC, hadm_id LIMIT 100"""))
def _(t):
    return t.admissions.select("hadm_id", "admittime").orderBy(F.col("admittime").desc(), "hadm_id").limit(100)


_TIER = "CASE hospital_tier WHEN 'Tertiary Care Center' THEN 0 WHEN 'Community Hospital' THEN 1 WHEN 'Rural Hospital' THEN 2 ELSE 99 END"


@query("t04_best_target", check(f"""
    WITH h AS (SELECT r.hospital_id, {_TIER} AS tier, icu_beds_available AS beds, f.* EXCLUDE (hospital_id)
      FROM resources r JOIN flags f ON r.hospital_id = f.hospital_id WHERE NOT absent),
    c AS (SELECT hospital_id, tier, beds, capability FROM h
      UNPIVOT (has FOR capability IN (ecmo, cardiac_surgery, advanced_cardiac_care, dialysis)) WHERE has),
    q AS (SELECT request_id, capability, 'hospital_' || (request_id % 5 * 6) AS requesting_hospital FROM requests)
    SELECT request_id, capability, requesting_hospital, (SELECT c.hospital_id FROM c WHERE c.capability = q.capability
      AND c.hospital_id <> q.requesting_hospital ORDER BY tier, beds DESC, c.hospital_id LIMIT 1) AS target FROM q"""))
def _(t):
    asked = t.requests.select(
        "request_id", "capability",
        F.concat(F.lit("hospital_"), (F.col("request_id") % 5 * 6).cast("string")).alias("requesting_hospital"))
    return R.best_targets(asked, t.resources).select("request_id", "capability", "requesting_hospital", "target")


@query("t05_largest_rates", check("""
    SELECT admission_location, avg(CAST(hospital_expire_flag AS DOUBLE)) * 100 AS rate_pct FROM admissions
    GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"""))
def _(t):
    rates = X.rate_by(t.admissions, ["admission_location"], "hospital_expire_flag")
    return rates.select("admission_location", "rate_pct").orderBy(F.col("rate_pct").desc(), "admission_location").limit(5)


@query("t06_bed_allocation", check("""
    WITH p AS (SELECT request_id, target_hospital, risk_score, row_number() OVER
      (PARTITION BY target_hospital ORDER BY risk_score DESC, request_id) AS position FROM requests)
    SELECT request_id, target_hospital, position, position <= coalesce(icu_beds_available, 0) AS bed_allocated,
      CASE WHEN position <= icu_beds_available THEN icu_beds_occupied + position END AS bed_number,
      CASE WHEN risk_score > 0.7::DOUBLE THEN 'HIGH' ELSE 'MODERATE' END AS priority
    FROM p LEFT JOIN resources ON target_hospital = hospital_id"""))
def _(t):
    return R.allocate_beds(t.requests, t.resources)


@query("t06b_stable_placement", check(f"""
    WITH RECURSIVE h AS (SELECT r.hospital_id, {_TIER} AS tier, icu_beds_available AS beds, f.* EXCLUDE (hospital_id)
      FROM resources r JOIN flags f ON r.hospital_id = f.hospital_id WHERE NOT absent),
    c AS (SELECT hospital_id, tier, beds, capability FROM h
      UNPIVOT (has FOR capability IN (ecmo, cardiac_surgery, advanced_cardiac_care, dialysis)) WHERE has),
    number AS (SELECT hospital_id, row_number() OVER (ORDER BY hospital_id) AS k, beds FROM h),
    lists AS (SELECT capability, list(k ORDER BY tier, c.beds DESC, hospital_id) AS l FROM c JOIN number USING (hospital_id) GROUP BY 1),
    q AS (SELECT request_id, capability, 'hospital_' || (request_id % 5 * 6) AS requesting_hospital,
      row_number() OVER (ORDER BY risk_score DESC, request_id) AS i FROM requests),
    asked AS (SELECT i, request_id, coalesce(l, []) AS l, coalesce(k, 0) AS own FROM q LEFT JOIN lists USING (capability)
      LEFT JOIN number ON hospital_id = requesting_hospital),
    steps(i, target, free) AS (
      SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), (SELECT list(beds ORDER BY k) FROM number)
      UNION ALL
      SELECT i, target, CASE WHEN target IS NULL THEN free ELSE
          list_concat(free[:target - 1], [free[target] - 1], free[target + 1:]) END
      FROM (SELECT a.i, s.free, list_filter(a.l, lambda k: s.free[k] > 0 AND k <> a.own)[1] AS target
        FROM steps s JOIN asked a ON a.i = s.i + 1))
    SELECT q.request_id, q.capability, q.requesting_hospital, hospital_id AS target,
      CASE WHEN hospital_id IS NOT NULL THEN row_number() OVER (PARTITION BY hospital_id ORDER BY q.i) END AS bed
    FROM q JOIN steps s ON s.i = q.i LEFT JOIN number ON k = s.target"""))
def _(t):
    asked = t.requests.select(
        "request_id", "capability", "risk_score",
        F.concat(F.lit("hospital_"), (F.col("request_id") % 5 * 6).cast("string")).alias("requesting_hospital"))
    return PL.place_requests(asked, t.resources)[0]


@query("t07_weekday_counts", check(f"""
    SELECT CAST(i - 1 AS INT) AS position, d AS value, count(hadm_id) AS n FROM
      (SELECT unnest({lst(V.WEEKDAYS)}) AS d, unnest(range(1, 8)) AS i) w
      LEFT JOIN admissions ON dayname(admittime) = d GROUP BY 1, 2 ORDER BY 1"""))
def _(t):
    return X.counts_in_order(t.admissions, T.day_name(F.col("admittime")), V.WEEKDAYS)


# ---- resources ----------------------------------------------------------------------------------

_STATUS = """CASE WHEN icu_beds_available = 0 THEN 'AT CAPACITY - No beds available'
    WHEN icu_occupancy_rate >= 0.9::DOUBLE THEN 'NEAR CAPACITY - Very limited availability'
    WHEN icu_occupancy_rate >= 0.7::DOUBLE THEN 'MODERATE CAPACITY' ELSE 'GOOD CAPACITY' END"""


@query("p26_capacity_status", check(f"SELECT hospital_id, {_STATUS} AS capacity_status FROM resources"))
def _(t):
    return R.resource_view(t.resources).select("hospital_id", "capacity_status")


@query("p27_overall_status", check(f"""
    WITH x AS (SELECT r.hospital_id, {_STATUS} AS st, concat_ws(', ',
        CASE WHEN absent OR NOT advanced_cardiac_care THEN 'No advanced cardiac care' END,
        CASE WHEN absent OR NOT ecmo THEN 'No ECMO' END) AS lim
      FROM resources r JOIN flags f ON r.hospital_id = f.hospital_id)
    SELECT hospital_id, CASE WHEN lim <> '' THEN st || ' | Limitations: ' || lim ELSE st END AS overall_status FROM x"""))
def _(t):
    return R.resource_view(t.resources).select("hospital_id", "overall_status")


@query("p28_resource_view", check("""
    SELECT hospital_id, ventilators_total - ventilators_available AS ventilators_in_use,
      CAST(floor(icu_occupancy_rate * 100) AS INT) || '%' AS occupancy_percentage,
      CASE WHEN s_suppkey % 6 = 0 THEN 0 WHEN s_suppkey % 2 = 0 THEN 2 ELSE 1 END AS n_specialists,
      s_suppkey % 6 <> 0 AND s_suppkey % 2 = 0 AS has_cardiac_surgeon,
      s_suppkey % 2 <> 0 AS has_interventional_cardiologist,
      s_suppkey % 6 <> 0 AND s_suppkey % 2 = 0 AS has_infectious_disease FROM resources"""))
def _(t):
    return R.resource_view(t.resources).select(
        "hospital_id", "ventilators_in_use", "occupancy_percentage", "n_specialists", "has_cardiac_surgeon",
        "has_interventional_cardiologist", "has_infectious_disease")


@query("p29_capability_lookup", check("""
    SELECT hospital_id, 'ecmo' AS capability, ecmo_available AS available,
      CASE WHEN ecmo_available THEN 'AVAILABLE' ELSE 'NOT AVAILABLE' END AS status FROM resources
    UNION ALL SELECT r.hospital_id, 'dialysis', absent OR dialysis,
      CASE WHEN absent OR dialysis THEN 'AVAILABLE' ELSE 'NOT AVAILABLE' END FROM resources r JOIN flags f ON r.hospital_id = f.hospital_id
    UNION ALL SELECT hospital_id, 'cardiac_surgeon', s_suppkey % 6 <> 0 AND s_suppkey % 2 = 0,
      CASE WHEN s_suppkey % 6 <> 0 AND s_suppkey % 2 = 0 THEN 'ON STAFF' ELSE 'NOT ON STAFF' END FROM resources
    UNION ALL SELECT hospital_id, 'mri', false, 'CAPABILITY NOT FOUND' FROM resources"""))
def _(t):
    from functools import reduce

    names = ("ecmo", "dialysis", "cardiac_surgeon", "mri")
    return reduce(lambda a, b: a.unionByName(b), [R.capability_report(t.resources, n) for n in names])


@query("p36_transfer_decisions", check("""
    SELECT request_id, target_hospital, CASE WHEN icu_beds_available > 0 THEN 'CONFIRMED' ELSE 'FAILED' END AS status,
      CASE WHEN hospital_id IS NULL THEN 'Target hospital ''' || target_hospital || ''' not found in network'
        WHEN icu_beds_available <= 0 THEN 'No ICU beds available at ' || target_hospital END AS error,
      CASE WHEN icu_beds_available > 0 THEN 'ICU_BED_' || icu_beds_available END AS bed_id,
      CASE WHEN icu_beds_available > 0 THEN CASE WHEN s_suppkey % 6 = 0 THEN 0 WHEN s_suppkey % 2 = 0 THEN 2 ELSE 1 END END AS n_specialists,
      CASE WHEN icu_beds_available > 0 THEN 60 END AS transport_minutes
    FROM requests LEFT JOIN resources ON target_hospital = hospital_id"""))
def _(t):
    return R.transfer_decisions(t.requests, t.resources)


@query("j12_transport_and_tier", check(f"""
    SELECT user_id, a AS source, b AS target, CASE WHEN a = b THEN 60
        WHEN a IN ('hospital_a', 'hospital_b') AND b IN ('hospital_a', 'hospital_b') THEN 45
        WHEN a IN ('hospital_a', 'hospital_c') AND b IN ('hospital_a', 'hospital_c') THEN 60 ELSE 75 END AS minutes
    FROM (SELECT user_id, {lst(V.SITES)}[user_id % 3 + 1] AS a, {lst(V.SITES)}[(user_id + event_id) % 3 + 1] AS b FROM events)"""))
def _(t):
    from cohortlake.sources.bindings import pick

    pairs = t.events.select(
        "user_id", pick(V.SITES, F.col("user_id")).alias("source"),
        pick(V.SITES, F.col("user_id") + F.col("event_id")).alias("target"))
    return pairs.withColumn("minutes", terms.transport_minutes(F.col("source"), F.col("target")))


@query("j13_other_sites", check("SELECT row_id, site FROM predictions WHERE site <> 'hospital_a'"))
def _(t):
    return t.predictions.filter(F.col("site") != "hospital_a").select("row_id", "site")


@query("p23_top_categories", check("""
    SELECT hadm_id, admission_location FROM admissions WHERE admission_location IN (SELECT admission_location
      FROM admissions GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5)"""))
def _(t):
    return X.top_categories(t.admissions.select("hadm_id", "admission_location"), "admission_location", 5)


@query("f10_text_forms", check("""
    SELECT insurance, 'insurance: ' || insurance AS label, printf('%.1f', round(avg(CAST(hospital_expire_flag AS DOUBLE)) * 100, 1)) || '%' AS pct,
      string_agg(DISTINCT language, ', ' ORDER BY language) AS languages FROM admissions GROUP BY insurance"""))
def _(t):
    return t.admissions.groupBy("insurance").agg(
        percent_text(F.avg(F.col("hospital_expire_flag").cast("double"))).alias("pct"),
        F.array_join(F.array_sort(F.collect_set("language")), ", ").alias("languages"),
    ).withColumn("label", F.concat(F.lit("insurance: "), "insurance"))


@query("f06_age_groups", check("""
    SELECT subject_id, CASE WHEN anchor_age <= 40 THEN '<40' WHEN anchor_age <= 60 THEN '40-60'
        WHEN anchor_age <= 75 THEN '60-75' ELSE '75+' END AS right_closed,
      CASE WHEN anchor_age < 40 THEN '<40' WHEN anchor_age < 60 THEN '40-60'
        WHEN anchor_age < 75 THEN '60-75' ELSE '75+' END AS left_closed FROM patients"""))
def _(t):
    age, labels = F.col("anchor_age"), ["<40", "40-60", "60-75", "75+"]
    return t.patients.select(
        "subject_id", bin_column(age, [0, 40, 60, 75, 100], labels, right=True).alias("right_closed"),
        bin_column(age, [0, 40, 60, 75, 150], labels, right=False).alias("left_closed"))
