"""SQL forms of the role tables, used only to check query results in another engine."""

from __future__ import annotations

import re

from cohortlake.functions import vocabulary as V
from cohortlake.sources import bindings as B


def lst(values) -> str:
    """A SQL list literal."""
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def inlist(values) -> str:
    """A parenthesised SQL value list."""
    return "(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + ")"


def pick(values, index: str) -> str:
    return f"{lst(values)}[({index}) % {len(values)} + 1]"


def bucket(key: str, salt: str = "") -> str:
    text = f"CAST({key} AS VARCHAR)"
    if salt:
        text = f"'{salt}' || {text}"
    return f"(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) % 100)"


def site_of(key: str) -> str:
    h = bucket(key)
    return (
        f"CASE WHEN {h} < 40 THEN 'hospital_a' WHEN {h} < 75 THEN 'hospital_b' ELSE 'hospital_c' END"
    )


def split_of(key: str) -> str:
    h = bucket(key, "split_")
    return f"CASE WHEN {h} < 70 THEN 'train' WHEN {h} < 85 THEN 'validation' ELSE 'test' END"


def cases(rules, default: str) -> str:
    """A CASE over (test, value) pairs of SQL text."""
    return "CASE " + " ".join(f"WHEN {test} THEN {value}" for test, value in rules) + f" ELSE {default} END"


def any_like(text: str, words) -> str:
    return "(" + " OR ".join(f"{text} LIKE '%{w}%'" for w in words) + ")"


_CARE_TYPE = cases(
    [
        (f"careunit IN {inlist(V.ICU_CAREUNITS)}", "'ICU'"),
        (f"careunit IN {inlist(V.EMERGENCY_CAREUNITS)}", "'Emergency'"),
        (any_like("careunit", V.STEP_DOWN_WORDS), "'Step-down'"),
        (f"careunit IN {inlist(V.UNITS_OF_THEIR_OWN_CLASS)}", "careunit"),
        ("careunit IS NULL", "'Unknown'"),
    ],
    "'Ward'",
)
_ICU_TYPE = cases(
    [("n_distinct_icu_units >= 3", f"'{V.MIXED_MORE}'"), ("n_distinct_icu_units = 2", f"'{V.MIXED_TWO}'")]
    + [
        (f"(icu_units = '{only}'" + (f" OR contains(icu_units, '{named}'))" if named else ")"), f"'{label}'")
        for label, named, only in V.SINGLE_UNIT_ICU_TYPES
    ],
    f"'{V.OTHER_ICU_TYPE}'",
)
_IS_ICU = f"(careunit IN {inlist(V.ICU_CAREUNITS)} OR careunit LIKE '%ICU%')"
_HOURS = "date_sub('hour', admittime, icu_intime)"

TABLES: dict[str, str] = {
    "patients": """SELECT c_custkey AS subject_id,
      CASE WHEN c_custkey % 3 = 0 THEN 'F' ELSE 'M' END AS gender,
      CAST(18 + (c_custkey * 7) % 74 AS INT) AS anchor_age,
      CAST(1996 + c_nationkey % 5 AS INT) AS anchor_year,
      CAST(1996 + c_nationkey % 5 AS INT) || ' - ' || CAST(1998 + c_nationkey % 5 AS INT) AS anchor_year_group,
      CASE WHEN c_acctbal < 500 THEN DATE '2002-01-01' + CAST(c_custkey % 365 AS INT) END AS dod
    FROM customer""",
    "admissions_0": """SELECT *, o_orderdate + to_minutes((o_orderkey * 37) % 1440) AS t0 FROM orders""",
    "admissions": f"""SELECT o_orderkey AS hadm_id, o_custkey AS subject_id, t0 AS admittime,
      t0 + to_minutes(360 + (o_orderkey * 131) % 24000) AS dischtime,
      CASE WHEN o_orderstatus = 'F' THEN t0 + to_minutes(360 + (o_orderkey * 131) % 24000) END AS deathtime,
      CASE WHEN o_orderpriority = '1-URGENT' THEN t0 - to_minutes(30 + o_orderkey % 300) END AS edregtime,
      CASE WHEN o_orderpriority = '1-URGENT' THEN t0 END AS edouttime,
      {pick(V.ADMISSION_TYPES, 'o_orderkey * 5 + o_custkey')} AS admission_type,
      {pick(V.ADMISSION_LOCATIONS, 'o_orderkey * 3')} AS admission_location,
      CASE WHEN o_orderstatus <> 'F' THEN {pick(['HOME', 'REHAB', 'HOSPICE'], 'o_orderkey')} END AS discharge_location,
      {pick(V.INSURANCES, 'o_custkey + o_orderkey % 2')} AS insurance,
      CASE WHEN o_custkey % 4 = 0 THEN 'OTHER' ELSE 'ENGLISH' END AS language,
      CASE WHEN o_orderkey % 9 <> 0 THEN {pick(V.MARITAL_STATUSES, 'o_custkey')} END AS marital_status,
      {pick(B.ETHNICITIES, 'o_custkey * 3')} AS ethnicity,
      CAST(o_orderstatus = 'F' AS INT) AS hospital_expire_flag
    FROM admissions_0""",
    "transfers_0": """SELECT l.*, o_custkey, o_orderdate + to_minutes((l_orderkey * 37) % 1440)
        + to_minutes((l_linenumber - 1) * 420 + (l_partkey * 11) % 2880) AS t0
      FROM lineitem l JOIN orders ON l_orderkey = o_orderkey""",
    "transfers": f"""SELECT l_orderkey * 1000000 + (l_partkey * 7 + l_suppkey * 3 + l_linenumber) % 1000000 AS transfer_id,
      o_custkey AS subject_id,
      CASE WHEN NOT (l_linenumber = 7 AND l_partkey % 10 = 0) THEN l_orderkey END AS hadm_id,
      {pick(B.EVENT_TYPES, 'l_linenumber + l_suppkey')} AS eventtype,
      CASE WHEN (l_partkey + l_linenumber) % 17 <> 16
        THEN {pick(B.CAREUNITS, '((l_partkey + l_linenumber) % 17)')} END AS careunit,
      t0 AS intime,
      CASE WHEN (l_partkey + l_suppkey) % 23 <> 0 THEN t0 + to_minutes(61 * CAST(l_quantity AS BIGINT)) END AS outtime
    FROM transfers_0""",
    "prescriptions": f"""SELECT l_orderkey AS hadm_id, p_name AS drug,
      {pick(B.DRUG_TYPES, 'CAST(p_size AS BIGINT)')} AS drug_type,
      CASE WHEN NOT (l_returnflag = 'N' AND l_linenumber = 1)
        THEN {pick(B.ROUTES, 'l_orderkey + l_linenumber')} END AS route
    FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "resources_0": """SELECT *, CAST(10 + s_suppkey % 7 AS INT) AS total,
      LEAST(CAST(10 + s_suppkey % 7 AS INT), GREATEST(0, CAST(floor(s_acctbal / 1000) AS INT))) AS free,
      '{"ecmo": ' || CASE WHEN s_suppkey % 2 = 0 THEN 'true' ELSE 'false' END
      || ', "cardiac_surgery": ' || CASE WHEN s_suppkey % 3 = 0 THEN 'true' ELSE 'false' END
      || ', "advanced_cardiac_care": ' || CASE WHEN s_suppkey % 5 = 0 THEN 'true' ELSE 'false' END
      || ', "dialysis": ' || CASE WHEN s_suppkey % 4 <> 0 THEN 'true' ELSE 'false' END || '}' AS flat
      FROM supplier""",
    "resources": f"""SELECT 'hospital_' || s_suppkey AS hospital_id, total AS icu_beds_total,
      free AS icu_beds_available, total - free AS icu_beds_occupied,
      (total - free) / CAST(total AS DOUBLE) AS icu_occupancy_rate,
      total * 2 AS ventilators_total, free * 2 AS ventilators_available,
      s_suppkey % 2 = 0 AS ecmo_available, s_suppkey % 3 = 0 AS cardiac_surgery_available,
      s_suppkey % 5 = 0 AS advanced_cardiac_care_available,
      CAST(20 + s_suppkey % 50 AS INT) AS total_providers,
      CASE WHEN s_suppkey % 6 = 0 THEN 'not a list'
        WHEN s_suppkey % 2 = 0 THEN '[''cardiac_surgeon'', ''infectious_disease'']'
        ELSE '["interventional_cardiologist"]' END AS specialists_on_staff,
      CASE WHEN s_suppkey % 7 = 0 THEN NULL
        WHEN s_suppkey % 3 = 1 THEN '{{"specialized_capabilities": ' || flat || '}}' ELSE flat END AS specialized_capabilities,
      {pick(B.TIERS, 'CAST(s_nationkey AS BIGINT)')} AS hospital_tier,
      s_suppkey
    FROM resources_0""",
    # capability flags without parsing: the same rules the JSON text was made from
    "flags": """SELECT hospital_id, s_suppkey % 7 = 0 AS absent,
      s_suppkey % 2 = 0 AS ecmo, s_suppkey % 3 = 0 AS cardiac_surgery,
      s_suppkey % 5 = 0 AS advanced_cardiac_care, s_suppkey % 4 <> 0 AS dialysis FROM resources""",
    "dim_patient": """SELECT p.subject_id, gender, anchor_age, anchor_year, anchor_year_group,
      dod AS death_date, CAST(dod IS NOT NULL AS INT) AS is_deceased,
      a.ethnicity, a.marital_status, a.language, a.insurance
    FROM patients p LEFT JOIN (SELECT * FROM admissions
      QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY admittime, hadm_id) = 1) a
      ON p.subject_id = a.subject_id""",
    "fact_admission": """SELECT a.*, date_sub('day', admittime, dischtime) AS los_hospital_days,
      date_sub('hour', admittime, dischtime) AS los_hospital_hours,
      CAST(anchor_age + year(admittime) - anchor_year AS INT) AS age_at_admission
    FROM admissions a JOIN patients p ON a.subject_id = p.subject_id""",
    "fact_transfers": f"""SELECT transfer_id, subject_id, hadm_id, eventtype, careunit, intime, outtime,
      date_sub('hour', intime, outtime) AS los_hours, {_CARE_TYPE} AS care_type FROM transfers""",
    "icu_groups": f"""SELECT subject_id, hadm_id, min(intime) AS icu_intime, max(outtime) AS icu_outtime,
      min(transfer_id) AS first_icu_transfer_id,
      string_agg(DISTINCT careunit, ',' ORDER BY careunit) AS icu_units,
      count(DISTINCT careunit) AS n_distinct_icu_units,
      first(careunit ORDER BY intime, transfer_id, careunit) AS first_careunit
    FROM transfers WHERE careunit IS NOT NULL AND {_IS_ICU} GROUP BY subject_id, hadm_id""",
    "icu_stays": f"""SELECT subject_id, hadm_id, first_icu_transfer_id, icu_intime, icu_outtime,
      date_sub('hour', icu_intime, icu_outtime) AS los_icu_hours,
      date_sub('day', icu_intime, icu_outtime) AS los_icu_days, icu_units, first_careunit,
      n_distinct_icu_units,
      {_ICU_TYPE} AS icu_type,
      CAST(n_distinct_icu_units > 1 AS INT) AS is_mixed_icu FROM icu_groups""",
    "numbered_stays": """SELECT row_number() OVER (ORDER BY subject_id NULLS FIRST, hadm_id NULLS FIRST) AS stay_id,
      * FROM icu_stays""",
    "site_stays": f"""SELECT s.* EXCLUDE (icu_units, first_icu_transfer_id), age_at_admission,
      los_hospital_days, los_hospital_hours, admission_type, admission_location, a.insurance,
      gender, p.ethnicity, p.marital_status,
      (SELECT count(*) FROM fact_transfers t WHERE t.hadm_id = s.hadm_id AND care_type = 'ICU') AS n_icu_transfers,
      (SELECT count(*) FROM fact_transfers t WHERE t.hadm_id = s.hadm_id) AS n_total_transfers,
      CAST(admission_location LIKE '%EMERGENCY%' AS INT) AS ed_admission_flag,
      CAST(admission_type = 'EMERGENCY' AS INT) AS emergency_admission_flag,
      {_HOURS} AS hours_admit_to_icu,
      CASE WHEN {_HOURS} < 6 THEN 3 WHEN {_HOURS} < 24 THEN 2 WHEN {_HOURS} < 48 THEN 1 ELSE 0 END AS early_icu_score,
      CAST(dayofweek(admittime) + 1 IN (1, 7) AS INT) AS weekend_admission,
      CAST(hour(admittime) >= 18 OR hour(admittime) < 6 AS INT) AS night_admission,
      hospital_expire_flag, deathtime, death_date,
      {site_of('s.subject_id')} AS assigned_hospital, {split_of('s.subject_id')} AS data_split,
      CAST(hospital_expire_flag = 1 AS INT) AS icu_mortality_label
    FROM icu_stays s JOIN fact_admission a ON s.hadm_id = a.hadm_id
      JOIN dim_patient p ON s.subject_id = p.subject_id""",
    "predictions": f"""SELECT o_orderkey AS row_id, o_custkey AS subject_id, o_orderdate AS scored_at,
      CAST(o_orderstatus = 'F' AS INT) AS y_true,
      (((o_orderkey * 31 + o_custkey * 17) % 1000) * 6 + CAST(o_orderstatus = 'F' AS INT) * 3000 + 500) / CAST(10000 AS DOUBLE) AS score,
      CASE WHEN o_custkey % 3 = 0 THEN 'F' ELSE 'M' END AS gender,
      CAST(18 + (o_custkey * 7) % 74 AS INT) AS age,
      {pick(V.INSURANCES, 'o_custkey + o_orderkey % 2')} AS insurance,
      CASE WHEN o_custkey % 11 <> 0 THEN {pick(B.ETHNICITIES, 'o_custkey * 3')} END AS race,
      {site_of('o_custkey')} AS site, {split_of('o_custkey')} AS data_split
    FROM orders""",
    "access_events": f"""SELECT 'evt_' || event_id AS event_id, event_id AS n, ts AS event_timestamp,
      'user_' || user_id AS user_id,
      CASE WHEN user_id % 5 <> 0 THEN {pick(['clinician', 'nurse'], 'user_id')} END AS user_role,
      {pick(B.ACTIONS, 'event_id')} AS kind, {pick(V.SITES, 'user_id')} AS hospital_id,
      {pick(V.SITES, 'user_id + 1')} AS target_hospital,
      CAST(18 + (user_id * 7) % 74 AS INT) AS age,
      (event_id * 7 % 101) / CAST(100 AS DOUBLE) AS risk_score,
      CASE WHEN event_id % 4 <> 0 THEN event_type END AS query_type, event_type AS reason,
      {pick(V.ADMISSION_TYPES, 'event_id')} AS admission_type,
      CASE WHEN event_id % 3 <> 0 THEN {pick(V.ICU_TYPES, 'event_id')} END AS icu_type,
      CAST(event_id % 4 AS INT) AS early_icu_score FROM events""",
    "requests": f"""SELECT event_id AS request_id, {pick(V.SITES, 'user_id')} AS requesting_hospital,
      'hospital_' || (event_id % 120) AS target_hospital,
      CASE WHEN event_id % 17 <> 0 THEN {pick(B.FREE_TERMS, 'event_id')} END AS admission_text,
      CASE WHEN event_id % 13 <> 0 THEN {pick(B.FREE_TERMS, 'event_id + 6')} END AS icu_text,
      CASE WHEN event_id % 19 <> 0 THEN {pick(B.FREE_TERMS, 'event_id + 10')} END AS location_text,
      {pick(['m', ' Female', 'MAN', 'w', 'F'], 'event_id')} AS gender_text,
      CAST((event_id % 7) - 1 AS INT) AS score_text,
      {pick(['ecmo', 'cardiac_surgery', 'advanced_cardiac_care', 'dialysis', 'cardiac_surgeon', 'mechanical_ventilation', 'mri'], 'event_id')} AS capability,
      round((event_id * 13 % 1000) / CAST(1000 AS DOUBLE), 3) AS risk_score FROM events""",
    "runs_0": """SELECT l_suppkey AS run_id, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS r,
      count(*) FILTER (l_linestatus = 'O') AS o, max(l_shipdate) AS finished_at FROM lineitem GROUP BY 1""",
    "runs": f"""SELECT run_id, finished_at, n AS n_examples,
      {pick(['0.001', '0.01', '0.1'], 'run_id')} AS learning_rate,
      {pick(['1', '2'], 'run_id * 3 + 1')} AS local_epochs,
      {pick(['adam', 'sgd'], 'CAST(floor(run_id / 3) AS BIGINT)')} AS optimizer, '64' AS batch_size,
      r / CAST(n AS DOUBLE) AS val_auc, o / CAST(n AS DOUBLE) AS recall,
      (n - r) / CAST(n AS DOUBLE) AS accuracy FROM runs_0""",
    "site_weights": """SELECT CAST(CAST(floor(vec_id / 3) AS BIGINT) % 4 AS INT) AS round, vec_id AS client_id,
      10 + vec_id % 90 AS n_examples, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS weights FROM embeddings""",
}


def check(body: str) -> str:
    """``body`` with the role tables it names put in front as common table expressions."""
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name in TABLES:
            if name not in needed and re.search(rf"\b{name}\b", sql):
                visit(TABLES[name])
                needed.append(name)

    visit(body)
    if not needed:
        return body
    ctes = ",\n".join(f"{name} AS ({TABLES[name]})" for name in needed)
    stripped = body.lstrip()
    if stripped.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{stripped[15:]}"
    if stripped.upper().startswith("WITH "):
        return f"WITH {ctes},\n{stripped[5:]}"
    return f"WITH {ctes}\n{body}"
