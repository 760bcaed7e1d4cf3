"""Projection, predicate, classification and scalar-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlake.functions import clinical as C, scalars as SC, temporal as T, terms, vocabulary as V
from cohortlake.operators import audit, cohorts, curated, prep
from cohortlake.plans.checks import check, inlist, lst
from cohortlake.plans.registry import query
from cohortlake.plans.term_checks import (
    ADMISSION_MAP, GENDER, ICU_MAP, LOCATION_MAP, NORMALISED, TERM_TABLES, category, icu_category,
)
from cohortlake.sources.tables import scan_split

# ---- projections and predicates ---------------------------------------------------


@query("p01_projection_rename", check("""
    SELECT subject_id, gender, anchor_age, dod AS death_date FROM patients"""))
def _(t):
    return t.patients.select("subject_id", "gender", "anchor_age", F.col("dod").alias("death_date"))


@query("p02_star_plus_columns", check(f"""
    SELECT a.*, p.gender, CAST(a.hospital_expire_flag = 1 AS INT) AS icu_mortality_label
    FROM admissions a JOIN patients p ON a.subject_id = p.subject_id"""))
def _(t):
    who = t.patients.select("subject_id", "gender")
    return t.admissions.join(who, "subject_id").select(
        *[F.col(c) for c in t.admissions.columns], "gender",
        (F.col("hospital_expire_flag") == 1).cast("int").alias("icu_mortality_label"))


query("p03_care_type", check("SELECT transfer_id, careunit, los_hours, care_type FROM fact_transfers"))(
    lambda t: t.fact_transfers.select("transfer_id", "careunit", "los_hours", "care_type"))


@query("p04_icu_predicate", check(f"""
    SELECT transfer_id, careunit, CAST(coalesce(careunit IN {inlist(V.ICU_CAREUNITS)} OR careunit LIKE '%ICU%', false) AS INT) AS is_icu
    FROM transfers"""))
def _(t):
    return t.transfers.select("transfer_id", "careunit", C.is_icu_unit(F.col("careunit")).alias("is_icu"))


query("p05_icu_type", check("SELECT subject_id, hadm_id, icu_units, icu_type FROM icu_stays"))(
    lambda t: t.icu_stays.select("subject_id", "hadm_id", "icu_units", "icu_type"))
query("p06_mixed_flag", check("SELECT subject_id, hadm_id, is_mixed_icu FROM icu_stays"))(
    lambda t: t.icu_stays.select("subject_id", "hadm_id", "is_mixed_icu"))


@query("p07_ed_flag", check("""
    SELECT hadm_id, CAST(admission_location LIKE '%EMERGENCY%' AS INT) AS ed_admission_flag FROM admissions"""))
def _(t):
    return t.admissions.select("hadm_id", C.ed_flag(F.col("admission_location")).alias("ed_admission_flag"))


@query("p08_emergency_flag", check(f"""
    SELECT hadm_id, CAST(admission_type = 'EMERGENCY' AS INT) AS literal_flag,
      CAST(admission_type IN {inlist(V.EMERGENCY_ADMISSION_TYPES)} AS INT) AS stored_flag FROM admissions"""))
def _(t):
    kind = F.col("admission_type")
    return t.admissions.select(
        "hadm_id", C.emergency_flag(kind).alias("literal_flag"),
        C.emergency_flag(kind, V.EMERGENCY_ADMISSION_TYPES).alias("stored_flag"))


_EARLY = "date_sub('hour', admittime, icu_intime)"


@query("p09_early_score", check(f"""
    SELECT s.hadm_id, {_EARLY} AS hours_admit_to_icu, CASE WHEN {_EARLY} < 6 THEN 3 WHEN {_EARLY} < 24 THEN 2
      WHEN {_EARLY} < 48 THEN 1 ELSE 0 END AS early_icu_score
    FROM icu_groups s JOIN admissions a ON s.hadm_id = a.hadm_id"""))
def _(t):
    starts = t.admissions.select("hadm_id", "admittime")
    hours = T.whole_units("HOUR", F.col("admittime"), F.col("icu_intime"))
    joined = curated.icu_groups(t.transfers).select("hadm_id", "icu_intime").join(starts, "hadm_id")
    return joined.select("hadm_id", hours.alias("hours_admit_to_icu"), C.early_score(hours).alias("early_icu_score"))


@query("p10_weekend_flag", "SELECT event_id, CAST(dayofweek(ts) IN (0, 6) AS INT) AS weekend FROM events")
def _(t):
    return t.events.select("event_id", T.weekend_flag(F.col("ts")).alias("weekend"))


@query("p11_night_flag", "SELECT event_id, CAST(hour(ts) >= 18 OR hour(ts) < 6 AS INT) AS night FROM events")
def _(t):
    return t.events.select("event_id", T.night_flag(F.col("ts")).alias("night"))


_TEXTS = """texts AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN upper(dayname(ts)) || '_NIGHT' WHEN 1 THEN dayname(ts) || ' Morning'
    WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 3 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 4 THEN 'soon' END AS txt,
    try_strptime(CASE WHEN event_id % 6 IN (2, 3) THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') END, '%Y-%m-%dT%H:%M:%S') AS p FROM events)"""


def _time_texts(t):
    key, ts = F.col("event_id"), F.col("ts")
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    day = F.date_format(ts, "EEEE")
    text = (
        F.when(key % 6 == 0, F.concat(F.upper(day), F.lit("_NIGHT")))
        .when(key % 6 == 1, F.concat(day, F.lit(" Morning"))).when(key % 6 == 2, iso)
        .when(key % 6 == 3, F.concat(iso, F.lit("Z"))).when(key % 6 == 4, "soon"))
    return t.events.select("event_id", text.alias("txt"))


@query("p12_flags_from_text", f"""
    WITH {_TEXTS} SELECT event_id, txt,
      CAST(CASE WHEN regexp_matches(upper(txt), 'SATURDAY|SUNDAY|WEEKEND') THEN 1
        WHEN regexp_matches(upper(txt), 'MONDAY|TUESDAY|WEDNESDAY|THURSDAY|FRIDAY|WEEKDAY') THEN 0
        ELSE coalesce(CAST(dayofweek(p) IN (0, 6) AS INT), 0) END AS INT) AS weekend,
      CAST(CASE WHEN regexp_matches(upper(txt), 'NIGHT|EVENING|PM') THEN 1
        WHEN regexp_matches(upper(txt), 'MORNING|AFTERNOON|DAY|AM') THEN 0
        ELSE coalesce(CAST(hour(p) >= 18 OR hour(p) < 6 AS INT), 0) END AS INT) AS night FROM texts""")
def _(t):
    return _time_texts(t).select(
        "event_id", "txt", T.weekend_from_text(F.col("txt"), 0).alias("weekend"),
        T.night_from_text(F.col("txt"), 0).alias("night"))


@query("p13_presence_flags", check("""
    SELECT subject_id, CAST(dod IS NOT NULL AS INT) AS is_deceased FROM patients"""))
def _(t):
    return t.patients.select("subject_id", C.present_flag(F.col("dod")).alias("is_deceased"))


@query("p14_site_filter", check("SELECT row_id, site, data_split FROM predictions WHERE site = 'hospital_c'"))
def _(t):
    return t.predictions.filter(F.col("site") == "hospital_c").select("row_id", "site", "data_split")


@query("p15_null_and_flag_filter", check(f"""
    SELECT transfer_id, careunit FROM transfers WHERE careunit IS NOT NULL AND
      (careunit IN {inlist(V.ICU_CAREUNITS)} OR careunit LIKE '%ICU%')"""))
def _(t):
    unit = F.col("careunit")
    return t.transfers.filter(unit.isNotNull() & (C.is_icu_unit(unit) == 1)).select("transfer_id", "careunit")


@query("p16_tolerance_filter", check("SELECT subject_id, anchor_age FROM patients WHERE anchor_age BETWEEN 60 AND 70"))
def _(t):
    return t.patients.filter(cohorts.optional("anchor_age", 65 - 5, 65 + 5)).select("subject_id", "anchor_age")


@query("p17_set_membership", check(f"""
    SELECT hadm_id, admission_type FROM admissions WHERE admission_type IN {inlist(V.ADMISSION_TYPE_TERMS['obs'])}"""))
def _(t):
    test = cohorts.restrict_types("admission_type", V.ADMISSION_TYPE_TERMS["obs"], V.ADMISSION_TYPES)
    return t.admissions.filter(test).select("hadm_id", "admission_type")


@query("p18_optional_filters", check("""
    SELECT row_id, age, insurance FROM predictions WHERE age >= 50 AND insurance IN ('Medicare', 'Private')"""))
def _(t):
    test = cohorts.all_of(
        cohorts.optional("age", low=50), cohorts.optional("score"), None,
        cohorts.optional("insurance", among=["Medicare", "Private"]))
    return t.predictions.filter(test).select("row_id", "age", "insurance")


@query("p19_split_membership", check("""
    SELECT row_id, data_split FROM predictions WHERE data_split IN ('train', 'validation')"""))
def _(t):
    return scan_split(t.predictions, "train", "validation").select("row_id", "data_split")


@query("p20_look_back", check("""
    SELECT action_category, count(*) AS n, count(DISTINCT user_id) AS n_users FROM
      (SELECT CASE kind WHEN 'patient_transfer' THEN 'transfer' WHEN 'transfer_receipt' THEN 'incoming_transfer'
        WHEN 'privacy_operation' THEN 'privacy' ELSE kind END AS action_category, * FROM access_events
       WHERE event_timestamp >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 72 HOUR
         AND event_timestamp <= TIMESTAMP '2024-01-20 12:00:00') GROUP BY 1"""))
def _(t):
    anchor = F.lit("2024-01-20 12:00:00").cast("timestamp")
    found = audit.look_back(audit.with_event_date(audit.build_records(t.access_events)), anchor, 72, limit=None)
    return found.groupBy("action_category").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("n_users"))


@query("p20b_audit_trail", check("""
    SELECT event_timestamp, user_id, query_type FROM access_events
    WHERE kind = 'external_query' AND query_type = 'view' AND event_timestamp >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 240 HOUR
      AND event_timestamp <= TIMESTAMP '2024-01-20 12:00:00' ORDER BY event_timestamp DESC LIMIT 100"""))
def _(t):
    anchor = F.lit("2024-01-20 12:00:00").cast("timestamp")
    log = audit.build_records(t.access_events)
    return audit.look_back(log, anchor, 240, query_type="view").select(
        F.col("event_timestamp").cast("timestamp_ntz").alias("event_timestamp"), "user_id", "query_type")


@query("p22_drop_columns", check("""
    SELECT * EXCLUDE (subject_id, hadm_id, deathtime) FROM admissions"""))
def _(t):
    return t.admissions.drop(*V.EXCLUDED_COLUMNS)


@query("p30_default_fill", check("""
    SELECT hadm_id, coalesce(marital_status, 'UNKNOWN') AS marital_status,
      CAST(hour(admittime) >= 18 OR hour(admittime) < 6 AS INT) AS night_admission,
      CAST(dayofweek(admittime) IN (0, 6) AS INT) AS weekend_admission,
      CAST(admission_location LIKE '%EMERGENCY%' AS INT) AS ed_admission_flag,
      CASE WHEN h < 6 THEN 3 WHEN h < 24 THEN 2 WHEN h < 48 THEN 1 ELSE 0 END AS early_icu_score,
      h AS los_hospital_hours, h / 24.0::DOUBLE AS los_hospital_days, 65 AS age_at_admission, 'Medical ICU' AS icu_type
    FROM (SELECT *, CAST(hadm_id % 60 AS DOUBLE) AS h FROM admissions)"""))
def _(t):
    partial = t.admissions.select(
        "hadm_id", "admittime", "admission_location", "admission_type", "marital_status",
        (F.col("hadm_id") % 60).cast("double").alias("hours_admit_to_icu"))
    return prep.complete_features(partial, keep=["hadm_id"]).select(
        "hadm_id", "marital_status", "night_admission", "weekend_admission", "ed_admission_flag", "early_icu_score",
        "los_hospital_hours", "los_hospital_days", "age_at_admission", "icu_type")


@query("p31_prediction_mode", check("""
    SELECT hadm_id, CASE WHEN coalesce(los_icu_hours, 0) > 0 OR n_icu_transfers > 0 THEN 'UPDATED' ELSE 'ADMISSION-TIME' END AS prediction_mode
    FROM site_stays"""))
def _(t):
    return t.site_stays.select(
        "hadm_id", C.prediction_mode(F.col("los_icu_hours"), F.col("n_icu_transfers")).alias("prediction_mode"))


@query("p32_key_factors", check("""
    SELECT hadm_id, list_filter([
      CASE WHEN early_icu_score >= 2 THEN 'early_icu_score: ' || CASE WHEN early_icu_score = 3 THEN 'Very early' ELSE 'Early' END || ' ICU admission indicates critical illness' END,
      CASE WHEN age_at_admission >= 75 THEN 'age_at_admission: Advanced age (' || age_at_admission || ' years) increases baseline mortality risk' END,
      CASE WHEN n_icu_transfers > 0 THEN 'n_icu_transfers: ' || n_icu_transfers || ' ICU transfer(s) indicate complications' END,
      CASE WHEN los_icu_hours > 48 THEN 'los_icu_hours: Extended ICU stay (' || los_icu_hours || ' hours) indicates severity' END],
      lambda x: x IS NOT NULL)[1:3] AS key_factors FROM site_stays"""))
def _(t):
    return t.site_stays.select("hadm_id", C.key_factors().alias("key_factors"))


@query("p33_clamp", """
    SELECT event_id, greatest(0.0::DOUBLE, least(1.0::DOUBLE, value / 50.0::DOUBLE)) AS unit,
      CAST(greatest(0, least(3, event_id % 7 - 2)) AS INT) AS score FROM events""")
def _(t):
    score = C.valid_early_score(F.col("event_id") % 7 - 2)
    return t.events.select("event_id", SC.clamp(F.col("value") / 50.0, 0.0, 1.0).alias("unit"), score.alias("score"))


@query("p35_analysis_flags", check(f"""
    SELECT hadm_id, CAST(language = 'ENGLISH' AS INT) AS is_english,
      CAST(admission_type IN {inlist(V.ACUTE_ADMISSION_TYPES)} AS INT) AS is_emergency FROM admissions"""))
def _(t):
    return t.admissions.select(
        "hadm_id", (F.col("language") == "ENGLISH").cast("int").alias("is_english"),
        C.emergency_flag(F.col("admission_type"), V.ACUTE_ADMISSION_TYPES).alias("is_emergency"))


@query("j14_term_mapping", check(f"""
    WITH {TERM_TABLES}, d AS (SELECT DISTINCT admission_text, icu_text, location_text FROM requests),
    m AS (SELECT *, {ADMISSION_MAP} AS admission_types, {ICU_MAP} AS icu_types, {LOCATION_MAP} AS locations FROM d)
    SELECT request_id, admission_types, icu_types, locations FROM requests r JOIN m ON
      r.admission_text IS NOT DISTINCT FROM m.admission_text AND r.icu_text IS NOT DISTINCT FROM m.icu_text
      AND r.location_text IS NOT DISTINCT FROM m.location_text"""))
def _(t):
    return t.requests.select(
        "request_id", terms.ADMISSION_TYPE.values(F.col("admission_text")).alias("admission_types"),
        terms.ICU_TYPE.values(F.col("icu_text")).alias("icu_types"),
        terms.ADMISSION_LOCATION.values(F.col("location_text")).alias("locations"))


@query("j14b_network_term_mapping", check(f"""
    WITH {TERM_TABLES}, va AS (SELECT unnest({lst(V.ADMISSION_TYPES)}) AS v, unnest(range(9)) AS p),
    d AS (SELECT DISTINCT admission_text, icu_text FROM requests),
    m AS (SELECT *, CASE WHEN admission_text IS NULL THEN {lst(V.EMERGENCY_ADMISSION_TYPES)} ELSE coalesce(
        (SELECT [v] FROM va WHERE v = admission_text),
        (SELECT vals FROM nadm WHERE term = {NORMALISED}), (SELECT vals FROM nadm WHERE term = rtrim({NORMALISED}, '.')),
        (SELECT [v] FROM va WHERE contains(lower(v), {NORMALISED}) OR contains({NORMALISED}, lower(v)) ORDER BY p LIMIT 1),
        (SELECT vals FROM nadm WHERE contains({NORMALISED}, term) OR contains(term, {NORMALISED}) ORDER BY p LIMIT 1),
        {lst(V.EMERGENCY_ADMISSION_TYPES)}) END AS admission_types,
      CASE WHEN icu_text IS NULL THEN {lst(V.ICU_TYPES)} ELSE coalesce(
        (SELECT [v] FROM (SELECT unnest({lst(V.ICU_TYPES)}) AS v) WHERE v = icu_text),
        (SELECT vals FROM nicu WHERE term = lower(trim(icu_text))),
        (SELECT vals FROM nicu WHERE contains(lower(trim(icu_text)), term) OR contains(term, lower(trim(icu_text))) ORDER BY p LIMIT 1),
        {lst(V.ICU_TYPES)}) END AS icu_types FROM d)
    SELECT request_id, admission_types, icu_types FROM requests r JOIN m ON
      r.admission_text IS NOT DISTINCT FROM m.admission_text AND r.icu_text IS NOT DISTINCT FROM m.icu_text"""))
def _(t):
    return t.requests.select(
        "request_id", terms.NETWORK_ADMISSION_TYPE.values(F.col("admission_text")).alias("admission_types"),
        terms.NETWORK_ICU_TYPE.values(F.col("icu_text")).alias("icu_types"))


@query("p37_parameter_validation", check(f"""
    WITH {TERM_TABLES}, d AS (SELECT DISTINCT admission_text, icu_text FROM requests),
    m AS (SELECT *, ({ADMISSION_MAP})[1] AS a1, ({ICU_MAP})[1] AS i1,
      admission_text IN ('unknown thing', 'x-ray', 'cardiac', 'TSICU') AS odd_a FROM d),
    w AS (SELECT *, admission_text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM adm WHERE contains(lower(trim(admission_text)), term)
        OR contains(term, lower(trim(admission_text)))) AND lower(trim(admission_text)) NOT IN {inlist([v.lower() for v in V.ADMISSION_TYPES])} AS wa,
      icu_text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM icu WHERE contains(lower(trim(icu_text)), term)
        OR contains(term, lower(trim(icu_text)))) AND lower(trim(icu_text)) NOT IN {inlist([v.lower() for v in V.ICU_TYPES])} AS wi FROM m)
    SELECT request_id, a1 AS admission_type_primary, {category('a1')} AS admission_type_category,
      i1 AS icu_type_primary, {icu_category('i1')} AS icu_type_category,
      CAST(CASE WHEN score_text IS NULL THEN 2 ELSE greatest(0, least(3, score_text)) END AS INT) AS early_icu_score, {GENDER} AS gender,
      list_filter([CASE WHEN wa THEN 'Admission type ''' || r.admission_text || ''' not recognized' END,
        CASE WHEN wi THEN 'ICU type ''' || r.icu_text || ''' not recognized' END], lambda x: x IS NOT NULL) AS warnings
    FROM requests r JOIN w ON r.admission_text IS NOT DISTINCT FROM w.admission_text AND r.icu_text IS NOT DISTINCT FROM w.icu_text"""))
def _(t):
    checked = terms.validate_parameters(
        F.col("admission_text"), F.col("icu_text"), F.col("score_text"), F.col("gender_text"))
    return t.requests.select("request_id", checked.alias("v")).select(
        "request_id", "v.admission_type_primary", "v.admission_type_category", "v.icu_type_primary",
        "v.icu_type_category", "v.early_icu_score", "v.gender", "v.warnings")


@query("p38_gender_code", check(f"SELECT request_id, gender_text, {GENDER} AS gender FROM requests"))
def _(t):
    return t.requests.select("request_id", "gender_text", C.gender_code(F.col("gender_text")).alias("gender"))


@query("p39_categories", check(f"""
    SELECT request_id, {category('admission_text')} AS admission_category, {icu_category('icu_text')} AS icu_category FROM requests"""))
def _(t):
    return t.requests.select(
        "request_id", C.admission_category(F.col("admission_text")).alias("admission_category"),
        C.icu_category(F.col("icu_text")).alias("icu_category"))


# ---- scalar functions ------------------------------------------------------------------


@query("f01_whole_units", check("""
    SELECT hadm_id, date_sub('hour', admittime, dischtime) AS hours, date_sub('day', admittime, dischtime) AS days,
      date_sub('hour', dischtime, admittime) AS back_hours FROM admissions"""))
def _(t):
    a, b = F.col("admittime"), F.col("dischtime")
    return t.admissions.select(
        "hadm_id", T.whole_units("HOUR", a, b).alias("hours"), T.whole_units("DAY", a, b).alias("days"),
        T.whole_units("HOUR", b, a).alias("back_hours"))


@query("f02_elapsed", check("""
    SELECT hadm_id, (epoch_us(dischtime) - epoch_us(admittime)) / CAST(86400000000 AS DOUBLE) AS days,
      (epoch_us(edouttime) - epoch_us(edregtime)) / CAST(3600000000 AS DOUBLE) AS ed_hours FROM admissions"""))
def _(t):
    return t.admissions.select(
        "hadm_id", T.elapsed_days(F.col("admittime"), F.col("dischtime")).alias("days"),
        T.elapsed_hours(F.col("edregtime"), F.col("edouttime")).alias("ed_hours"))


@query("f03_age_at_event", check("SELECT hadm_id, age_at_admission FROM fact_admission"))
def _(t):
    return t.fact_admission.select("hadm_id", "age_at_admission")


@query("f04_date_parts", """
    SELECT event_id, CAST(year(ts) AS INT) AS y, CAST(hour(ts) AS INT) AS h, CAST(dayofweek(ts) + 1 AS INT) AS dow,
      dayname(ts) AS day_name FROM events""")
def _(t):
    ts = F.col("ts")
    return t.events.select(
        "event_id", F.year(ts).alias("y"), F.hour(ts).alias("h"), F.dayofweek(ts).alias("dow"),
        T.day_name(ts).alias("day_name"))


@query("f05_shift", """
    SELECT CASE WHEN hour(ts) <= 7 THEN 'Night (0-7)' WHEN hour(ts) <= 15 THEN 'Day (8-15)' ELSE 'Evening (16-23)' END AS shift,
      count(*) AS n FROM events GROUP BY 1""")
def _(t):
    return t.events.groupBy(T.shift_of(F.hour("ts")).alias("shift")).agg(F.count(F.lit(1)).alias("n"))


@query("f07_iso_parse", f"""
    WITH {_TEXTS} SELECT event_id, p AS parsed, coalesce(p, TIMESTAMP '2000-01-01') AS with_fallback FROM texts""")
def _(t):
    parsed = T.parse_iso(F.col("txt")).cast("timestamp_ntz")
    fallback = F.lit("2000-01-01").cast("timestamp_ntz")
    return _time_texts(t).select(
        "event_id", parsed.alias("parsed"), F.coalesce(parsed, fallback).alias("with_fallback"))


@query("f08_look_back_anchor", "SELECT event_id, ts - INTERVAL 36 HOUR AS anchor FROM events")
def _(t):
    return t.events.select("event_id", T.look_back(F.col("ts"), 36).alias("anchor"))


@query("f09_text_tests", """
    SELECT p_partkey, p_type LIKE '%ECO%' AS has_eco, lower(p_name) AS lowered, upper(trim(p_type)) AS raised,
      contains(p_name, 'ring') AS has_ring, contains('small ring', p_name) AS inside, rtrim(p_brand, '0123456789') AS stem FROM part""")
def _(t):
    return t.raw("part").select(
        "p_partkey", F.col("p_type").like("%ECO%").alias("has_eco"), F.lower("p_name").alias("lowered"),
        F.upper(F.trim("p_type")).alias("raised"), F.contains(F.col("p_name"), F.lit("ring")).alias("has_ring"),
        F.contains(F.lit("small ring"), F.col("p_name")).alias("inside"),
        F.regexp_replace("p_brand", "[0-9]+$", "").alias("stem"))


@query("f11_arithmetic", """
    SELECT event_id, round(value, 1) AS rounded, abs(value - 20) AS gap, CAST(event_id % 7 AS INT) AS remainder FROM events""")
def _(t):
    return t.events.select(
        "event_id", F.round("value", 1).alias("rounded"), F.abs(F.col("value") - 20).alias("gap"),
        F.pmod("event_id", F.lit(7)).cast("int").alias("remainder"))


@query("f12_lenient_casts", """
    SELECT event_id, coalesce(TRY_CAST(txt AS INT), -1) AS as_int, coalesce(TRY_CAST(txt AS DOUBLE), 0) AS as_double,
      coalesce(txt, 'none') AS as_text, coalesce(CASE txt WHEN 'true' THEN true WHEN 'false' THEN false END, false) AS as_bool
    FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN 'abc' WHEN 2 THEN 'true' WHEN 3 THEN 'NaN' END AS txt FROM events)
    WHERE txt IS NULL OR txt <> 'NaN' UNION ALL SELECT event_id, -1, 0, 'NaN', false FROM events WHERE event_id % 5 = 3""")
def _(t):
    key = F.col("event_id")
    txt = F.when(key % 5 == 0, key.cast("string")).when(key % 5 == 1, "abc").when(key % 5 == 2, "true").when(key % 5 == 3, "NaN")
    return t.events.select(
        "event_id", SC.cast_or(txt, "int", -1).alias("as_int"), SC.cast_or(txt, "double", 0.0).alias("as_double"),
        SC.cast_or(txt, "string", "none").alias("as_text"),
        SC.cast_or(F.when(txt.isin("true", "false"), txt), "boolean", False).alias("as_bool"))


@query("f15_arrays", check("""
    SELECT drug, list_sort(list(DISTINCT route) FILTER (route IS NOT NULL))[1:3] AS first_three,
      list_sort(list(DISTINCT route) FILTER (route IS NOT NULL))[1] AS first_one,
      list_contains(list(DISTINCT route), 'IV') AS has_iv, CAST(count(DISTINCT route) AS INT) AS n_routes FROM prescriptions GROUP BY drug"""))
def _(t):
    found = t.prescriptions.groupBy("drug").agg(F.array_sort(F.collect_set("route")).alias("r"))
    return found.select(
        "drug", F.slice("r", 1, 3).alias("first_three"), F.get("r", F.lit(0)).alias("first_one"),
        F.array_contains("r", "IV").alias("has_iv"), F.size("r").alias("n_routes"))


@query("f16_capability_flags", check("""
    SELECT hospital_id, NOT absent AND ecmo AS ecmo, NOT absent AND dialysis AS dialysis, false AS mri FROM flags"""))
def _(t):
    from cohortlake.functions.capacity import capability

    flags = SC.flag_map(F.col("specialized_capabilities"))
    return t.resources.select(
        "hospital_id", capability(flags, "ecmo").alias("ecmo"), capability(flags, "dialysis").alias("dialysis"),
        capability(flags, "mri").alias("mri"))


@query("f17_lenient_list", check("""
    SELECT hospital_id, CASE WHEN s_suppkey % 6 = 0 THEN CAST([] AS VARCHAR[]) WHEN s_suppkey % 2 = 0 THEN ['cardiac_surgeon', 'infectious_disease']
      ELSE ['interventional_cardiologist'] END AS specialists FROM resources"""))
def _(t):
    return t.resources.select("hospital_id", SC.lenient_list(F.col("specialists_on_staff")).alias("specialists"))


_JSON = """'{"discharge_location":' || coalesce('"' || discharge_location || '"', 'null') || ',"hadm_id":' || hadm_id
    || ',"insurance":"' || insurance || '"}'"""


@query("f18_canonical_json", check(f"SELECT hadm_id, {_JSON} AS body FROM admissions"))
def _(t):
    return t.admissions.select("hadm_id", SC.canonical_json(["insurance", "hadm_id", "discharge_location"]).alias("body"))


@query("f19_sha256", check(f"SELECT hadm_id, sha256({_JSON}) AS digest, substr(sha256({_JSON}), 1, 16) AS short FROM admissions"))
def _(t):
    digest = F.sha2(SC.canonical_json(["insurance", "hadm_id", "discharge_location"]), 256)
    return t.admissions.select("hadm_id", digest.alias("digest"), F.substring(digest, 1, 16).alias("short"))


@query("f20_hash_buckets", """
    SELECT c_custkey, CAST('0x' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 8) AS BIGINT) % 100 AS site_bucket,
      CAST('0x' || substr(md5('split_' || c_custkey), 1, 8) AS BIGINT) % 100 AS split_bucket FROM customer""")
def _(t):
    key = F.col("c_custkey")
    return t.raw("customer").select(
        "c_custkey", SC.stable_bucket(key).alias("site_bucket"), SC.stable_bucket(key, "split_").alias("split_bucket"))


@query("f21_log_ids")
def _(t):
    return t.events.select("event_id", SC.log_id("log", F.col("ts")).alias("log_id"))


@query("f21b_log_id_form", "SELECT count(*) AS n, count(DISTINCT event_id) AS n_events, count(*) AS n_formed FROM events")
def _(t):
    # eight hex digits need not be unique alone; with the event they are
    made = t.events.select("event_id", SC.log_id("log", F.col("ts")).alias("log_id"))
    return made.agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("n_events"),
        F.count_if(F.col("log_id").rlike(r"^log_[0-9]{8}_[0-9]{6}_[0-9a-f]{8}$")).alias("n_formed"))


@query("f22_unknown_category", check("""
    SELECT coalesce(marital_status, 'Unknown') AS marital_status, count(*) AS n FROM admissions GROUP BY 1"""))
def _(t):
    return t.admissions.groupBy(SC.known(F.col("marital_status")).alias("marital_status")).agg(
        F.count(F.lit(1)).alias("n"))
