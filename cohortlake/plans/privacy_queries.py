"""Privacy, audit and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlake.functions import generalise as G, vocabulary as V
from cohortlake.operators import audit, cohorts, privacy as PR
from cohortlake.plans.checks import check, inlist, lst
from cohortlake.plans.registry import query
from cohortlake.plans.term_checks import (
    ADMISSION_MAP, GENDER, ICU_MAP, NORMALISED, TERM_TABLES, category, icu_category,
)
from cohortlake.session import run_path
from cohortlake.sources import bindings as B, schemas, tables as S
from cohortlake.streaming import audit_stream as ST


def _bucket(age):
    return f"CASE WHEN {age} > 89 THEN '90+' ELSE (({age} // 5) * 5) || '-' || (({age} // 5) * 5 + 5) END"


def _range(score):
    t = f"CAST(floor({score} * 10) AS INT)"
    return f"({t} // 10) || '.' || ({t} % 10) || '-' || (({t} + 1) // 10) || '.' || (({t} + 1) % 10)"


@query("v01_age_bucket", check(f"""
    SELECT row_id, {_bucket('age')} AS capped, ((age // 5) * 5) || '-' || ((age // 5) * 5 + 5) AS uncapped FROM predictions"""))
def _(t):
    return t.predictions.select(
        "row_id", G.age_bucket(F.col("age")).alias("capped"), G.age_bucket(F.col("age"), cap=False).alias("uncapped"))


@query("v02_score_range", check(f"SELECT row_id, {_range('score')} AS score_range FROM predictions"))
def _(t):
    return t.predictions.select("row_id", G.score_range(F.col("score")).alias("score_range"))


@query("v03_drop_identifiers", check("""
    SELECT gender, age, insurance, ['subject_id'] AS removed_fields FROM predictions"""))
def _(t):
    return PR.drop_identifiers(t.predictions.select("subject_id", "gender", "age", "insurance"))


_PERSON = """person AS (SELECT r.request_id, r.admission_text AS admission_type, r.icu_text AS icu_type, r.admission_text, r.icu_text,
    gender_text, score_text, risk_score, requesting_hospital, CAST(18 + request_id % 80 AS INT) AS age FROM requests r)"""


def _people(t):
    """Patient records with identifiers, as they look inside a site."""
    return t.requests.select(
        "request_id",
        F.concat(F.lit("SUBJ-"), F.lpad(F.col("request_id").cast("string"), 9, "0")).alias("subject_id"),
        F.concat(F.lit("Name "), F.col("request_id").cast("string")).alias("name"),
        (F.lit(18) + F.col("request_id") % 80).cast("int").alias("age_at_admission"),
        "risk_score", F.col("admission_text").alias("admission_type"), F.col("icu_text").alias("icu_type"),
        F.col("gender_text").alias("gender"), F.col("score_text").alias("early_icu_score"),
        F.lit(1).alias("weekend_admission"), F.lit(None).cast("int").alias("night_admission"),
        F.col("requesting_hospital").alias("hospital_id"))


_ADM_OR_DEFAULT = ADMISSION_MAP.replace("admission_text", "adm_text")
_ANON = f"""{TERM_TABLES}, {_PERSON}, d AS (SELECT DISTINCT admission_text, coalesce(admission_text, 'EMERGENCY') AS adm_text, icu_text FROM requests),
  m AS (SELECT admission_text, icu_text, ({_ADM_OR_DEFAULT}) AS ats, ({ICU_MAP}) AS it FROM d),
  anon AS (SELECT request_id, {_bucket('age')} AS age_bucket, {GENDER} AS gender, ats[1] AS admission_type, ats AS admission_types_all,
    {category('ats[1]')} AS admission_type_category, CAST(CASE WHEN score_text IS NULL THEN 2 ELSE greatest(0, least(3, score_text)) END AS INT) AS early_icu_score,
    it[1] AS icu_type, {icu_category('it[1]')} AS icu_type_category, {_range('risk_score')} AS risk_score_range,
    1 AS weekend_admission, 0 AS night_admission, CAST({category('ats[1]')} = 'EMERGENCY' AS INT) AS emergency_admission,
    requesting_hospital AS source_hospital, 'k_anonymity_5' AS privacy_level
    FROM person p JOIN m ON p.admission_text IS NOT DISTINCT FROM m.admission_text AND p.icu_text IS NOT DISTINCT FROM m.icu_text)"""


@query("v04_anonymise", check(f"WITH {_ANON} SELECT *, ['subject_id', 'name'] AS removed_fields FROM anon"))
def _(t):
    return PR.anonymise(_people(t), keep=["request_id"]).drop("n_warnings")


@query("v05_leak_check", check("""
    SELECT request_id, ['subject_id'] AS leaked FROM requests WHERE request_id % 100 = 0"""))
def _(t):
    people = _people(t)
    sent = PR.anonymise(people, keep=["request_id"])
    note = F.when(F.col("request_id") % 100 == 0, F.concat(F.lit("see "), F.lit("SUBJ-"), F.lpad(F.col("request_id").cast("string"), 9, "0")))
    return PR.leaked_values(people, sent.withColumn("note", note), "request_id", ["subject_id", "name"])


@query("v05b_foreign_leaks", check("""
    SELECT r.request_id, 'subject_id' AS identifier, o.request_id AS owner FROM requests r
      JOIN requests o ON o.request_id = r.request_id // 2 WHERE r.request_id % 100 = 0
    UNION ALL SELECT r.request_id, 'name', o.request_id FROM requests r
      JOIN requests o ON o.request_id = r.request_id // 3 WHERE r.request_id % 150 = 0"""))
def _(t):
    people = _people(t)
    sent = PR.anonymise(people, keep=["request_id"])
    one = F.concat(F.lit("As for (subj-"), F.lpad((F.expr("request_id div 2")).cast("string"), 9, "0"), F.lit("), see below"))
    two = F.concat(F.lit('told by "NAME  '), F.expr("request_id div 3").cast("string"), F.lit('".'))
    return PR.foreign_leaks(
        people, sent.withColumn("note", F.when(F.col("request_id") % 100 == 0, one)).withColumn(
            "said", F.when(F.col("request_id") % 150 == 0, two)), "request_id", ["subject_id", "name"])


_PATTERNS = lst(V.SUSPICIOUS_PATTERNS)


@query("v06_pattern_scan", f"""
    WITH p AS (SELECT unnest({_PATTERNS}) AS pattern)
    SELECT pattern, count(*) AS n_rows FROM p JOIN documents ON contains(lower(text), pattern) GROUP BY pattern""")
def _(t):
    return PR.pattern_summary(PR.pattern_hits(t.raw("documents").select("doc_id", "text"), F.col("text")))


@query("v06b_pattern_scan_rows", f"""
    SELECT conv_id, turn, list_filter({_PATTERNS}, lambda p: contains(lower(text), p)) AS found_patterns FROM conversations""")
def _(t):
    return PR.pattern_hits(t.raw("conversations").select("conv_id", "turn", "text"), F.col("text")).drop("text")


@query("v07_compliance", check("""
    SELECT count(*) AS n_rows, ['identifier found: subject_id', 'identifier found: hadm_id', 'exact age > 89 is an identifier'] AS violations,
      ['combination may be re-identifying'] AS warnings, false AS is_compliant FROM fact_admission"""))
def _(t):
    return PR.compliance(t.fact_admission.select(
        "subject_id", "hadm_id", "age_at_admission", "ethnicity", "insurance", "marital_status"))


def _json_field(name, quoted=True):
    value = f"'\"' || {name} || '\"'" if quoted else f"CAST({name} AS VARCHAR)"
    return f"'\"{name}\":' || coalesce({value}, 'null')"


_PRINT = "'{' || " + " || ',' || ".join([
    _json_field("admission_type"), _json_field("age_bucket"), _json_field("early_icu_score", False),
    _json_field("icu_type"), _json_field("risk_score_range")]) + " || '}'"


@query("v08_fingerprint", check(f"WITH {_ANON} SELECT request_id, sha256({_PRINT}) AS fingerprint FROM anon"))
def _(t):
    return PR.with_fingerprint(PR.anonymise(_people(t), keep=["request_id"])).select("request_id", "fingerprint")


@query("v09_daily_pseudonym", check(f"""
    SELECT substr(sha256('patient_' || subject_id || '_20240115'), 1, 16) AS patient_fingerprint, {_bucket('age')} AS age_bucket,
      {_range('score')} AS risk_score_range, CASE WHEN score >= 0.7 THEN 'HIGH' WHEN score >= 0.3 THEN 'MODERATE' ELSE 'LOW' END AS risk_level
    FROM predictions"""))
def _(t):
    rows = t.predictions.withColumnRenamed("score", "risk_score")
    return PR.fingerprinted_patients(rows, "20240115")


@query("v10_k_anonymity", check(f"""
    WITH g AS (SELECT gender, {_bucket('age')} AS age_bucket, insurance, race, count(*) AS n
      FROM predictions GROUP BY 1, 2, 3, 4)
    SELECT *, CAST(NULL AS BIGINT) AS suppressed_groups FROM g WHERE n >= 30
    UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, count(*) FILTER (n < 30) FROM g"""))
def _(t):
    rows = t.predictions.withColumn("age_bucket", G.age_bucket(F.col("age")))
    return PR.k_anonymous(rows, ["gender", "age_bucket", "insurance", "race"], 30)


@query("v11_laplace_counts")
def _(t):
    exact = t.site_stays.groupBy("assigned_hospital", "icu_type").agg(
        F.count(F.lit(1)).alias("case_count"), F.sum("icu_mortality_label").alias("deaths"),
        F.avg("los_icu_hours").alias("avg_icu_los"), F.avg("los_hospital_days").alias("avg_hospital_los"))
    return PR.noisy_counts(exact, ["assigned_hospital", "icu_type"])


@query("v12_bucket_bounds", check(f"""
    WITH b AS (SELECT DISTINCT CASE WHEN age % 3 = 0 THEN age || '+' WHEN age % 3 = 1 THEN age || '-' || (age + 5) ELSE CAST(age AS VARCHAR) END AS bucket, age FROM predictions)
    SELECT bucket, age AS low, CASE WHEN age % 3 = 1 THEN age + 5 ELSE 120 END AS high FROM b"""))
def _(t):
    age = F.col("age")
    text = (F.when(age % 3 == 0, F.concat(age.cast("string"), F.lit("+")))
            .when(age % 3 == 1, F.concat(age.cast("string"), F.lit("-"), (age + 5).cast("string")))
            .otherwise(age.cast("string")))
    rows = t.predictions.select(text.alias("bucket")).distinct()
    return rows.select("bucket", G.age_bounds(F.col("bucket")).alias("b")).select("bucket", "b.low", "b.high")


_ASKED = f"""asked AS (SELECT DISTINCT requesting_hospital, age_bucket, admission_text, early_icu_score, icu_text FROM
    (SELECT requesting_hospital, CASE WHEN request_id % 4 = 0 THEN '75+' ELSE ((18 + request_id % 80) // 10 * 10) || '-' || ((18 + request_id % 80) // 10 * 10 + 10) END AS age_bucket,
      admission_text, CAST(CASE WHEN score_text IS NULL THEN 2 ELSE greatest(0, least(3, score_text)) END AS INT) AS early_icu_score, icu_text FROM requests)),
  bounded AS (SELECT *, CAST(split_part(replace(age_bucket, '+', '-120'), '-', 1) AS INT) AS low, CAST(split_part(replace(age_bucket, '+', '-120'), '-', 2) AS INT) AS high FROM asked),
  va AS (SELECT unnest({lst(V.ADMISSION_TYPES)}) AS v, unnest(range(9)) AS p),
  mapped AS (SELECT *, CASE WHEN admission_text IS NULL THEN {lst(V.EMERGENCY_ADMISSION_TYPES)} ELSE coalesce(
      (SELECT [v] FROM va WHERE v = admission_text), (SELECT vals FROM nadm WHERE term = {NORMALISED}),
      (SELECT vals FROM nadm WHERE term = rtrim({NORMALISED}, '.')),
      (SELECT [v] FROM va WHERE contains(lower(v), {NORMALISED}) OR contains({NORMALISED}, lower(v)) ORDER BY p LIMIT 1),
      (SELECT vals FROM nadm WHERE contains({NORMALISED}, term) OR contains(term, {NORMALISED}) ORDER BY p LIMIT 1), {lst(V.EMERGENCY_ADMISSION_TYPES)}) END AS at,
    CASE WHEN icu_text IS NULL THEN {lst(V.ICU_TYPES)} ELSE coalesce((SELECT [v] FROM (SELECT unnest({lst(V.ICU_TYPES)}) AS v) WHERE v = icu_text),
      (SELECT vals FROM nicu WHERE term = lower(trim(icu_text))),
      (SELECT vals FROM nicu WHERE contains(lower(trim(icu_text)), term) OR contains(term, lower(trim(icu_text))) ORDER BY p LIMIT 1), {lst(V.ICU_TYPES)}) END AS it
    FROM (SELECT DISTINCT admission_text, icu_text FROM asked)),
  peers AS (SELECT b.*, h.hospital FROM bounded b JOIN (SELECT unnest({lst(V.SITES)}) AS hospital) h ON h.hospital <> b.requesting_hospital),
  answers AS (SELECT q.requesting_hospital, q.age_bucket, q.admission_text, q.early_icu_score, q.icu_text, q.hospital,
      count(s.hadm_id) AS case_count, coalesce(CAST(sum(s.icu_mortality_label) AS BIGINT), 0) AS deaths,
      avg(s.los_icu_hours) AS avg_icu_los, avg(s.los_hospital_days) AS avg_hospital_los
    FROM peers q JOIN mapped m ON q.admission_text IS NOT DISTINCT FROM m.admission_text AND q.icu_text IS NOT DISTINCT FROM m.icu_text
    LEFT JOIN site_stays s ON s.assigned_hospital = q.hospital AND s.early_icu_score = q.early_icu_score
      AND s.age_at_admission BETWEEN q.low AND q.high AND list_contains(m.at, s.admission_type) AND list_contains(m.it, s.icu_type)
    GROUP BY ALL)"""


def _asked(t):
    number = F.col("request_id")
    tens = (F.floor((F.lit(18) + number % 80) / 10) * 10)
    bucket = F.when(number % 4 == 0, "75+").otherwise(F.concat(tens.cast("string"), F.lit("-"), (tens + 10).cast("string")))
    score = F.greatest(F.lit(0), F.least(F.lit(3), F.col("score_text")))
    return t.requests.select(
        "request_id", "requesting_hospital", bucket.alias("age_bucket"), "admission_text",
        score.cast("int").alias("early_icu_score"), "icu_text")


_KEYS = ["requesting_hospital", "age_bucket", "admission_text", "early_icu_score", "icu_text", "hospital"]


@query("v13_network_cohort_query", check(f"""
    WITH {TERM_TABLES}, {_ASKED}
    SELECT requesting_hospital, age_bucket, admission_text, early_icu_score, icu_text, hospital, case_count >= 5 AS k_anonymity_met,
      CASE WHEN case_count >= 5 THEN case_count ELSE 0 END AS cases_found,
      CASE WHEN case_count >= 5 THEN round(1 - deaths / CAST(case_count AS DOUBLE), 3) END AS survival_rate,
      CASE WHEN case_count >= 5 THEN round(deaths / CAST(case_count AS DOUBLE), 3) END AS mortality_rate,
      CASE WHEN case_count >= 5 THEN round(avg_icu_los, 1) END AS avg_icu_los_hours,
      CASE WHEN case_count >= 5 THEN round(avg_hospital_los, 1) END AS avg_hospital_los_days FROM answers"""))
def _(t):
    answers = cohorts.network_cohorts(_asked(t), t.site_stays)
    return PR.noisy_counts(answers, _KEYS, epsilon=None)


@query("v13b_network_cohort_query_noisy")
def _(t):
    return PR.noisy_counts(cohorts.network_cohorts(_asked(t), t.site_stays), _KEYS)


@query("v14_range_floor", check(f"""
    SELECT row_id, CASE WHEN row_id % 3 = 0 THEN NULL ELSE floor(score * 10) / 10 END AS lower_bound FROM predictions"""))
def _(t):
    text = F.when(F.col("row_id") % 3 == 0, "high").otherwise(G.score_range(F.col("score")))
    return t.predictions.select("row_id", G.range_floor(text).alias("lower_bound"))


_SHARED = """coalesce(nullif(concat_ws(', ', 'age_bucket', 'risk_score_range', 'admission_type',
    CASE WHEN early_icu_score <> 0 THEN 'early_icu_score' END, CASE WHEN icu_type IS NOT NULL THEN 'icu_type' END), ''), 'anonymized_patient_profile')"""
_LOW = "floor(risk_score * 10) / 10"
_RISK = f"CASE WHEN kind = 'prediction' THEN risk_score WHEN kind IN ('external_query', 'transfer_receipt') THEN {_LOW} END"


@query("v15_audit_records", check(f"""
    WITH a AS (SELECT *, {_RISK} AS risk FROM access_events)
    SELECT CASE kind WHEN 'prediction' THEN 'pred' WHEN 'external_query' THEN 'query' WHEN 'patient_transfer' THEN 'xfer'
        WHEN 'transfer_receipt' THEN 'recv' ELSE 'priv' END || '_' || strftime(event_timestamp, '%Y%m%d_%H%M%S') || '_' || substr(md5(event_id), 1, 8) AS log_id,
      hospital_id, kind AS action, CASE kind WHEN 'patient_transfer' THEN 'transfer' WHEN 'transfer_receipt' THEN 'incoming_transfer'
        WHEN 'privacy_operation' THEN 'privacy' ELSE kind END AS action_category, user_id,
      CASE kind WHEN 'transfer_receipt' THEN 'receiving_coordinator' WHEN 'external_query' THEN coalesce(user_role, 'clinical_staff') ELSE user_role END AS user_role,
      CASE WHEN kind <> 'privacy_operation' THEN {_bucket('age')} END AS patient_age_bucket, risk AS risk_score,
      CASE WHEN risk > 0.7 THEN 'HIGH' WHEN risk > 0.3 THEN 'MODERATE' WHEN risk IS NOT NULL THEN 'LOW' END AS risk_level,
      CASE WHEN kind <> 'prediction' THEN target_hospital END AS target_hospital,
      CASE kind WHEN 'external_query' THEN query_type WHEN 'transfer_receipt' THEN 'incoming_transfer' END AS query_type,
      CASE kind WHEN 'prediction' THEN hospital_id || '_data' WHEN 'external_query' THEN {_SHARED}
        WHEN 'transfer_receipt' THEN 'transfer_id: ' || event_id || ', reason: ' || reason END AS data_accessed,
      CASE kind WHEN 'prediction' THEN [hospital_id || '_data'] WHEN 'external_query' THEN ['federated_hospital_data', target_hospital || '_resources']
        WHEN 'transfer_receipt' THEN ['transfer_coordination', target_hospital || '_outbound'] END AS tables_queried,
      CASE WHEN kind IN ('prediction', 'privacy_operation') THEN 'k_anonymity_5' WHEN kind <> 'patient_transfer' THEN 'k_anonymity_5_dp_0.1' END AS privacy_level,
      CASE WHEN kind <> 'patient_transfer' THEN 5 END AS k_anonymity_threshold,
      CASE WHEN kind IN ('external_query', 'transfer_receipt') THEN CAST(0.1 AS DOUBLE) END AS differential_privacy_epsilon,
      true AS hipaa_compliant,
      CASE kind WHEN 'external_query' THEN '45 CFR 164.506(c)' WHEN 'transfer_receipt' THEN '45 CFR 164.506(c) - Treatment' END AS legal_basis,
      CASE kind WHEN 'external_query' THEN 'Treatment - finding appropriate care facility' WHEN 'patient_transfer' THEN reason
        WHEN 'transfer_receipt' THEN 'Incoming transfer from ' || target_hospital || ' for ' || reason END AS purpose FROM a"""))
def _(t):
    return audit.build_records(t.access_events).drop(
        "event_timestamp", "logged_at", "details", "client_ip", "session_id")


@query("v16_shared_fields", check(f"SELECT event_id, {_SHARED} AS shared FROM access_events"))
def _(t):
    shaped = t.access_events.withColumn("age_bucket", G.age_bucket(F.col("age"))).withColumn(
        "risk_score_range", G.score_range(F.col("risk_score")))
    return shaped.select("event_id", G.shared_fields().alias("shared"))


# ---- streaming -----------------------------------------------------------------------------


def _stream(t, name, schema):
    return ST.read_files(t.spark, t.folder, schema, pattern=f"{name}.parquet")


@query("st1_audit_append_stream", check("""
    SELECT CAST(event_timestamp AS DATE) AS event_date, kind AS action, count(*) AS n FROM access_events GROUP BY 1, 2"""))
def _(t):
    path = run_path(t.spark, "audit-stream")
    events = B.shape_access_events(_stream(t, "events", schemas.EVENTS))
    ST.run_available(ST.append_audit(events, f"{path}/log", f"{path}/checkpoint"))
    return audit.read_log(t.spark, f"{path}/log").groupBy("event_date", "action").agg(F.count(F.lit(1)).alias("n"))


@query("st2_action_counts_stream", check("""
    SELECT date_trunc('hour', event_timestamp) AS window_start, kind, count(*) AS n FROM access_events
    WHERE date_trunc('hour', event_timestamp) + INTERVAL 1 HOUR <= (SELECT max(event_timestamp) FROM access_events) - INTERVAL 1 HOUR
    GROUP BY 1, 2"""))
def _(t):
    path = run_path(t.spark, "counts-stream")
    events = B.shape_access_events(_stream(t, "events", schemas.EVENTS))
    ST.run_available(ST.write_windows(ST.action_counts(events), f"{path}/out", f"{path}/checkpoint"))
    return t.spark.read.parquet(f"{path}/out").select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"), "kind", "n")


@query("st3_monitor_stream", check("""
    WITH d AS (SELECT CAST(scored_at AS DATE) AS day, count(*) FILTER (score >= 0.5 AND y_true = 1) AS tp,
      count(*) FILTER (score >= 0.5 AND y_true = 0) AS fp, count(*) FILTER (score < 0.5 AND y_true = 1) AS fn,
      count(*) FILTER (score < 0.5 AND y_true = 0) AS tn FROM predictions GROUP BY 1)
    SELECT day, tp, fp, fn, tn, (tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE) < 0.85
      OR (CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0 END) < 0.70 AS needs_retraining FROM d
    WHERE day + 1 <= (SELECT max(scored_at) FROM predictions) - INTERVAL 1 DAY"""))
def _(t):
    path = run_path(t.spark, "monitor-stream")
    orders = _stream(t, "orders", t.raw("orders").schema)
    scored = B.shape_predictions(orders).withColumn("scored_at", F.col("scored_at").cast("timestamp"))
    days = ST.monitor_days(scored)
    ST.run_available(ST.write_monitor(days, f"{path}/out", f"{path}/checkpoint"))
    return t.spark.read.parquet(f"{path}/out").select("day", "tp", "fp", "fn", "tn", "needs_retraining")


@query("st4_latest_status", """
    SELECT 'xfer_' || user_id AS transfer_id, first(event_type ORDER BY ts DESC, event_id DESC) AS status, max(ts) AS updated_at
    FROM events GROUP BY 1""")
def _(t):
    path = run_path(t.spark, "status-stream")
    updates = B.shape_transfer_updates(_stream(t, "events", schemas.EVENTS))
    ST.run_available(ST.write_status(updates, f"{path}/out", f"{path}/checkpoint"))
    return ST.read_status(t.spark, f"{path}/out").select(
        "transfer_id", "status", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"))


@query("st4b_bounded_status", """
    SELECT 'xfer_' || user_id AS transfer_id, first(event_type ORDER BY ts DESC, event_id DESC) AS status, max(ts) AS updated_at
    FROM events GROUP BY 1""")
def _(t):
    path, events = run_path(t.spark, "bounded-status"), t.raw("events")
    ends = events.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    for part in range(4):
        # the updates come in four pieces, in the order of their time
        low, high = (ends["a"] + (ends["b"] - ends["a"]) * i / 4 for i in (part, part + 1))
        piece = events.filter((F.col("ts") >= F.lit(low)) & ((F.col("ts") < F.lit(high)) | F.lit(part == 3)))
        piece.write.mode("append").parquet(f"{path}/in")
        updates = B.shape_transfer_updates(ST.read_files(t.spark, f"{path}/in", schemas.EVENTS))
        ST.run_available(ST.write_bounded_status(updates, f"{path}/out", f"{path}/checkpoint", "2 days", compact_every=2))
    return ST.read_bounded_status(t.spark, f"{path}/out").select(
        "transfer_id", "status", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"))


@query("s15b_site_logs", check(f"""
    SELECT hospital_id, count(*) AS n FROM access_events WHERE hospital_id IN {inlist(V.SITES)} GROUP BY 1"""))
def _(t):
    return S.append_and_read(audit.with_event_date(audit.build_records(t.access_events)),
                             run_path(t.spark, "site-logs"), ("hospital_id",)).groupBy("hospital_id").agg(
        F.count(F.lit(1)).alias("n"))
