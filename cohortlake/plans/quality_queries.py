"""Profile, drift and quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlake.functions.scalars import percent_change
from cohortlake.operators import profile as P, verification
from cohortlake.plans.checks import check
from cohortlake.plans.registry import query
from cohortlake.session import run_path
from cohortlake.sources import tables as S


def _num(table, name, col):
    return f"""SELECT '{name}' AS field, count({col}) AS count, count(DISTINCT {col}) AS "distinct",
      round(avg(CAST({col} AS DOUBLE)), 6) AS mean, CAST(min({col}) AS DOUBLE) AS min, CAST(max({col}) AS DOUBLE) AS max,
      round(stddev_samp(CAST({col} AS DOUBLE)), 6) AS stddev FROM {table}"""


@query("a15_numeric_profile", check(" UNION ALL ".join(
    _num("orders", c, c) for c in ("o_orderkey", "o_custkey", "o_totalprice"))))
def _(t):
    found = P.profile(t.raw("orders"), "orders", only=("numeric",))
    return found.select(
        "field", "count", "distinct", F.round("mean", 6).alias("mean"), "min", "max", F.round("stddev", 6).alias("stddev"))


@query("a16_string_profile", " UNION ALL ".join(
    f"""SELECT '{c}' AS field, count({c}) AS count, count(DISTINCT {c}) AS "distinct",
      round(avg(CAST(length({c}) AS DOUBLE)), 6) AS avg_length FROM documents""" for c in ("text", "lang", "source")))
def _(t):
    found = P.profile(t.raw("documents"), "documents", only=("string",))
    return found.select("field", "count", "distinct", F.round("avg_length", 6).alias("avg_length"))


@query("a17_temporal_profile", check(" UNION ALL ".join(
    f"SELECT '{c}' AS field, count({c}) AS count, min({c}) AS earliest, max({c}) AS latest FROM admissions"
    for c in ("admittime", "dischtime", "deathtime", "edregtime", "edouttime"))))
def _(t):
    found = P.profile(t.admissions, "admissions", only=("temporal",))
    return found.select("field", "count", "earliest", "latest")


@query("a18_boolean_profile", check(" UNION ALL ".join(
    f"""SELECT '{c}' AS field, count({c}) AS count, count(*) FILTER ({c}) AS true_count,
      count(*) FILTER (NOT {c}) AS false_count FROM resources"""
    for c in ("ecmo_available", "cardiac_surgery_available", "advanced_cardiac_care_available"))))
def _(t):
    found = P.profile(t.resources, "resources", only=("boolean",))
    return found.select("field", "count", "true_count", "false_count")


def _sizes(t, *names):
    from functools import reduce

    return reduce(lambda a, b: a.unionByName(b), [
        S.table_size(t.spark, f"{t.folder}/{n}.parquet", n) for n in names])


@query("a19_table_size")
def _(t):
    return _sizes(t, "orders", "customer")


@query("a19b_table_rows", """
    SELECT 'orders' AS table_name, count(*) AS row_count, true AS has_bytes FROM orders
    UNION ALL SELECT 'customer', count(*), true FROM customer""")
def _(t):
    return _sizes(t, "orders", "customer").select("table_name", "row_count", (F.col("size_bytes") > 0).alias("has_bytes"))


@query("a20_layer_rollup", """
    WITH c AS (SELECT 'raw' AS layer, count(*) AS n FROM orders UNION ALL SELECT 'raw', count(*) FROM customer
      UNION ALL SELECT 'reference', count(*) FROM part)
    SELECT coalesce(layer, 'TOTAL') AS layer, count(*) AS n_tables, CAST(sum(n) AS BIGINT) AS total_rows
    FROM c GROUP BY ROLLUP (layer)""")
def _(t):
    profiles = P.layer_profile({n: t.raw(n) for n in ("orders", "customer")}, "raw", True).unionByName(
        P.layer_profile({"part": t.raw("part")}, "reference", True))
    sizes = _sizes(t, "orders", "customer", "part")
    return P.layer_rollup(profiles, sizes).select("layer", "n_tables", "total_rows")


def _tables(t):
    return {"patients": t.patients, "admissions": t.admissions}


@query("q01_schema_rows", check("""
    SELECT * FROM (VALUES ('raw', 'patients', 0, 'subject_id', 'long', 'NULLABLE'), ('raw', 'patients', 1, 'gender', 'string', 'REQUIRED'),
      ('raw', 'patients', 2, 'anchor_age', 'integer', 'NULLABLE'), ('raw', 'patients', 3, 'anchor_year', 'integer', 'NULLABLE'),
      ('raw', 'patients', 4, 'anchor_year_group', 'string', 'NULLABLE'), ('raw', 'patients', 5, 'dod', 'date', 'NULLABLE'))
      AS v(layer, table_name, position, field, field_type, mode), (SELECT count(*) AS n_rows FROM patients)"""))
def _(t):
    return P.schema_rows({"patients": t.patients}, "raw")


@query("q02_layer_profile", check(f"""
    WITH n AS (SELECT 'patients' AS table_name, f.* FROM ({_num('patients', 'subject_id', 'subject_id')} UNION ALL {_num('patients', 'anchor_age', 'anchor_age')}
      UNION ALL {_num('patients', 'anchor_year', 'anchor_year')}) f
      UNION ALL SELECT 'resources', f.* FROM ({_num('resources', 'icu_beds_total', 'icu_beds_total')}
      UNION ALL {_num('resources', 'total_providers', 'total_providers')}) f)
    SELECT 'curated' AS layer, table_name, field, count, "distinct", mean, min, max, stddev FROM n"""))
def _(t):
    found = P.layer_profile({
        "patients": t.patients.select("subject_id", "anchor_age", "anchor_year"),
        "resources": t.resources.select("icu_beds_total", "total_providers")}, "curated")
    return found.select("layer", "table_name", "field", "count", "distinct", F.round("mean", 6).alias("mean"),
                        "min", "max", F.round("stddev", 6).alias("stddev"))


def _drift_inputs(t):
    """Current tables, and a baseline with a dropped, an added and a retyped field and no second layer."""
    before = {
        "patients": t.patients.drop("anchor_year_group").withColumn("anchor_age", F.col("anchor_age").cast("bigint"))
        .withColumn("nickname", F.lit(None).cast("string")).filter(F.col("subject_id") % 2 == 0)}
    current = P.schema_rows(_tables(t), "raw").unionByName(P.schema_rows({"notes": t.raw("labels")}, "extra"))
    return current, P.schema_rows(before, "raw")


_DRIFT_ROWS = """(VALUES ('raw', 'patients', 'anchor_age', 'type', 'long', 'integer'),
      ('raw', 'patients', 'anchor_year_group', 'added', NULL, 'string'), ('raw', 'patients', 'nickname', 'removed', 'string', NULL),
      ('raw', 'admissions', NULL, 'new_table', NULL, NULL), ('extra', 'notes', NULL, 'new_layer', NULL, NULL))
      AS v(layer, table_name, field, change, old, new)"""


_COUNTS = """b AS (SELECT 'patients' AS table_name, count(*) FILTER (subject_id % 2 = 0) AS was, count(*) AS now FROM patients
    UNION ALL SELECT 'admissions', NULL, count(*) FROM admissions)"""


_DELTAS = f"""WITH {_COUNTS}, d AS (SELECT 'raw' AS layer, table_name, was AS baseline_rows, now AS current_rows, now - was AS delta FROM b
      UNION ALL SELECT 'extra', 'notes', NULL, (SELECT count(*) FROM labels), NULL)"""


@query("q03_schema_drift", check(f"""
    {_DELTAS} SELECT v.*, d.baseline_rows, d.current_rows, d.delta FROM {_DRIFT_ROWS} JOIN d USING (layer, table_name)"""))
def _(t):
    current, before = _drift_inputs(t)
    return P.with_row_deltas(P.schema_drift(current, before), P.table_drift(current, before))


@query("q03b_drift_totals", f"""
    SELECT coalesce(layer, 'TOTAL') AS layer, count(*) AS n_drifts, count(DISTINCT (layer, table_name)) AS n_tables
    FROM {_DRIFT_ROWS} WHERE (SELECT count(*) FROM customer) > 0 GROUP BY ROLLUP (layer)""")
def _(t):
    return P.drift_totals(P.schema_drift(*_drift_inputs(t)))


@query("q03c_stored_size_drift")
def _(t):
    current = P.schema_rows({"orders": t.raw("orders")}, "raw")
    before = P.schema_rows({"orders": t.raw("orders").filter(F.col("o_orderkey") % 2 == 0)}, "raw")
    path = run_path(t.spark, "before")
    t.raw("orders").filter(F.col("o_orderkey") % 2 == 0).write.parquet(path)
    return P.table_drift(current, before, _sizes(t, "orders"), S.table_size(t.spark, path, "orders"))


@query("j15_schema_difference", check(f"""
    {_DELTAS} SELECT v.*, d.delta FROM {_DRIFT_ROWS} JOIN d USING (layer, table_name) WHERE change IN ('type', 'added', 'removed')"""))
def _(t):
    current, before = _drift_inputs(t)
    found = P.with_row_deltas(P.schema_drift(current, before), P.table_drift(current, before))
    return found.filter(F.col("change").isin("added", "removed", "type", "mode")).drop("baseline_rows", "current_rows")


@query("j16_baseline_pairing", check(f"""
    WITH {_COUNTS} SELECT 'raw' AS layer, table_name, was AS baseline_rows, now AS current_rows, now - was AS delta,
      CASE WHEN was > 0 THEN round((now - was) / CAST(was AS DOUBLE) * 100, 2) ELSE CAST(0 AS DOUBLE) END AS percent_change FROM b
    UNION ALL SELECT 'extra', 'notes', NULL, (SELECT count(*) FROM labels), NULL, 0"""))
def _(t):
    current, before = _drift_inputs(t)
    return P.table_drift(current, before)


@query("f14_percent_change", check("""
    WITH c AS (SELECT insurance, count(*) AS n, count(*) FILTER (hospital_expire_flag = 1) AS b FROM admissions GROUP BY 1)
    SELECT insurance, CASE WHEN b > 0 THEN round((n - b) / CAST(b AS DOUBLE) * 100, 2) ELSE CAST(0 AS DOUBLE) END AS change_pct,
      CAST(0 AS DOUBLE) AS from_zero FROM c"""))
def _(t):
    counted = t.admissions.groupBy("insurance").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("hospital_expire_flag") == 1).alias("b"))
    return counted.select(
        "insurance", percent_change(F.col("n"), F.col("b")).alias("change_pct"),
        percent_change(F.col("n"), F.lit(0)).alias("from_zero"))


def _profiles(t):
    # the rules look at the distinct values of strings only
    now = P.layer_profile(_tables(t), "raw", distinct_of=("string",))
    was = P.layer_profile({"patients": t.patients.filter(F.col("subject_id") % 2 == 0)}, "raw", distinct_of=("string",))
    return now, was


_ADM_FIELDS = [
    ("deathtime", 0), ("edregtime", 0), ("edouttime", 0), ("discharge_location", 1), ("marital_status", 1),
    ("admission_type", 1), ("admission_location", 1), ("insurance", 1), ("language", 1), ("ethnicity", 1)]
_FINDINGS = "f AS (" + " UNION ALL ".join(
    f"SELECT 'admissions' AS table_name, '{c}' AS field, {s} AS is_text, count(*) AS n, count({c}) AS c, count(DISTINCT {c}) AS d FROM admissions"
    for c, s in _ADM_FIELDS) + " UNION ALL " + " UNION ALL ".join(
    f"SELECT 'patients', '{c}', {s}, count(*), count({c}), count(DISTINCT {c}) FROM patients"
    for c, s in (("gender", 1), ("anchor_year_group", 1), ("dod", 0))) + f"""), {_COUNTS}, found AS (
    SELECT 'raw' AS layer, table_name, field, 'warning' AS level, 'high_null_rate' AS type, 1 - c / CAST(n AS DOUBLE) AS value
      FROM f WHERE 1 - c / CAST(n AS DOUBLE) > 0.3::DOUBLE
    UNION ALL SELECT 'raw', table_name, field, 'warning', 'low_cardinality', d / CAST(c AS DOUBLE)
      FROM f WHERE is_text = 1 AND d / CAST(c AS DOUBLE) < 0.01::DOUBLE
    UNION ALL SELECT 'raw', table_name, NULL, 'error', 'row_count_anomaly', abs((now - was) / CAST(was AS DOUBLE) * 100)
      FROM b WHERE was > 0 AND abs((now - was) / CAST(was AS DOUBLE) * 100) > 50)"""


@query("q04_quality_findings", check(f"WITH {_FINDINGS} SELECT * FROM found"))
def _(t):
    return P.quality_findings(*_profiles(t))


@query("q05_quality_totals", check(f"""
    WITH {_FINDINGS} SELECT count(*) FILTER (level = 'error') AS total_errors,
      count(*) FILTER (level = 'warning') AS total_warnings, count(*) FILTER (level = 'error') = 0 AS overall_passed FROM found"""))
def _(t):
    return P.quality_totals(P.quality_findings(*_profiles(t)))


@query("q06_quality_summary", check(f"""
    WITH {_FINDINGS} SELECT 'raw' AS layer, 2 AS n_tables, (SELECT count(*) FROM patients) + (SELECT count(*) FROM admissions) AS total_rows,
      21 AS n_fields, 2 AS n_drifted, count(*) FILTER (level = 'error') AS n_errors,
      count(*) FILTER (level = 'warning') AS n_warnings, count(*) FILTER (level = 'error') = 0 AS passed FROM found
    UNION ALL SELECT 'extra', 0, 0, 3, 1, 0, 0, true""").replace("2 AS n_tables", "CAST(2 AS BIGINT) AS n_tables")
    .replace("21 AS n_fields, 2 AS n_drifted", "CAST(21 AS BIGINT) AS n_fields, CAST(2 AS BIGINT) AS n_drifted"))
def _(t):
    now, was = _profiles(t)
    current, before = _drift_inputs(t)
    return P.quality_summary(now, current, P.schema_drift(current, before), P.quality_findings(now, was))


@query("q07_integrity_gate", check("""
    WITH s AS (SELECT site, subject_id, count(DISTINCT data_split) AS k FROM predictions GROUP BY 1, 2)
    SELECT CAST(coalesce(sum(k - 1), 0) AS BIGINT) AS total_overlap, coalesce(sum(k - 1), 0) = 0 AS passed FROM s"""))
def _(t):
    return verification.integrity_gate(verification.split_overlap(t.predictions, site="site"))


@query("q09_null_rate_increase", check(" UNION ALL ".join(
    f"""SELECT '{c}' AS field, (1 - count({c}) FILTER (late) / CAST(count(*) FILTER (late) AS DOUBLE))
      - (1 - count({c}) FILTER (NOT late) / CAST(count(*) FILTER (NOT late) AS DOUBLE)) AS increase,
      (1 - count({c}) FILTER (late) / CAST(count(*) FILTER (late) AS DOUBLE))
      - (1 - count({c}) FILTER (NOT late) / CAST(count(*) FILTER (NOT late) AS DOUBLE)) > 0.05::DOUBLE AS alert
    FROM (SELECT *, admittime >= TIMESTAMP '1998-01-01' AS late FROM admissions)"""
    for c in ("deathtime", "edregtime", "marital_status"))))
def _(t):
    kept = t.admissions.select("admittime", "deathtime", "edregtime", "marital_status")
    late = F.col("admittime") >= F.lit("1998-01-01").cast("timestamp_ntz")
    now = P.profile(kept.filter(late).drop("admittime"), "admissions", True)
    was = P.profile(kept.filter(~late).drop("admittime"), "admissions", True)
    return P.null_rate_increase(now, was)
