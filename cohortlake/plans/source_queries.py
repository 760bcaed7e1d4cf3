"""Queries over scans, sources and sinks (S), plus set operations (U)."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from cohortlake.functions import vocabulary as V
from cohortlake.operators import audit, curated, evaluate, monitor, thresholds, verification
from cohortlake.plans import layers
from cohortlake.plans.checks import check
from cohortlake.plans.registry import query
from cohortlake.session import run_path
from cohortlake.sources import schemas, snapshots as SN, tables as S


def _stored_predictions(t) -> DataFrame:
    path = run_path(t.spark, "predictions")
    S.write_table(t.predictions, path, by=("site", "data_split"), key="row_id")
    return S.read_table(t.spark, path)


def _run_prefix() -> str:
    """Catalog names of one run, so that runs on one metastore never meet."""
    return f"run_{uuid.uuid4().hex[:12]}_"


@query("s01_full_scan", "SELECT * FROM orders")
def _(t):
    return S.read_table(t.spark, f"{t.folder}/orders.parquet")


@query("s02_split_scan", check("SELECT row_id, y_true, score, site, data_split FROM predictions WHERE data_split = 'train'"))
def _(t):
    return S.scan_split(_stored_predictions(t), "train").select("row_id", "y_true", "score", "site", "data_split")


@query("s03_multi_site_scan", check("SELECT row_id, site, score FROM predictions WHERE data_split = 'test'"))
def _(t):
    # one scan of the table that holds all sites, not one per site
    return S.scan_split(t.predictions, "test").select("row_id", "site", "score")


@query("s04_site_tagged_scan", check('SELECT row_id, score, site AS "__hospital__" FROM predictions'))
def _(t):
    stored = _stored_predictions(t)
    parts = {s: stored.filter(F.col("site") == s).select("row_id", "score") for s in V.SITES}
    return S.concat_sites(parts, tag="__hospital__")


@query("s05_fit_scope", check("""
    SELECT 'hospital_b' AS scope, count(*) AS n FROM predictions WHERE site = 'hospital_b' AND data_split = 'train'
    UNION ALL SELECT 'all', count(*) FROM predictions WHERE data_split = 'train'"""))
def _(t):
    counts = [
        S.fit_scope(t.predictions, scope, "site").agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(scope).alias("scope"), "n")
        for scope in ("hospital_b", "all")
    ]
    return reduce(DataFrame.unionByName, counts)


@query("s06_replace_table", check("""
    SELECT subject_id, anchor_age, anchor_year, anchor_year_group, gender, dod,
      CAST(dod IS NOT NULL AS INT) AS is_deceased, 1 AS stored
    FROM patients"""))
def _(t):
    path = run_path(t.spark, "assignment")
    df = curated.patient_split_assignment(t.patients).drop("assigned_hospital", "data_split")
    for _ in range(2):  # the second write replaces the first
        S.write_table(df.withColumn("stored", F.lit(1)), path)
    return S.read_table(t.spark, path)


def _small_sources(t):
    return {"patients": t.patients, "admissions": t.admissions, "transfers": t.transfers}


def _versioned(t, share: int):
    """Two layers, the second from the first; ``share`` of ten patients are in them."""
    people = t.patients.filter(F.col("subject_id") % 10 < share)
    return {"patients": people, "admissions": t.admissions}, {
        "curated": {"people": lambda b: b["patients"].select("subject_id", "gender", "anchor_age")},
        "verification": {"ages": lambda b: b["people"].groupBy("gender").agg(F.count(F.lit(1)).alias("n"))},
    }


@query("s06b_snapshot_versions", check("""
    WITH n AS (SELECT count(*) AS every, count(*) FILTER (subject_id % 10 < 9) AS most FROM patients)
    SELECT 'pinned' AS reader, 1 AS version, most AS n FROM n UNION ALL SELECT 'after_failure', 1, most FROM n
    UNION ALL SELECT 'newest', 2, every FROM n"""))
def _(t):
    root = run_path(t.spark, "versions")
    sources, builders = _versioned(t, 9)
    pinned = SN.build(t.spark, root, sources, builders)
    # the third table names one that was not built, when two are written
    failing = {**builders, "late": {"broken": lambda b: b["absent"]}}
    try:
        SN.build(t.spark, root, sources, failing)
    except KeyError:
        pass
    left = SN.open_version(t.spark, root)
    sources, builders = _versioned(t, 10)
    newest = SN.build(t.spark, root, sources, builders)
    return reduce(DataFrame.unionByName, [
        s.table("curated", "people").agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(name).alias("reader"), F.lit(s.version).alias("version"), "n")
        for name, s in (("pinned", pinned), ("after_failure", left), ("newest", newest))])


@query("q05b_gated_write", check("""
    SELECT 'curated' AS layer, 'people' AS table_name, 'row_count_anomaly' AS type, 1 AS version_left,
      round(100.0 * (count(*) - count(*) FILTER (subject_id % 10 < 2)) / count(*), 6)::DOUBLE AS value FROM patients"""))
def _(t):
    root = run_path(t.spark, "gated")
    SN.build(t.spark, root, *_versioned(t, 10))
    try:
        SN.build(t.spark, root, *_versioned(t, 2))
    except SN.GateRefused as refused:
        left = SN.open_version(t.spark, root).version
        return refused.findings.filter("level = 'error'").select(
            "layer", "table_name", "type", F.lit(left).alias("version_left"), F.round("value", 6).alias("value"))
    raise AssertionError("a table that lost most of its rows was committed")


@query("s07_layer_databases", check("""
    SELECT layer, 0 AS n_tables, n_patients FROM (VALUES ('curated'), ('federated'), ('verification')) AS v(layer),
      (SELECT count(*) AS n_patients FROM patients)""").replace("0 AS n_tables", "CAST(0 AS BIGINT) AS n_tables"))
def _(t):
    names = list(layers.BUILDERS)
    folder = run_path(t.spark, "layers")
    prefix = _run_prefix()
    made = [prefix + n for n in names]
    S.ensure_layers(t.spark, made, folder)
    S.ensure_layers(t.spark, made, folder)  # the second call finds them
    held = S.layer_tables(t.spark, [n for n in made if t.spark.catalog.databaseExists(n)])
    present = [F.struct(F.lit(n.removeprefix(prefix)).alias("layer"), F.lit(len(held[n])).cast("bigint").alias("n_tables"))
               for n in held]
    S.drop_layers(t.spark, made)
    return t.patients.agg(F.count(F.lit(1)).alias("n_patients")).select(F.inline(F.array(*present)), "n_patients")


@query("s08_ordered_build", check("""
    SELECT 1 AS position, 'curated' AS layer, 'dim_patient' AS table_name, (SELECT count(*) FROM dim_patient) AS n
    UNION ALL SELECT 2, 'curated', 'fact_hospital_admission', (SELECT count(*) FROM fact_admission)
    UNION ALL SELECT 3, 'curated', 'fact_transfers', (SELECT count(*) FROM fact_transfers)
    UNION ALL SELECT 4, 'curated', 'fact_icu_stay', (SELECT count(*) FROM icu_stays)
    UNION ALL SELECT 5, 'curated', 'clinical_features', (SELECT count(*) FROM site_stays)
    UNION ALL SELECT 6, 'curated', 'patient_split_assignment', (SELECT count(*) FROM patients)
    UNION ALL SELECT 7, 'federated', 'site_data', (SELECT count(*) FROM site_stays)
    UNION ALL SELECT 8, 'verification', 'dataset_statistics',
      (SELECT count(*) FROM (SELECT DISTINCT assigned_hospital, data_split FROM site_stays))
    UNION ALL SELECT 9, 'verification', 'data_leakage_check',
      (SELECT count(DISTINCT assigned_hospital) FROM site_stays)"""))
def _(t):
    prefix, folder = _run_prefix(), run_path(t.spark, "build")
    built = layers.write_layers(t.spark, _small_sources(t), folder, prefix)
    counts, position = [], 0
    for layer, tables in built.items():
        for name in tables:
            position += 1
            stored = S.read_table(t.spark, f"{folder}/{layer}/{name}")
            counts.append(stored.agg(F.count(F.lit(1)).alias("n")).select(
                F.lit(position).alias("position"), F.lit(layer).alias("layer"),
                F.lit(name).alias("table_name"), "n"))
    # the files stay under their paths
    S.drop_layers(t.spark, [prefix + layer for layer in built])
    return reduce(DataFrame.unionByName, counts)


@query("s09_layer_tables", check("""
    SELECT 'listed_curated' AS layer, 'dim_patient' AS table_name, (SELECT count(*) FROM dim_patient) AS n
    UNION ALL SELECT 'listed_curated', 'fact_transfers', (SELECT count(*) FROM transfers)"""))
def _(t):
    folder = run_path(t.spark, "listed")
    listed = _run_prefix() + "curated"
    S.ensure_layers(t.spark, [listed], folder)
    for name, df in {"dim_patient": t.dim_patient, "fact_transfers": t.fact_transfers}.items():
        df.write.mode("overwrite").option("path", f"{folder}/{name}").saveAsTable(f"{listed}.{name}")
    counts = [
        S.read_table(t.spark, f"{folder}/{name}").agg(F.count(F.lit(1)).alias("n")).select(
            F.lit("listed_curated").alias("layer"), F.lit(name).alias("table_name"), "n")
        for name in S.layer_tables(t.spark, [listed])[listed]
    ]
    S.drop_layers(t.spark, [listed])
    return reduce(DataFrame.unionByName, counts)


@query("s10_csv_export", check("SELECT subject_id, gender, anchor_age, dod FROM patients"))
def _(t):
    folder = run_path(t.spark, "csv")
    S.export_csv({"patients": t.patients}, folder)
    back = t.spark.read.schema(schemas.PATIENTS).option("header", True).csv(f"{folder}/patients")
    return back.select("subject_id", "gender", "anchor_age", "dod")


@query("s11_manifest", check("""
    SELECT 'run_1' AS run_id, 'patients' AS table_name, (SELECT count(*) FROM patients) AS row_count, 6 AS n_fields
    UNION ALL SELECT 'run_1', 'admissions', (SELECT count(*) FROM admissions), 15"""))
def _(t):
    frames = {"patients": t.patients, "admissions": t.admissions}
    path = run_path(t.spark, "manifest")
    S.append_table(S.manifest("run_1", frames, {n: f"{path}/{n}" for n in frames}), path)
    fields = F.size(F.from_json(
        F.get_json_object("schema_json", "$.fields"), "array<struct<name:string>>"))
    return S.read_table(t.spark, path).select("run_id", "table_name", "row_count", fields.alias("n_fields"))


_STATS_SQL = check("""
    SELECT site, count(*) AS n, CAST(sum(y_true) AS BIGINT) AS deaths FROM predictions GROUP BY site""")


def _site_counts(t):
    return t.predictions.groupBy("site").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y_true").alias("deaths"))


@query("s12_report_csv", _STATS_SQL)
def _(t):
    df, folder = _site_counts(t), run_path(t.spark, "report")
    S.save_report(df, folder)
    return S.read_report(t.spark, folder, df.schema, "csv")


@query("s13_report_json", _STATS_SQL)
def _(t):
    df, folder = _site_counts(t), run_path(t.spark, "report")
    S.save_report(df, folder)
    return S.read_report(t.spark, folder, df.schema, "json")


@query("s14_baseline_store", check("""
    SELECT site, count(*) AS n, CAST(sum(y_true) AS BIGINT) AS deaths FROM predictions
    WHERE data_split = 'train' GROUP BY site"""))
def _(t):
    path = run_path(t.spark, "baseline")
    train = S.scan_split(t.predictions, "train").groupBy("site").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y_true").alias("deaths"))
    S.baseline(train, path)
    return S.baseline(_site_counts(t), path)  # stored once: still the first one


@query("s15_audit_append", check("""
    SELECT user_id, count(*) AS n, count(*) FILTER (kind = 'external_query') AS n_external
    FROM access_events GROUP BY user_id"""))
def _(t):
    path = run_path(t.spark, "audit")
    rows = audit.build_records(t.access_events)
    for test in (F.col("action_category") == "prediction", F.col("action_category") != "prediction"):
        audit.append_records(rows.filter(test), path)
    return audit.read_log(t.spark, path).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("action_category") == "external_query").alias("n_external"))


@query("s16_partitioned_audit", check("""
    SELECT CAST(event_timestamp AS DATE) AS event_date, count(*) AS n FROM access_events
    WHERE event_timestamp >= TIMESTAMP '2024-01-10' AND event_timestamp < TIMESTAMP '2024-01-12' GROUP BY 1"""))
def _(t):
    path = run_path(t.spark, "audit")
    audit.append_records(audit.build_records(t.access_events), path)
    log = audit.read_log(t.spark, path)
    days = log.filter(F.col("event_date").between("2024-01-10", "2024-01-11"))
    return days.groupBy("event_date").agg(F.count(F.lit(1)).alias("n"))


_UNIT = "CAST(CAST('0x' || substr(md5('{}' || row_id), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0"


@query("s17_random_rows", check(f"""
    SELECT row_id, y_true, score FROM predictions ORDER BY {_UNIT.format('monitor')}, row_id LIMIT 100"""))
def _(t):
    return S.hashed_rows(t.predictions.select("row_id", "y_true", "score"), "row_id", 100, "monitor")


@query("s18_seeded_samples", check(f"""
    SELECT row_id, CASE WHEN row_number() OVER (ORDER BY u, row_id) <= 80 THEN 'sample' ELSE 'background' END AS role
    FROM (SELECT row_id, {_UNIT.format('42')} AS u FROM predictions ORDER BY u, row_id LIMIT 130)"""))
def _(t):
    return S.disjoint_samples(t.predictions.select("row_id"), "row_id", 80, 50, "42")


@query("s19_percent_sample")
def _(t):
    return S.percent_rows(t.predictions, 0.1, 42)


@query("s20_first_rows", check("SELECT hadm_id, admittime FROM admissions ORDER BY admittime, hadm_id LIMIT 5"))
def _(t):
    return S.first_rows(t.admissions.select("hadm_id", "admittime"), ["admittime", "hadm_id"], 5)


@query("s21_run_table", check("SELECT run_id, learning_rate, local_epochs, optimizer, val_auc FROM runs"))
def _(t):
    path = run_path(t.spark, "runs")
    t.runs.write.json(path)
    return t.spark.read.schema(t.runs.schema).json(path).select(
        "run_id", "learning_rate", "local_epochs", "optimizer", "val_auc")


@query("s22_evaluation_package", check("""
    SELECT 'model_1' AS model_name, site, count(*) AS n FROM predictions GROUP BY site"""))
def _(t):
    metrics = evaluate.classification_metrics(t.predictions, ["site"]).withColumn("model_name", F.lit("model_1"))
    folder = run_path(t.spark, "evaluation")
    S.save_report(metrics, folder)
    return S.read_report(t.spark, folder, metrics.schema, "json").select("model_name", "site", "n")


@query("s23_threshold_report", check("""
    SELECT 'Current (0.5)' AS method, count(*) FILTER (score >= 0.5 AND y_true = 1) AS tp,
      count(*) FILTER (score >= 0.5 AND y_true = 0) AS fp FROM predictions"""))
def _(t):
    found = thresholds.evaluate_thresholds(t.predictions, {"Current (0.5)": 0.5})
    folder = run_path(t.spark, "thresholds")
    S.save_report(found, folder)
    return S.read_report(t.spark, folder, found.schema).select("method", "tp", "fp")


_DAILY_SQL = """SELECT CAST(scored_at AS DATE) AS day, count(*) AS samples_tested,
    count(*) FILTER (score >= 0.5 AND y_true = 1) AS tp, count(*) FILTER (score >= 0.5 AND y_true = 0) AS fp
    FROM predictions GROUP BY 1"""


@query("s24_monitoring_append", check(_DAILY_SQL))
def _(t):
    path = run_path(t.spark, "performance")
    S.append_table(monitor.daily_performance(t.predictions), path)
    return S.read_table(t.spark, path).select("day", "samples_tested", "tp", "fp")


@query("s25_cohort_count", check("""
    SELECT count(DISTINCT subject_id) AS n_patients, count(DISTINCT hadm_id) AS n_admissions,
      count(DISTINCT transfer_id) AS n_transfers FROM transfers"""))
def _(t):
    return t.transfers.agg(
        F.countDistinct("subject_id").alias("n_patients"),
        F.countDistinct("hadm_id").alias("n_admissions"),
        F.countDistinct("transfer_id").alias("n_transfers"))


# ---- set operations -----------------------------------------------------------


@query("u01_union_of_sites", check("""
    SELECT 'Hospital A' AS hospital, count(*) AS n FROM predictions WHERE site = 'hospital_a'
    UNION ALL SELECT 'Hospital B', count(*) FROM predictions WHERE site = 'hospital_b'
    UNION ALL SELECT 'Hospital C', count(*) FROM predictions WHERE site = 'hospital_c'"""))
def _(t):
    label = F.concat(F.lit("Hospital "), F.upper(F.substring("site", -1, 1)))
    return t.predictions.groupBy(label.alias("hospital")).agg(F.count(F.lit(1)).alias("n"))


@query("u02_concat", check("""
    SELECT row_id, site FROM predictions WHERE data_split <> 'train'"""))
def _(t):
    parts = {s: S.scan_split(t.predictions, s).select("row_id", "site") for s in ("validation", "test")}
    return S.concat_sites(parts)


@query("u03_key_difference", check("""
    SELECT 'only_admissions' AS side, count(*) AS n FROM
      (SELECT hadm_id FROM admissions EXCEPT SELECT hadm_id FROM transfers)
    UNION ALL SELECT 'only_transfers', count(*) FROM
      (SELECT hadm_id FROM transfers WHERE hadm_id IS NOT NULL EXCEPT SELECT hadm_id FROM admissions)
    UNION ALL SELECT 'both', count(*) FROM
      (SELECT hadm_id FROM admissions INTERSECT SELECT hadm_id FROM transfers)"""))
def _(t):
    # one pass over both key sets instead of three set operations
    a = t.admissions.select("hadm_id", F.lit(1).alias("a"), F.lit(0).alias("b"))
    b = t.transfers.filter(F.col("hadm_id").isNotNull()).select("hadm_id", F.lit(0).alias("a"), F.lit(1).alias("b"))
    sides = a.unionByName(b).groupBy("hadm_id").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    counts = sides.agg(
        F.count_if(F.col("b") == 0).alias("only_admissions"),
        F.count_if(F.col("a") == 0).alias("only_transfers"),
        F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("both"))
    return counts.unpivot([], ["only_admissions", "only_transfers", "both"], "side", "n")


@query("u04_site_overlap", check("""
    WITH s AS (SELECT subject_id, CASE WHEN admission_location = 'PACU' THEN 'hospital_a'
        WHEN admission_type = 'URGENT' THEN 'hospital_b' ELSE 'hospital_c' END AS h FROM admissions)
    SELECT a.h AS site_1, b.h AS site_2, count(DISTINCT a.subject_id) AS overlap
    FROM s a JOIN s b ON a.subject_id = b.subject_id AND a.h < b.h GROUP BY 1, 2"""))
def _(t):
    # sites by admission, so that overlaps exist
    site = (
        F.when(F.col("admission_location") == "PACU", "hospital_a")
        .when(F.col("admission_type") == "URGENT", "hospital_b").otherwise("hospital_c")
    )
    return verification.site_overlap(t.admissions.select("subject_id", site.alias("h")), site="h")
