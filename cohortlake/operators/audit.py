"""Audit log: event rows to the declared log schema, append, look-back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from cohortlake.functions import clinical as C, generalise as G, vocabulary as V
from cohortlake.sources import schemas
from cohortlake.sources.tables import append_table, spread

# fixed values: what each kind of event writes into the log
ID_PREFIX = {
    "prediction": "pred",
    "external_query": "query",
    "patient_transfer": "xfer",
    "transfer_receipt": "recv",
    "privacy_operation": "priv",
}
CATEGORY = {
    "prediction": "prediction",
    "external_query": "external_query",
    "patient_transfer": "transfer",
    "transfer_receipt": "incoming_transfer",
    "privacy_operation": "privacy",
}
PRIVACY = {
    "prediction": V.PRIVACY_LEVEL,
    "external_query": V.PRIVACY_LEVEL_DP,
    "transfer_receipt": V.PRIVACY_LEVEL_DP,
    "privacy_operation": V.PRIVACY_LEVEL,
}
BASIS = {"external_query": V.LEGAL_BASIS, "transfer_receipt": f"{V.LEGAL_BASIS} - Treatment"}
RECEIVER_ROLE, DEFAULT_QUERY_ROLE = "receiving_coordinator", "clinical_staff"
RECEIPT_QUERY_TYPE = "incoming_transfer"
NETWORK_TABLE, TRANSFER_TABLE = "federated_hospital_data", "transfer_coordination"
# end of fixed values


def _by_kind(values: dict[str, Column | str], default: Column | None = None) -> Column:
    out = None
    for kind, value in values.items():
        value = value if isinstance(value, Column) else F.lit(value)
        test = F.col("kind") == kind
        out = F.when(test, value) if out is None else out.when(test, value)
    return out if default is None else out.otherwise(default)


def build_records(events: DataFrame) -> DataFrame:
    """Access events of all five kinds as audit rows, in one projection.

    Input columns: event_id, event_timestamp, user_id, user_role, kind, hospital_id,
    target_hospital, age, risk_score, query_type, reason, admission_type, icu_type,
    early_icu_score. The log id is derived from the event id, so a replay writes the
    same id.
    """
    site, target = F.col("hospital_id"), F.col("target_hospital")
    shaped = events.withColumn("age_bucket", G.age_bucket(F.col("age"))).withColumn(
        "risk_score_range", G.score_range(F.col("risk_score"))
    )
    lower = G.range_floor(F.col("risk_score_range"))
    risk = _by_kind({
        "prediction": F.col("risk_score"), "external_query": lower, "transfer_receipt": lower,
    })
    receipt_purpose = F.concat(F.lit("Incoming transfer from "), target, F.lit(" for "), F.col("reason"))
    own_table = F.concat(site, F.lit("_data"))
    columns = {
        "log_id": F.concat(
            _by_kind(ID_PREFIX), F.lit("_"),
            F.date_format("event_timestamp", "yyyyMMdd_HHmmss"), F.lit("_"),
            F.substring(F.md5("event_id"), 1, 8),
        ),
        "hospital_id": site,
        "action": F.col("kind"),
        "action_category": _by_kind(CATEGORY),
        "event_timestamp": F.col("event_timestamp"),
        "logged_at": F.col("event_timestamp"),
        "user_id": F.col("user_id"),
        "user_role": _by_kind({
            "transfer_receipt": F.lit(RECEIVER_ROLE),
            "external_query": F.coalesce("user_role", F.lit(DEFAULT_QUERY_ROLE)),
        }, F.col("user_role")),
        "patient_age_bucket": F.when(F.col("kind") != "privacy_operation", F.col("age_bucket")),
        "risk_score": risk,
        "risk_level": C.risk_level(risk, inclusive=False),
        "target_hospital": F.when(F.col("kind") != "prediction", target),
        "query_type": _by_kind({
            "external_query": F.col("query_type"), "transfer_receipt": F.lit(RECEIPT_QUERY_TYPE),
        }),
        "data_accessed": _by_kind({
            "prediction": own_table,
            "external_query": G.shared_fields(),
            "transfer_receipt": F.concat(
                F.lit("transfer_id: "), F.col("event_id"), F.lit(", reason: "), F.col("reason")
            ),
        }),
        "tables_queried": _by_kind({
            "prediction": F.array(own_table),
            "external_query": F.array(
                F.lit(NETWORK_TABLE), F.concat(target, F.lit("_resources"))
            ),
            "transfer_receipt": F.array(
                F.lit(TRANSFER_TABLE), F.concat(target, F.lit("_outbound"))
            ),
        }),
        "privacy_level": _by_kind(PRIVACY),
        "k_anonymity_threshold": F.when(F.col("kind") != "patient_transfer", F.lit(V.K_ANONYMITY)),
        "differential_privacy_epsilon": F.when(
            F.col("kind").isin("external_query", "transfer_receipt"), F.lit(V.EPSILON)
        ),
        "hipaa_compliant": F.lit(True),
        "legal_basis": _by_kind(BASIS),
        "purpose": _by_kind({
            "external_query": F.lit(V.EXTERNAL_QUERY_PURPOSE),
            "patient_transfer": F.col("reason"),
            "transfer_receipt": receipt_purpose,
        }),
        "details": F.to_json(F.struct("event_id", "kind", "risk_score_range", "age_bucket")),
        "client_ip": F.lit(None),
        "session_id": F.when(F.col("kind") == "transfer_receipt", F.col("event_id")),
    }
    return shaped.select(
        *[columns[f.name].cast(f.dataType).alias(f.name) for f in schemas.AUDIT_LOG.fields]
    )


def with_event_date(records: DataFrame) -> DataFrame:
    return records.withColumn("event_date", F.to_date("event_timestamp"))


def append_records(records: DataFrame, path: str, files_per_day: int | None = None) -> None:
    """Append to the day-partitioned log (S15, S16); a busy day is written by several tasks."""
    dated = spread(with_event_date(records), ["event_date"], "log_id", files_per_day)
    append_table(dated, path, by=("event_date",))


def log_schema() -> T.StructType:
    return T.StructType([*schemas.AUDIT_LOG.fields, T.StructField("event_date", T.DateType())])


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(log_schema()).parquet(path)


def look_back(
    log: DataFrame, anchor: Column, hours: int = 24, query_type: str | None = None,
    user_id: str | None = None, limit: int | None = 100,
) -> DataFrame:
    """Newest records of the last ``hours`` hours before an anchor, with optional filters.

    ``limit`` is the page size of the report; None gives every record.
    """
    from functools import reduce
    from cohortlake.functions.temporal import look_back as back

    tests = [F.col("logged_at") >= back(anchor, hours), F.col("logged_at") <= anchor]
    if "event_date" in log.columns:
        # the partition column lets the scan skip whole days
        tests.append(F.col("event_date") >= F.to_date(back(anchor, hours)))
    if query_type is not None:
        tests.append(F.col("query_type") == query_type)
    if user_id is not None:
        tests.append(F.col("user_id") == user_id)
    found = log.filter(reduce(lambda a, b: a & b, tests))
    if limit is None:
        return found
    return found.orderBy(F.col("logged_at").desc(), "log_id").limit(limit)
