"""Declared schemas of the source and log tables."""

from __future__ import annotations

from pyspark.sql import types as T

_L, _I, _S, _D = T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType()
_B, _TS, _NTZ = T.BooleanType(), T.TimestampType(), T.TimestampNTZType()


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType(
        [T.StructField(f[0], f[1], f[2] if len(f) > 2 else True) for f in fields]
    )


PATIENTS = _struct(
    ("subject_id", _L), ("gender", _S), ("anchor_age", _I), ("anchor_year", _I),
    ("anchor_year_group", _S), ("dod", T.DateType()),
)
ADMISSIONS = _struct(
    ("hadm_id", _L), ("subject_id", _L), ("admittime", _NTZ), ("dischtime", _NTZ),
    ("deathtime", _NTZ), ("edregtime", _NTZ), ("edouttime", _NTZ), ("admission_type", _S),
    ("admission_location", _S), ("discharge_location", _S), ("insurance", _S), ("language", _S),
    ("marital_status", _S), ("ethnicity", _S), ("hospital_expire_flag", _I),
)
TRANSFERS = _struct(
    ("transfer_id", _L), ("subject_id", _L), ("hadm_id", _L), ("eventtype", _S),
    ("careunit", _S), ("intime", _NTZ), ("outtime", _NTZ),
)
PRESCRIPTIONS = _struct(("hadm_id", _L), ("drug", _S), ("drug_type", _S), ("route", _S))
EVENTS = _struct(
    ("event_id", _L), ("ts", _NTZ), ("user_id", _L), ("event_type", _S), ("value", _D), ("props", _S),
)
# append-only audit log; the first of each pair marked False is required
AUDIT_LOG = _struct(
    ("log_id", _S, False), ("hospital_id", _S, False), ("action", _S, False),
    ("action_category", _S), ("event_timestamp", _TS, False), ("logged_at", _TS),
    ("user_id", _S, False), ("user_role", _S), ("patient_age_bucket", _S), ("risk_score", _D),
    ("risk_level", _S), ("target_hospital", _S), ("query_type", _S), ("data_accessed", _S),
    ("tables_queried", T.ArrayType(_S)), ("privacy_level", _S), ("k_anonymity_threshold", _I),
    ("differential_privacy_epsilon", _D), ("hipaa_compliant", _B), ("legal_basis", _S),
    ("purpose", _S), ("details", _S), ("client_ip", _S), ("session_id", _S),
)
MODEL_PERFORMANCE = _struct(
    ("timestamp", _TS), ("samples_tested", _L), ("accuracy", _D), ("recall", _D),
    ("precision", _D), ("tp", _L), ("fp", _L), ("fn", _L), ("tn", _L),
)
