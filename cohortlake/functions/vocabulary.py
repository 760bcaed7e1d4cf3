"""Domain vocabularies. Results depend on their text and order."""

from __future__ import annotations

# ---- fixed values ----------------------------------------------------------

SITES = ["hospital_a", "hospital_b", "hospital_c"]
SPLITS = ["train", "validation", "test"]

ADMISSION_TYPES = [
    "OBSERVATION ADMIT",
    "EU OBSERVATION",
    "EW EMER.",
    "ELECTIVE",
    "SURGICAL SAME DAY ADMISSION",
    "DIRECT EMER.",
    "URGENT",
    "DIRECT OBSERVATION",
    "AMBULATORY OBSERVATION",
]
EMERGENCY_ADMISSION_TYPES = ["EW EMER.", "DIRECT EMER."]
# the wider emergency set of the exploratory analysis
ACUTE_ADMISSION_TYPES = ["EW EMER.", "DIRECT EMER.", "URGENT"]
EMERGENCY_LITERAL = "EMERGENCY"

ICU_TYPES = [
    "Cardiac ICU",
    "Medical ICU",
    "Mixed ICU (2 Units)",
    "Surgical ICU",
    "Neuro ICU",
    "Mixed ICU (3+ Units)",
    "Other ICU",
]

ICU_CAREUNITS = [
    "Trauma SICU (TSICU)",
    "Coronary Care Unit (CCU)",
    "Medical Intensive Care Unit (MICU)",
    "Surgical Intensive Care Unit (SICU)",
    "Cardiac Vascular Intensive Care Unit (CVICU)",
    "Medical/Surgical Intensive Care Unit (MICU/SICU)",
    "Neuro Surgical Intensive Care Unit (Neuro SICU)",
]
EMERGENCY_CAREUNITS = ["Emergency Department", "Emergency Department Observation"]
ICU_KEYWORDS = ["ICU", "INTENSIVE", "CCU", "SICU", "MICU", "CVICU", "TSICU"]

# ICU type of a stay with one unit: (type, unit the list names, or the only unit)
SINGLE_UNIT_ICU_TYPES = [
    ("Medical ICU", "Medical Intensive Care Unit (MICU)", "Medical/Surgical Intensive Care Unit (MICU/SICU)"),
    ("Surgical ICU", "Surgical Intensive Care Unit (SICU)", "Trauma SICU (TSICU)"),
    ("Cardiac ICU", "Coronary Care Unit (CCU)", "Cardiac Vascular Intensive Care Unit (CVICU)"),
    ("Neuro ICU", None, "Neuro Surgical Intensive Care Unit (Neuro SICU)"),
]
OTHER_ICU_TYPE = "Other ICU"
MIXED_TWO, MIXED_MORE = "Mixed ICU (2 Units)", "Mixed ICU (3+ Units)"
STEP_DOWN_WORDS = ["Intermediate", "Stepdown"]
UNITS_OF_THEIR_OWN_CLASS = ["PACU", "Observation", "Unknown"]

# generalised categories: (category, substrings that lead to it), first match wins
ADMISSION_CATEGORIES = [
    ("EMERGENCY", ["EMER"]),
    ("URGENT", ["URGENT"]),
    ("ELECTIVE", ["ELECTIVE"]),
    ("OBSERVATION", ["OBS"]),
    ("SURGICAL", ["SAME DAY", "SURGICAL"]),
]
EXACT_ADMISSION_CATEGORIES = ["URGENT", "ELECTIVE"]  # the whole text, not a substring
ICU_CATEGORIES = [
    ("CARDIAC", ["cardiac", "ccu", "cvicu"]),
    ("MEDICAL", ["medical", "micu"]),
    ("SURGICAL", ["surgical", "sicu", "trauma"]),
    ("NEURO", ["neuro"]),
    ("MIXED", ["mixed"]),
]

ADMISSION_LOCATIONS = [
    "CLINIC REFERRAL",
    "EMERGENCY ROOM",
    "INFORMATION NOT AVAILABLE",
    "PACU",
    "PHYSICIAN REFERRAL",
    "PROCEDURE SITE",
    "TRANSFER FROM HOSPITAL",
    "TRANSFER FROM SKILLED NURSING FACILITY",
    "WALK-IN/SELF REFERRAL",
    "INTERNAL TRANSFER TO OR FROM PSYCH",
    "AMBULATORY SURGERY TRANSFER",
]
INSURANCES = ["Medicare", "Private", "Other", "Medicaid", "No charge"]
MARITAL_STATUSES = ["SINGLE", "MARRIED", "DIVORCED", "WIDOWED"]

_EMERGENCY = ["EW EMER.", "DIRECT EMER."]
_OBSERVATION = [
    "OBSERVATION ADMIT",
    "EU OBSERVATION",
    "DIRECT OBSERVATION",
    "AMBULATORY OBSERVATION",
]
_SAME_DAY = ["SURGICAL SAME DAY ADMISSION"]
_MIXED = ["Mixed ICU (2 Units)", "Mixed ICU (3+ Units)"]
_ROOM = ["EMERGENCY ROOM"]
_NURSING = ["TRANSFER FROM SKILLED NURSING FACILITY"]
_WALK_IN = ["WALK-IN/SELF REFERRAL"]

# term -> stored values; the first matching key wins
ADMISSION_TYPE_TERMS = {
    "emergency": _EMERGENCY,
    "emer": _EMERGENCY,
    "ew emer": ["EW EMER."],
    "ew emer.": ["EW EMER."],
    "direct emer": ["DIRECT EMER."],
    "direct emer.": ["DIRECT EMER."],
    "er": _EMERGENCY,
    "urgent": ["URGENT"],
    "elective": ["ELECTIVE"],
    "scheduled": ["ELECTIVE"],
    "planned": ["ELECTIVE"],
    "observation": _OBSERVATION,
    "observation admit": ["OBSERVATION ADMIT"],
    "eu observation": ["EU OBSERVATION"],
    "direct observation": ["DIRECT OBSERVATION"],
    "ambulatory observation": ["AMBULATORY OBSERVATION"],
    "obs": ["OBSERVATION ADMIT", "EU OBSERVATION"],
    "same day": _SAME_DAY,
    "same_day": _SAME_DAY,
    "surgical same day": _SAME_DAY,
    "surgical same day admission": _SAME_DAY,
    "day surgery": _SAME_DAY,
}
ICU_TYPE_TERMS = {
    "cardiac": ["Cardiac ICU"],
    "cardiac icu": ["Cardiac ICU"],
    "ccu": ["Cardiac ICU"],
    "heart": ["Cardiac ICU"],
    "medical": ["Medical ICU"],
    "medical icu": ["Medical ICU"],
    "micu": ["Medical ICU"],
    "surgical": ["Surgical ICU"],
    "surgical icu": ["Surgical ICU"],
    "sicu": ["Surgical ICU"],
    "neuro": ["Neuro ICU"],
    "neuro icu": ["Neuro ICU"],
    "neurological": ["Neuro ICU"],
    "neurosurgical": ["Neuro ICU"],
    "mixed": _MIXED,
    "mixed icu": _MIXED,
    "other": ["Other ICU"],
    "general": ["Other ICU"],
}
ADMISSION_LOCATION_TERMS = {
    "emergency": _ROOM,
    "emergency room": _ROOM,
    "er": _ROOM,
    "ed": _ROOM,
    "transfer": ["TRANSFER FROM HOSPITAL", "TRANSFER FROM SKILLED NURSING FACILITY"],
    "hospital transfer": ["TRANSFER FROM HOSPITAL"],
    "snf transfer": _NURSING,
    "nursing home": _NURSING,
    "clinic": ["CLINIC REFERRAL"],
    "clinic referral": ["CLINIC REFERRAL"],
    "physician": ["PHYSICIAN REFERRAL"],
    "physician referral": ["PHYSICIAN REFERRAL"],
    "doctor referral": ["PHYSICIAN REFERRAL"],
    "walk-in": _WALK_IN,
    "walk in": _WALK_IN,
    "self referral": _WALK_IN,
    "pacu": ["PACU"],
    "procedure": ["PROCEDURE SITE"],
    "surgery": ["AMBULATORY SURGERY TRANSFER"],
}
# the coordinator keeps its own, slightly different term lists
NETWORK_ADMISSION_TYPE_TERMS = {
    "emergency": _EMERGENCY,
    "ew emer": ["EW EMER."],
    "ew emer.": ["EW EMER."],
    "direct emer": ["DIRECT EMER."],
    "direct emer.": ["DIRECT EMER."],
    "ew emergency": ["EW EMER."],
    "direct emergency": ["DIRECT EMER."],
    "urgent": ["URGENT"],
    "elective": ["ELECTIVE"],
    "scheduled": ["ELECTIVE"],
    "planned": ["ELECTIVE"],
    "observation": _OBSERVATION,
    "observation admit": ["OBSERVATION ADMIT"],
    "eu observation": ["EU OBSERVATION"],
    "direct observation": ["DIRECT OBSERVATION"],
    "ambulatory observation": ["AMBULATORY OBSERVATION"],
    "ambulatory": ["AMBULATORY OBSERVATION"],
    "surgical same day": _SAME_DAY,
    "surgical same day admission": _SAME_DAY,
    "same day": _SAME_DAY,
    "same day surgery": _SAME_DAY,
    "day surgery": _SAME_DAY,
}
NETWORK_ICU_TYPE_TERMS = {
    "cardiac": ["Cardiac ICU"],
    "cardiac icu": ["Cardiac ICU"],
    "ccu": ["Cardiac ICU"],
    "cvicu": ["Cardiac ICU"],
    "coronary": ["Cardiac ICU"],
    "medical": ["Medical ICU"],
    "medical icu": ["Medical ICU"],
    "micu": ["Medical ICU"],
    "surgical": ["Surgical ICU"],
    "surgical icu": ["Surgical ICU"],
    "sicu": ["Surgical ICU"],
    "tsicu": ["Surgical ICU"],
    "trauma": ["Surgical ICU"],
    "neuro": ["Neuro ICU"],
    "neuro icu": ["Neuro ICU"],
    "neurological": ["Neuro ICU"],
    "neuro surgical": ["Neuro ICU"],
    "mixed": _MIXED,
    "mixed icu": _MIXED,
    "other": ["Other ICU"],
    "other icu": ["Other ICU"],
}

TIER_PRIORITY = {"Tertiary Care Center": 0, "Community Hospital": 1, "Rural Hospital": 2}
UNKNOWN_TIER_PRIORITY = 99
TRANSPORT_MINUTES = {
    ("hospital_a", "hospital_b"): 45,
    ("hospital_a", "hospital_c"): 60,
    ("hospital_b", "hospital_a"): 45,
    ("hospital_b", "hospital_c"): 75,
    ("hospital_c", "hospital_a"): 60,
    ("hospital_c", "hospital_b"): 75,
}
DEFAULT_TRANSPORT_MINUTES = 60

# direct identifiers removed before a record leaves a site
DIRECT_IDENTIFIERS = [
    "subject_id", "hadm_id", "stay_id",
    "name", "first_name", "last_name",
    "address", "city", "state", "zip",
    "phone", "fax", "email",
    "ssn", "mrn", "account_number",
    "dob", "date_of_birth", "birth_date",
    "admission_date", "discharge_date",
    "ip_address", "device_id",
    "biometric", "photo", "fingerprint",
    "certificate_number", "license_number",
]
# identifiers whose mere presence as a column fails the schema check
FORBIDDEN_COLUMNS = [
    "subject_id", "hadm_id", "stay_id", "name", "ssn", "mrn",
    "phone", "email", "address", "dob", "admission_date",
    "discharge_date", "death_date", "exact_age",
]
REIDENTIFYING_COMBINATION = ["ethnicity", "insurance", "marital_status"]
SUSPICIOUS_PATTERNS = [
    "subject_id", "hadm_id", "stay_id",
    "ssn", "social security",
    "@", ".com", ".org",
    "mrn", "medical record",
]
SHARED_FIELDS = ["age_bucket", "risk_score_range", "admission_type", "early_icu_score", "icu_type"]

NUMERIC_FEATURES = [
    "age_at_admission", "los_icu_hours", "los_icu_days", "los_hospital_days",
    "los_hospital_hours", "n_distinct_icu_units", "is_mixed_icu", "n_icu_transfers",
    "n_total_transfers", "ed_admission_flag", "emergency_admission_flag",
    "hours_admit_to_icu", "early_icu_score", "weekend_admission", "night_admission",
]
CATEGORICAL_FEATURES = [
    "icu_type", "first_careunit", "admission_type", "admission_location",
    "insurance", "gender", "race", "marital_status",
]
EXCLUDED_COLUMNS = [
    "stay_id", "subject_id", "hadm_id", "icu_intime", "icu_outtime",
    "deathtime", "death_date", "assigned_hospital", "data_split",
]

K_ANONYMITY = 5
EPSILON = 0.1
PRIVACY_LEVEL = "k_anonymity_5"
PRIVACY_LEVEL_DP = "k_anonymity_5_dp_0.1"
LEGAL_BASIS = "45 CFR 164.506(c)"
EXTERNAL_QUERY_PURPOSE = "Treatment - finding appropriate care facility"
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

# ---- end of fixed values ---------------------------------------------------
