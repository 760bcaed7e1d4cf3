"""SQL forms of the term mappings, used only to check query results in another engine."""

from __future__ import annotations

from cohortlake.functions import vocabulary as V
from cohortlake.plans.checks import any_like, cases, lst

GENDER = """CASE WHEN trim(upper(gender_text)) IN ('M', 'MALE', 'MAN') THEN 'M'
    WHEN trim(upper(gender_text)) IN ('F', 'FEMALE', 'WOMAN') THEN 'F' END"""


def term_table(name, mapping):
    rows = ", ".join(f"({i}, '{k}', {lst(v)})" for i, (k, v) in enumerate(mapping.items()))
    return f"{name} AS (SELECT * FROM (VALUES {rows}) AS v(p, term, vals))"


def mapped(text, table, valid, default, empty):
    """SQL of a term mapping: exact value, term, substring either way, default."""
    norm = f"lower(trim({text}))"
    return f"""CASE WHEN {text} IS NULL THEN {lst(empty)}
      ELSE coalesce((SELECT [v] FROM (SELECT unnest({lst(valid)}) AS v) WHERE lower(v) = {norm}),
        (SELECT vals FROM {table} WHERE term = {norm}),
        (SELECT vals FROM {table} WHERE contains({norm}, term) OR contains(term, {norm}) ORDER BY p LIMIT 1),
        {lst(default)}) END"""


ADMISSION_MAP = mapped("admission_text", "adm", V.ADMISSION_TYPES, V.EMERGENCY_ADMISSION_TYPES, ["EW EMER."])
ICU_MAP = mapped("icu_text", "icu", V.ICU_TYPES, V.ICU_TYPES, V.ICU_TYPES)
LOCATION_MAP = mapped("location_text", "loc", V.ADMISSION_LOCATIONS, V.ADMISSION_LOCATIONS, V.ADMISSION_LOCATIONS)
TERM_TABLES = ", ".join([
    term_table("adm", V.ADMISSION_TYPE_TERMS), term_table("icu", V.ICU_TYPE_TERMS),
    term_table("loc", V.ADMISSION_LOCATION_TERMS), term_table("nadm", V.NETWORK_ADMISSION_TYPE_TERMS),
    term_table("nicu", V.NETWORK_ICU_TYPE_TERMS)])
NORMALISED = "lower(trim(admission_text))"


def _category(x, text, categories, exact=()):
    rules = [(f"{x} IS NULL OR {x} = ''", "'UNKNOWN'")]
    rules += [
        (f"{text} = '{name}'" if name in exact else any_like(text, words), f"'{name}'")
        for name, words in categories
    ]
    return cases(rules, "'OTHER'")


def category(x):
    return _category(x, f"upper({x})", V.ADMISSION_CATEGORIES, V.EXACT_ADMISSION_CATEGORIES)


def icu_category(x):
    return _category(x, f"lower({x})", V.ICU_CATEGORIES)
