"""Privacy expressions: generalisation, pseudonyms, noise."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from cohortlake.functions import vocabulary as V


def age_bucket(age: Column, width: int = 5, cap: bool = True) -> Column:
    """Age range such as '75-80'; ages over 89 become '90+' when capped."""
    start = (F.floor(age / width) * width).cast("int")
    text = F.concat(start.cast("string"), F.lit("-"), (start + width).cast("string"))
    return F.when(age > 89, "90+").otherwise(text) if cap else text


def score_range(score: Column) -> Column:
    """Score range of width 0.1 such as '0.7-0.8' (V02)."""
    tenths = F.floor(score * 10).cast("int")

    def text(n: Column) -> Column:
        whole = F.floor(n / 10).cast("int")
        return F.concat(whole.cast("string"), F.lit("."), (n - whole * 10).cast("string"))

    return F.concat(text(tenths), F.lit("-"), text(tenths + 1))


def range_floor(text: Column) -> Column:
    """Lower bound of a range string, NULL when there is none."""
    return F.when(F.contains(text, F.lit("-")), F.split_part(text, F.lit("-"), F.lit(1)).try_cast("double"))


def age_bounds(bucket: Column, top: int = 120) -> Column:
    """Struct(low, high) of '75-80', '85+' or '85' (V12)."""
    clean = F.regexp_replace(bucket, r"\+", f"-{top}")
    low = F.split_part(clean, F.lit("-"), F.lit(1)).try_cast("int")
    high = F.split_part(clean, F.lit("-"), F.lit(2)).try_cast("int")
    return F.struct(low.alias("low"), F.coalesce(high, F.lit(top)).alias("high"))


def pseudonym(key: Column, day: Column, length: int = 16) -> Column:
    """Day-salted pseudonym of a key."""
    text = F.concat(F.lit("patient_"), key.cast("string"), F.lit("_"), day)
    return F.substring(F.sha2(text, 256), 1, length)


def laplace(uniform: Column, scale: float) -> Column:
    """Laplace draw from a uniform in (0, 1), by the inverse distribution function."""
    centred = F.greatest(uniform, F.lit(1e-12)) - 0.5
    return -F.signum(centred) * scale * F.log(1 - 2 * F.abs(centred))


def shared_fields(names=tuple(V.SHARED_FIELDS), fallback: str = "anonymized_patient_profile") -> Column:
    """Names of the non-empty fields of a record, joined."""
    def present(name: str) -> Column:
        text = F.col(name).cast("string")
        return F.when(text.isNotNull() & ~text.isin("", "0"), F.lit(name))

    joined = F.concat_ws(", ", F.array_compact(F.array(*[present(n) for n in names])))
    return F.when(joined == "", fallback).otherwise(joined)
