"""Time arithmetic and calendar flags.

Inputs may be TIMESTAMP or TIMESTAMP_NTZ; the session zone is expected to be UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MICROS_PER_HOUR = 3_600_000_000
MICROS_PER_DAY = 86_400_000_000


def whole_units(unit: str, start: Column, end: Column) -> Column:
    """Completed units between two times, truncated towards zero."""
    return F.timestamp_diff(unit, start, end)


def elapsed(start: Column, end: Column, micros_per_unit: int) -> Column:
    """Fractional elapsed time."""
    def micros(c: Column) -> Column:
        return F.unix_micros(c.cast("timestamp"))

    return (micros(end) - micros(start)) / F.lit(float(micros_per_unit))


def elapsed_days(start: Column, end: Column) -> Column:
    return elapsed(start, end, MICROS_PER_DAY)


def elapsed_hours(start: Column, end: Column) -> Column:
    return elapsed(start, end, MICROS_PER_HOUR)


def age_at(anchor_age: Column, anchor_year: Column, when: Column) -> Column:
    """Age at an event from an anchor age and year."""
    return anchor_age + F.year(when) - anchor_year


def weekend_flag(ts: Column) -> Column:
    return F.dayofweek(ts).isin(1, 7).cast("int")


def night_flag(ts: Column) -> Column:
    return ((F.hour(ts) >= 18) | (F.hour(ts) < 6)).cast("int")


def day_name(ts: Column) -> Column:
    return F.date_format(ts, "EEEE")


def shift_of(hour: Column) -> Column:
    """Work shift of an hour, right-closed bands."""
    return (
        F.when(hour <= 7, "Night (0-7)").when(hour <= 15, "Day (8-15)").otherwise("Evening (16-23)")
    )


def parse_iso(text: Column) -> Column:
    """ISO timestamp or NULL; a trailing Z means UTC."""
    return F.try_to_timestamp(F.trim(text))


def _keyword_flag(
    text: Column, yes: list[str], no: list[str], parsed: Column, default: int | Column
) -> Column:
    upper = F.upper(text)
    default = default if isinstance(default, Column) else F.lit(default)
    return (
        F.when(upper.rlike("|".join(yes)), 1)
        .when(upper.rlike("|".join(no)), 0)
        .otherwise(F.coalesce(parsed, default))
        .cast("int")
    )


def weekend_from_text(text: Column, default: int | Column | None = None) -> Column:
    """Weekend flag from a day word or an ISO string, words first.

    Text that is neither takes ``default``; without one, the flag of the current time.
    """
    return _keyword_flag(
        text,
        ["SATURDAY", "SUNDAY", "WEEKEND"],
        ["MONDAY", "TUESDAY", "WEDNESDAY", "THURSDAY", "FRIDAY", "WEEKDAY"],
        weekend_flag(parse_iso(text)),
        weekend_flag(F.current_timestamp()) if default is None else default,
    )


def night_from_text(text: Column, default: int | Column | None = None) -> Column:
    """Night flag from a word or an ISO string, words first."""
    return _keyword_flag(
        text,
        ["NIGHT", "EVENING", "PM"],
        ["MORNING", "AFTERNOON", "DAY", "AM"],
        night_flag(parse_iso(text)),
        night_flag(F.current_timestamp()) if default is None else default,
    )


def look_back(anchor: Column, hours: int) -> Column:
    """Anchor minus n hours."""
    return anchor - F.make_dt_interval(F.lit(0), F.lit(hours), F.lit(0), F.lit(0.0).cast("decimal(18,6)"))
