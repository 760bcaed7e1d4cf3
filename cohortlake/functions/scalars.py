"""General scalar helpers: guards, bins, casts, hashes, JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Ratio that is 0 where the denominator is 0."""
    return F.when(denominator > 0, numerator.cast("double") / denominator.cast("double")).otherwise(
        F.lit(0.0)
    )


def percent_change(current: Column, baseline: Column) -> Column:
    """Percent change, 0 for an empty baseline, two decimals."""
    change = (current - baseline).cast("double") / baseline.cast("double") * 100
    return F.round(F.when(baseline > 0, change).otherwise(F.lit(0.0)), 2)


def clamp(value: Column, low: Column | float, high: Column | float) -> Column:
    """Value limited to [low, high] (P33); NULL stays NULL."""
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.when(value.isNotNull(), F.greatest(low, F.least(high, value)))


def cast_or(value: Column, type_name: str, default) -> Column:
    """Lenient cast with a default for NULL, NaN and unparsable input."""
    cast = value.try_cast(type_name)
    if type_name in ("double", "float"):
        cast = F.when(~F.isnan(cast), cast)
    return F.coalesce(cast, F.lit(default).cast(type_name))


def bin_column(
    value: Column, edges: Sequence[float], labels: Sequence[str], right: bool
) -> Column:
    """Label of the interval that holds the value; NULL outside the edges.

    ``right=True`` closes intervals on the right, ``(a, b]``; otherwise ``[a, b)``.
    """
    if len(labels) != len(edges) - 1:
        raise ValueError("one label per interval is needed")
    out = None
    for low, high, label in zip(edges, edges[1:], labels):
        inside = (
            (value > low) & (value <= high) if right else (value >= low) & (value < high)
        )
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out


def known(value: Column) -> Column:
    """NULL category as 'Unknown', everything as string."""
    return F.coalesce(value.cast("string"), F.lit("Unknown"))


def percent_text(rate: Column, digits: int = 1) -> Column:
    """A rate shown as percent text."""
    return F.concat(F.format_string(f"%.{digits}f", F.round(rate * 100, digits)), F.lit("%"))


def stable_bucket(key: Column, salt: str = "", buckets: int = 100) -> Column:
    """Deterministic bucket of a key, from the first 32 bits of its MD5."""
    text = key.cast("string")
    if salt:
        text = F.concat(F.lit(salt), text)
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % buckets


def fast_bucket(key: Column, buckets: int = 100) -> Column:
    """Cheaper bucket for Spark-only use; differs from ``stable_bucket``."""
    return F.pmod(F.xxhash64(key), F.lit(buckets))


def hash_unit(key: Column, salt: str) -> Column:
    """Deterministic pseudo-uniform value in [0, 1) for a key."""
    text = F.concat(F.lit(salt), key.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def canonical_json(fields: Sequence[str]) -> Column:
    """JSON of the named columns in sorted key order with NULLs kept."""
    return F.to_json(
        F.struct(*[F.col(name) for name in sorted(fields)]), {"ignoreNullFields": "false"}
    )


def flag_map(text: Column) -> Column:
    """Capability flags from JSON text, nested or flat (F16); NULL when unparsable."""
    flat = F.from_json(text, "map<string,boolean>")
    nested = F.from_json(text, "struct<specialized_capabilities:map<string,boolean>>")
    inner = nested.getField("specialized_capabilities")
    return F.coalesce(inner, flat)


def lenient_list(text: Column) -> Column:
    """List of strings from JSON text that may use single quotes (F17); empty when unparsable."""
    parsed = F.from_json(F.regexp_replace(text, "'", '"'), "array<string>")
    return F.coalesce(parsed, F.array().cast("array<string>"))


def non_null_list(*items: Column) -> Column:
    """Array of the items that are not NULL, in order."""
    return F.array_compact(F.array(*items))


def log_id(prefix: str, when: Column) -> Column:
    """Unique record id: prefix, time, eight random hex digits."""
    return F.concat(
        F.lit(f"{prefix}_"),
        F.date_format(when, "yyyyMMdd_HHmmss"),
        F.lit("_"),
        F.substring(F.regexp_replace(F.uuid(), "-", ""), 1, 8),
    )
