"""Column profiles, schema rows, drift and quality rules, all in long form."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from cohortlake.functions.scalars import percent_change

PROFILE_COLUMNS = [
    "count", "distinct", "mean", "min", "max", "stddev", "avg_length",
    "earliest", "latest", "true_count", "false_count",
]
_TYPES = {
    "count": "bigint", "distinct": "bigint", "mean": "double", "min": "double", "max": "double",
    "stddev": "double", "avg_length": "double", "earliest": "timestamp_ntz",
    "latest": "timestamp_ntz", "true_count": "bigint", "false_count": "bigint",
}


def field_kind(data_type: T.DataType) -> str | None:
    """numeric, string, temporal or boolean; None for types that are not profiled."""
    if isinstance(data_type, T.NumericType):
        return "numeric"
    if isinstance(data_type, T.StringType):
        return "string"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "temporal"
    return "boolean" if isinstance(data_type, T.BooleanType) else None


def _statistics(name: str, kind: str, approximate: bool, distinct_of: Sequence[str]) -> dict[str, Column]:
    c = F.col(f"`{name}`")
    # the length stands for a string, so the rows of the aggregate carry no text
    out = {"count": F.count(F.length(c) if kind == "string" else c)}
    if kind in distinct_of:
        # a string is told apart by its 16-byte digest, so no text is shuffled
        value = F.unhex(F.md5(c.cast("binary"))) if kind == "string" else c
        out["distinct"] = F.approx_count_distinct(c) if approximate else F.countDistinct(value)
    if kind == "numeric":
        v = c.cast("double")
        out |= {"mean": F.avg(v), "min": F.min(v), "max": F.max(v), "stddev": F.stddev_samp(v)}
    elif kind == "string":
        out["avg_length"] = F.avg(F.length(c).cast("double"))
    elif kind == "temporal":
        out |= {"earliest": F.min(c), "latest": F.max(c)}
    else:
        out |= {"true_count": F.count_if(c), "false_count": F.count_if(~c)}
    return out


COUNTED_KINDS = ("numeric", "string")


def profile(
    df: DataFrame, table: str, approximate: bool = False, only: Sequence[str] | None = None,
    distinct_of: Sequence[str] = COUNTED_KINDS,
) -> DataFrame:
    """Statistics of every column from one aggregate, one row per column.

    ``approximate`` swaps the exact distinct counts, which shuffle every distinct value
    (of strings, its digest), for sketches. ``only`` restricts the kinds of columns before
    the aggregate, ``distinct_of`` those whose distinct values are counted.
    """
    kinds = {f.name: field_kind(f.dataType) for f in df.schema.fields}
    if only is not None:
        kinds = {name: kind if kind in only else None for name, kind in kinds.items()}
    aggs, rows = [F.count(F.lit(1)).alias("_rows")], []
    for i, (name, kind) in enumerate((n, k) for n, k in kinds.items() if k):
        stats = _statistics(name, kind, approximate, distinct_of)
        aggs += [c.alias(f"{s}_{i}") for s, c in stats.items()]
        rows.append(
            F.struct(
                F.lit(name).alias("field"),
                F.lit(kind).alias("kind"),
                *[
                    (F.col(f"{s}_{i}") if s in stats else F.lit(None)).cast(_TYPES[s]).alias(s)
                    for s in PROFILE_COLUMNS
                ],
            )
        )
    wide = df.agg(*aggs)
    return wide.select(
        F.lit(table).alias("table_name"), F.col("_rows").alias("row_count"), F.inline(F.array(*rows))
    )


def layer_profile(
    tables: Mapping[str, DataFrame], layer: str, approximate: bool = False,
    distinct_of: Sequence[str] = COUNTED_KINDS,
) -> DataFrame:
    """Profiles of all tables of a layer (Q02)."""
    parts = [profile(df, name, approximate, distinct_of=distinct_of) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts).withColumn("layer", F.lit(layer))


def layer_rollup(profiles: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Tables, rows and megabytes per layer and in total."""
    tables = profiles.groupBy("layer", "table_name").agg(F.max("row_count").alias("row_count"))
    if sizes is not None:
        tables = tables.join(sizes.select("table_name", "size_mb"), "table_name", "left")
    else:
        tables = tables.withColumn("size_mb", F.lit(None).cast("double"))
    return tables.rollup("layer").agg(
        F.count(F.lit(1)).alias("n_tables"),
        F.sum("row_count").alias("total_rows"),
        F.round(F.sum("size_mb"), 2).alias("total_mb"),
    ).withColumn("layer", F.coalesce("layer", F.lit("TOTAL")))


# ---- schemas ----------------------------------------------------------------------


def _walk(fields: Sequence[T.StructField], prefix: str = "", depth: int = 0):
    for field in fields:
        data_type, mode = field.dataType, "NULLABLE" if field.nullable else "REQUIRED"
        if isinstance(data_type, T.ArrayType):
            data_type, mode = data_type.elementType, "REPEATED"
        yield prefix + field.name, data_type.typeName(), mode
        if isinstance(data_type, T.StructType) and depth == 0:
            yield from _walk(data_type.fields, f"{prefix}{field.name}.", 1)


def schema_rows(tables: Mapping[str, DataFrame], layer: str) -> DataFrame:
    """One row per field, nested fields one level deep, with the table's row count (Q01)."""
    parts = []
    for name, df in tables.items():
        entries = [
            F.struct(
                F.lit(i).alias("position"), F.lit(path).alias("field"),
                F.lit(kind).alias("field_type"), F.lit(mode).alias("mode"),
            )
            for i, (path, kind, mode) in enumerate(_walk(df.schema.fields))
        ]
        counted = df.agg(F.count(F.lit(1)).alias("n_rows"))
        parts.append(
            counted.select(
                F.lit(layer).alias("layer"), F.lit(name).alias("table_name"), "n_rows",
                F.inline(F.array(*entries)),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def schema_drift(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Added, removed, retyped and remoded fields, new tables and new layers.

    Fields of a table that the baseline does not know are reported once, as the table.
    """
    keys = ["layer", "table_name"]
    layers = baseline.select("layer").distinct().withColumn("_layer_known", F.lit(True))
    tables = baseline.select(*keys).distinct().withColumn("_known", F.lit(True))
    there = current.select(*keys).distinct().withColumn("_still", F.lit(True))
    fresh = (
        there.join(layers, "layer", "left")
        .join(tables, keys, "left")
        .filter(F.col("_known").isNull())
        .select(
            *keys, F.lit(None).cast("string").alias("field"),
            F.when(F.col("_layer_known").isNull(), "new_layer").otherwise("new_table").alias("change"),
            F.lit(None).cast("string").alias("old"), F.lit(None).cast("string").alias("new"),
        )
    )
    old = baseline.select(*keys, "field", F.col("field_type").alias("old_type"), F.col("mode").alias("old_mode"))
    new = current.select(*keys, "field", F.col("field_type").alias("new_type"), F.col("mode").alias("new_mode"))
    both = new.join(tables, keys, "left_semi").join(
        old.join(there, keys, "left_semi"), [*keys, "field"], "full_outer"
    )
    def change(test: Column, kind: str, was: Column, now: Column) -> Column:
        return F.when(test, F.struct(F.lit(kind).alias("change"), was.alias("old"), now.alias("new")))

    ot, nt, om, nm = (F.col(c) for c in ("old_type", "new_type", "old_mode", "new_mode"))
    changes = F.array_compact(F.array(
        change(ot.isNull(), "added", ot, nt),
        change(nt.isNull(), "removed", ot, nt),
        change(ot != nt, "type", ot, nt),
        change(om != nm, "mode", om, nm),
    ))
    return both.select(*keys, "field", F.inline(changes)).unionByName(fresh)


def table_drift(
    current: DataFrame, baseline: DataFrame,
    current_sizes: DataFrame | None = None, baseline_sizes: DataFrame | None = None,
) -> DataFrame:
    """Row-count change per table; it does not count as schema drift.

    With the stored sizes of both states (``table_name``, ``size_mb``) the change in
    megabytes stands beside it.
    """
    keys = ["layer", "table_name"]
    def counts(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.max("n_rows").alias(name))

    out = counts(current, "current_rows").join(counts(baseline, "baseline_rows"), keys, "left").select(
        *keys, "baseline_rows", "current_rows",
        (F.col("current_rows") - F.col("baseline_rows")).alias("delta"),
        percent_change(F.col("current_rows"), F.col("baseline_rows")).alias("percent_change"),
    )
    if current_sizes is None or baseline_sizes is None:
        return out
    now = current_sizes.select("table_name", F.col("size_mb").alias("current_mb"))
    was = baseline_sizes.select("table_name", F.col("size_mb").alias("baseline_mb"))
    return out.join(was, "table_name", "left").join(now, "table_name", "left").withColumn(
        "delta_mb", F.round(F.col("current_mb") - F.col("baseline_mb"), 2)
    )


def with_row_deltas(drift: DataFrame, tables: DataFrame) -> DataFrame:
    """Schema changes beside the row counts of their table; tables without a change stay too (Q03)."""
    deltas = tables.select("layer", "table_name", "baseline_rows", "current_rows", "delta")
    return drift.join(deltas, ["layer", "table_name"], "full_outer")


def drift_totals(drift: DataFrame) -> DataFrame:
    """Number of schema changes and of changed tables per layer and over all layers (Q03)."""
    # one row per changed table before the totals
    tables = drift.groupBy("layer", "table_name").agg(F.count(F.lit(1)).alias("_n"))
    return tables.rollup("layer").agg(
        F.sum("_n").alias("n_drifts"), F.count(F.lit(1)).alias("n_tables")
    ).withColumn("layer", F.coalesce("layer", F.lit("TOTAL")))


# ---- quality ------------------------------------------------------------------------

ROW_CHANGE_LIMIT, NULL_RATE_LIMIT, DISTINCT_RATIO_LIMIT = 50.0, 0.3, 0.01


def quality_findings(
    current: DataFrame, baseline: DataFrame | None = None,
    row_change: float = ROW_CHANGE_LIMIT, null_rate: float = NULL_RATE_LIMIT,
    distinct_ratio: float = DISTINCT_RATIO_LIMIT,
) -> DataFrame:
    """Errors and warnings of a profile (Q04).

    A row count that moved by more than ``row_change`` percent is an error; a high null
    rate, or a string column with too few distinct values, is a warning.
    """
    keys = ["layer", "table_name"]
    rows, count = F.col("row_count"), F.col("count")
    nulls = F.when(rows > 0, 1 - count / rows.cast("double")).otherwise(0.0)
    ratio = F.when(count > 0, F.col("distinct") / count.cast("double")).otherwise(0.0)

    def finding(test: Column, level: str, kind: str, value: Column) -> Column:
        return F.when(
            test, F.struct(F.lit(level).alias("level"), F.lit(kind).alias("type"), value.alias("value"))
        )

    fields = current.select(*keys, "field", F.inline(F.array_compact(F.array(
        finding(nulls > null_rate, "warning", "high_null_rate", nulls),
        finding(
            (F.col("kind") == "string") & (ratio < distinct_ratio), "warning", "low_cardinality", ratio
        ),
    ))))
    if baseline is None:
        return fields
    def counts(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.max("row_count").alias(name))

    pair = counts(current, "now").join(counts(baseline, "was"), keys).filter(F.col("was") > 0)
    moved = F.abs((F.col("now") - F.col("was")) / F.col("was").cast("double") * 100)
    tables = pair.filter(moved > row_change).select(
        *keys, F.lit(None).cast("string").alias("field"), F.lit("error").alias("level"),
        F.lit("row_count_anomaly").alias("type"), moved.alias("value"),
    )
    return fields.unionByName(tables)


def quality_totals(findings: DataFrame) -> DataFrame:
    """Errors, warnings and the overall pass (Q05)."""
    return findings.agg(
        F.count_if(F.col("level") == "error").alias("total_errors"),
        F.count_if(F.col("level") == "warning").alias("total_warnings"),
    ).withColumn("overall_passed", F.col("total_errors") == 0)


def require_quality(findings: DataFrame) -> None:
    """Raise when there are errors (Q05)."""
    row = quality_totals(findings).first()
    if not row["overall_passed"]:
        raise ValueError(f"data quality: {row['total_errors']} errors")


def quality_summary(
    profiles: DataFrame, schemas: DataFrame, drift: DataFrame, findings: DataFrame
) -> DataFrame:
    """Tables, fields, rows, drifted tables, errors and warnings per layer (Q06)."""
    tables = profiles.groupBy("layer", "table_name").agg(F.max("row_count").alias("r"))
    sizes = tables.groupBy("layer").agg(
        F.count(F.lit(1)).alias("n_tables"), F.sum("r").alias("total_rows")
    )
    fields = schemas.groupBy("layer").agg(F.count(F.lit(1)).alias("n_fields"))
    moved = drift.groupBy("layer").agg(F.countDistinct("table_name").alias("n_drifted"))
    issues = findings.groupBy("layer").agg(
        F.count_if(F.col("level") == "error").alias("n_errors"),
        F.count_if(F.col("level") == "warning").alias("n_warnings"),
    )
    out = sizes
    for part in (fields, moved, issues):
        out = out.join(part, "layer", "full_outer")
    counts = ["n_tables", "total_rows", "n_fields", "n_drifted", "n_errors", "n_warnings"]
    return out.fillna(0, counts).withColumn("passed", F.col("n_errors") == 0)


def null_rate_increase(current: DataFrame, baseline: DataFrame, limit: float = 0.05) -> DataFrame:
    """Rise of the null rate per field between two profiles (Q09)."""
    def rates(df: DataFrame, name: str) -> DataFrame:
        rate = F.when(F.col("row_count") > 0, 1 - F.col("count") / F.col("row_count").cast("double"))
        return df.select("field", F.coalesce(rate, F.lit(0.0)).alias(name))

    rise = F.col("now") - F.col("was")
    return rates(current, "now").join(rates(baseline, "was"), "field").select(
        "field", rise.alias("increase"), (rise > limit).alias("alert")
    )
