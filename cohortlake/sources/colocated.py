"""Tables stored in buckets of a join key, so that joins and groupings on it need no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: buckets of a table, and the rows that one task may have to read and sort
BUCKETS, BUCKET_ROWS = 200, 5_000_000


def largest_bucket(df: DataFrame, key: str, buckets: int) -> int:
    """Rows of the fullest bucket; rows without a key share one. At most ``buckets`` rows are shuffled per task."""
    counts = df.groupBy(F.pmod(F.hash(key), F.lit(buckets)).alias("bucket")).count()
    return counts.agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]


def store(
    df: DataFrame, name: str, key: str, path: str, buckets: int = BUCKETS, most: int = BUCKET_ROWS,
) -> DataFrame:
    """Write ``df`` as table ``name``, bucketed and sorted by ``key``, one file per bucket; the stored table.

    Joins and aggregates on ``key`` between tables with the same ``buckets`` read matching
    buckets together. A bucket is read by one task and cannot be split, so the rows of the
    fullest one are counted first: beyond ``most`` the table is written without buckets, its
    joins shuffle, and adaptive execution splits the hot key. ``df`` is read twice; pass a
    stored table where it is costly to compute. An empty table is stored with its schema.
    """
    writer = df.write
    if largest_bucket(df, key, buckets) <= most:
        writer = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
    writer.mode("overwrite").option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def is_bucketed(spark: SparkSession, name: str) -> bool:
    """Whether the stored table has buckets, or was too uneven for them."""
    rows = spark.sql(f"DESCRIBE EXTENDED {name}").filter("col_name = 'Num Buckets'").collect()
    return bool(rows) and rows[0]["data_type"].isdigit()
