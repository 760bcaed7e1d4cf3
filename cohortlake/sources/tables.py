"""Readers, writers, samples, baselines and the snapshot manifest."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from cohortlake.functions.scalars import hash_unit


# ---- scans --------------------------------------------------------------------


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Full scan (S01); a declared schema spares the footer inference."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def scan_split(df: DataFrame, *splits: str) -> DataFrame:
    """Rows of the given splits (S02, P19); prunes partitions of a partitioned table."""
    return df.filter(F.col("data_split").isin(*splits))


def concat_sites(sites: Mapping[str, DataFrame], tag: str | None = None) -> DataFrame:
    """Per-site frames as one, optionally with the site name as a column."""
    frames = [df.withColumn(tag, F.lit(name)) if tag else df for name, df in sites.items()]
    return reduce(lambda a, b: a.unionByName(b), frames)


def fit_scope(df: DataFrame, site: str = "all", column: str = "assigned_hospital") -> DataFrame:
    """Training rows of one site, or of every site for 'all' (S05)."""
    train = scan_split(df, "train")
    return train if site == "all" else train.filter(F.col(column) == site)


def first_rows(df: DataFrame, order: Sequence[str | Column], n: int) -> DataFrame:
    """First n rows of an order (S20); a bounded heap per partition, no global sort."""
    return df.orderBy(*order).limit(n)


def random_rows(df: DataFrame, n: int, seed: int) -> DataFrame:
    """Uniform random n rows (S17); another draw per seed and per partitioning."""
    return df.orderBy(F.rand(seed)).limit(n)


def hashed_rows(df: DataFrame, key: str, n: int, salt: str) -> DataFrame:
    """Reproducible random n rows, by a salted hash of the key."""
    return df.orderBy(hash_unit(F.col(key), salt), key).limit(n)


def disjoint_samples(df: DataFrame, key: str, n: int, background: int, salt: str) -> DataFrame:
    """A sample and a separate background sample, tagged by role.

    One ordering serves both: the first n rows are the sample, the next the background.
    """
    rank = F.row_number().over(_bounded_order(key, salt))
    picked = hashed_rows(df, key, n + background, salt)
    return picked.withColumn("role", F.when(rank <= n, "sample").otherwise("background"))


def _bounded_order(key: str, salt: str):
    from pyspark.sql import Window

    # only ever applied after limit(): the rows are bounded by the sample size
    return Window.orderBy(hash_unit(F.col(key), salt), F.col(key))


def percent_rows(df: DataFrame, fraction: float, seed: int) -> DataFrame:
    """Bernoulli sample of a share of the rows."""
    return df.sample(fraction, seed)


# ---- sinks --------------------------------------------------------------------


def spread(df: DataFrame, by: Sequence[str], key: str | None, files: int | None) -> DataFrame:
    """Rows placed by partition value, so that a value is written by few tasks but not by one.

    With ``files`` each value goes to that many tasks. Without, adaptive execution rebalances:
    a value with many rows is split by its measured size, small ones share a task.
    """
    if files is not None and key is not None:
        return df.repartition(*by, F.pmod(F.xxhash64(F.col(key)), F.lit(files)))
    return df.hint("rebalance", *by)


def write_table(
    df: DataFrame, path: str, by: Sequence[str] = (), key: str | None = None, files: int | None = None,
    mode: str = "overwrite",
) -> None:
    """Write parquet, optionally partitioned.

    Partition columns are often few and uneven, so large values are split over several
    tasks (see ``spread``) instead of one task per partition value.
    """
    if by:
        df = spread(df, by, key, files)
    writer = df.write.mode(mode)
    if by:
        writer = writer.partitionBy(*by)
    writer.parquet(path)


def append_table(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Append rows."""
    writer = df.write.mode("append")
    if by:
        writer = writer.partitionBy(*by)
    writer.parquet(path)


def ensure_layers(spark: SparkSession, layers: Sequence[str], folder: str) -> None:
    """Create the database of each layer when absent."""
    for layer in layers:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{layer}` LOCATION '{folder}/{layer}'")


def drop_layers(spark: SparkSession, layers: Sequence[str]) -> None:
    """Take layers out of the catalog. Tables stored under a path of their own keep their files."""
    for layer in layers:
        for table in spark.catalog.listTables(layer):
            spark.sql(f"DROP TABLE IF EXISTS `{layer}`.`{table.name}`")
        spark.sql(f"DROP DATABASE IF EXISTS `{layer}`")


def layer_tables(spark: SparkSession, layers: Sequence[str]) -> dict[str, list[str]]:
    """Table names per layer from the catalog."""
    return {
        layer: sorted(t.name for t in spark.catalog.listTables(layer) if not t.isTemporary)
        for layer in layers
    }


def export_csv(tables: Mapping[str, DataFrame], folder: str) -> None:
    """Each table as a CSV folder, written in parallel by its partitions."""
    for name, df in tables.items():
        flat = [
            F.to_json(f.name).alias(f.name)
            if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
            else F.col(f.name)
            for f in df.schema.fields
        ]
        df.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{folder}/{name}")


def manifest(run_id: str, tables: Mapping[str, DataFrame], paths: Mapping[str, str]) -> DataFrame:
    """Row count, schema and path of each table of a run."""
    rows = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(run_id).alias("run_id"),
            F.lit(name).alias("table_name"),
            "row_count",
            F.lit(df.schema.json()).alias("schema_json"),
            F.lit(paths[name]).alias("path"),
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, rows)


def save_report(df: DataFrame, folder: str) -> None:
    """A small result as one CSV and one JSON file."""
    one = df.coalesce(1)
    one.write.mode("overwrite").option("header", True).csv(f"{folder}/csv")
    one.write.mode("overwrite").json(f"{folder}/json")


def read_report(spark: SparkSession, folder: str, schema: T.StructType, kind: str = "csv") -> DataFrame:
    """A saved report with its schema."""
    reader = spark.read.schema(schema)
    if kind == "csv":
        return reader.option("header", True).csv(f"{folder}/csv")
    return reader.json(f"{folder}/json")


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def baseline(df: DataFrame, path: str) -> DataFrame:
    """The stored baseline; the first call stores ``df``."""
    spark = df.sparkSession
    if not path_exists(spark, path):
        df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def table_size(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Rows, bytes and megabytes of a stored table."""
    rows = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("row_count"))
    files = spark.read.format("binaryFile").load(path).select("length")
    size = files.agg(F.sum("length").alias("size_bytes"))
    both = rows.withColumn("size_bytes", F.lit(None).cast("bigint")).unionByName(
        size.withColumn("row_count", F.lit(None).cast("bigint"))
    )
    return both.agg(
        F.max("row_count").alias("row_count"), F.max("size_bytes").alias("size_bytes")
    ).select(
        F.lit(name).alias("table_name"),
        "row_count",
        "size_bytes",
        F.round(F.col("size_bytes") / 1048576, 2).alias("size_mb"),
    )


def append_and_read(df: DataFrame, path: str, by: Sequence[str] = ()) -> DataFrame:
    """Append rows and read the table back."""
    append_table(df, path, by)
    return df.sparkSession.read.parquet(path)
