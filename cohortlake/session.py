"""Session helpers shared by tests, bench and the query catalogue."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str, cores: str = "*", memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # groups kept in memory before an object aggregate starts to sort
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "65536")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, taken from ``spark.checkpoint.dir``.

    A private folder is made only in local mode with the setting absent.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="cohortlake-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def run_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared folder for one write."""
    return f"{shared_dir(spark).rstrip('/')}/cohortlake/{name}-{uuid.uuid4().hex}"


#: tables written outside of any scope
_unscoped: list[str] = []
_intermediates: ContextVar[list[str]] = ContextVar("intermediates", default=_unscoped)


def materialise(df: DataFrame) -> DataFrame:
    """An intermediate result written to the shared folder, to be read more than once.

    The written table cuts the lineage, survives lost executors, and gives the planner
    its size and column pruning. It stays until the ``intermediates`` scope around the
    call ends, or until ``drop_intermediates``.
    """
    path = run_path(df.sparkSession, "intermediate")
    df.write.parquet(path)
    _intermediates.get().append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_intermediates(spark: SparkSession) -> int:
    """Delete the intermediate tables of the current scope; results built on them end with it.

    Tables of other scopes, of this thread or another, are left alone.
    """
    written = _intermediates.get()
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    dropped = 0
    while written:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(written.pop())
        dropped += bool(target.getFileSystem(hadoop).delete(target, True))
    return dropped


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """A scope of its own for intermediate tables: they are deleted when it ends.

    Write or collect the results inside it.
    """
    token = _intermediates.set([])
    try:
        yield
    finally:
        drop_intermediates(spark)
        _intermediates.reset(token)
