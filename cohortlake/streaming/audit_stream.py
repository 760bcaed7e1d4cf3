"""Structured Streaming over append-only logs.

Every function starts a query and returns it; ``run_available`` drains what is there.
Sinks are files under a checkpoint, so a restart neither loses nor repeats rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import DataStreamWriter

from cohortlake.operators import audit, evaluate as E, monitor as M
from cohortlake.sources.tables import path_exists


def read_files(
    spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet",
    files_per_trigger: int | None = None,
) -> DataFrame:
    """A stream of the parquet files that appear in a folder."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def run_available(writer: DataStreamWriter) -> None:
    """Process everything that is there, then stop."""
    writer.trigger(availableNow=True).start().awaitTermination()


def append_audit(events: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Access events to the day-partitioned audit log (ST1)."""
    records = audit.with_event_date(audit.build_records(events))
    return (
        records.writeStream.format("parquet")
        .partitionBy("event_date")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )


def action_counts(
    events: DataFrame, delay: str = "1 hour", width: str = "1 hour", ts: str = "event_timestamp",
    key: str = "kind",
) -> DataFrame:
    """Accesses per action and window; late rows count until the watermark passes (ST2)."""
    counts = (
        events.withWatermark(ts, delay)
        .groupBy(F.window(ts, width).alias("w"), key)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "n"
    )


def write_windows(windows: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Closed windows to files, each written once."""
    return (
        windows.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )


def monitor_days(scored: DataFrame, delay: str = "1 day", ts: str = "scored_at") -> DataFrame:
    """Daily confusion counts of a score stream (ST3)."""
    counted = (
        scored.withWatermark(ts, delay).groupBy(F.window(ts, "1 day").alias("w")).agg(*E.confusion_counts())
    )
    return counted.select(F.to_date("w.start").alias("day"), *E.COUNTS)


def _once(path: str, shape: Callable[[DataFrame], DataFrame]):
    """A batch writer whose output folder is named after the batch, so a replay overwrites it."""

    def write(batch: DataFrame, batch_id: int) -> None:
        shape(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def write_monitor(days: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Closed days with metrics, decision and reasons (ST3)."""
    def shape(batch: DataFrame) -> DataFrame:
        return M.retrain_decision(E.with_metrics(batch))

    return (
        days.writeStream.foreachBatch(_once(path, shape))
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )


def latest_status(updates: DataFrame) -> DataFrame:
    """Newest record per transfer, batch or stream (ST4)."""
    newest = F.struct("updated_at", "sequence")
    return updates.groupBy("transfer_id").agg(
        F.max_by("status", newest).alias("status"),
        F.max("updated_at").alias("updated_at"),
        F.max_by("sequence", newest).alias("sequence"),
    )


def write_status(updates: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Changed transfers of each micro-batch (ST4); state holds one row per transfer."""
    return (
        latest_status(updates).writeStream.foreachBatch(_once(path, lambda b: b))
        .option("checkpointLocation", checkpoint)
        .outputMode("update")
    )


def _folders(spark: SparkSession, path: str, prefix: str) -> dict[int, str]:
    """Numbered folders that were written to their end."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(target):
        return {}
    names = [s.getPath().getName() for s in fs.listStatus(target)]
    return {int(n.removeprefix(prefix)): f"{path}/{n}" for n in names
            if n.startswith(prefix) and path_exists(spark, f"{path}/{n}/_SUCCESS")}


def _drop(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def write_bounded_status(
    updates: DataFrame, path: str, checkpoint: str, keep: str = "7 days", compact_every: int = 10,
) -> DataStreamWriter:
    """Changed transfers of each micro-batch, with state that expires and batches that are merged (ST4).

    State holds one row per transfer and stretch of length ``keep``; a stretch that ended
    ``keep`` before the newest update is dropped, and so are updates that come later than
    that. Every ``compact_every`` batches the current status of all transfers is written to
    one folder; batches and folders that the one before it had already taken in are deleted, so a
    reader that has just listed them still finds its files.
    """
    newest = F.struct("updated_at", "sequence")
    changed = updates.withWatermark("updated_at", keep).groupBy(
        F.window("updated_at", keep).alias("stretch"), "transfer_id").agg(
        F.max_by("status", newest).alias("status"), F.max("updated_at").alias("last_at"),
        F.max_by("sequence", newest).alias("sequence"))
    rows = changed.select("transfer_id", "status", F.col("last_at").alias("updated_at"), "sequence")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # a batch can hold two stretches of one transfer
        latest_status(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        if (batch_id + 1) % compact_every:
            return
        before = _folders(spark, f"{path}/merged", "upto=")
        read_bounded_status(spark, path).write.mode("overwrite").parquet(f"{path}/merged/upto={batch_id}")
        done = max((n for n in before if n < batch_id), default=-1)
        for number, folder in {**_folders(spark, path, "batch=")}.items():
            if number <= done:
                _drop(spark, folder)
        for number, folder in before.items():
            if number < done:
                _drop(spark, folder)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update")


def read_bounded_status(spark: SparkSession, path: str) -> DataFrame:
    """Current status per transfer: the newest merged folder and the batches after it."""
    merged = _folders(spark, f"{path}/merged", "upto=")
    upto = max(merged, default=-1)
    batches = [folder for number, folder in sorted(_folders(spark, path, "batch=").items()) if number > upto]
    read = ([merged[upto]] if merged else []) + batches
    if not read:
        return spark.createDataFrame([], "transfer_id string, status string, updated_at timestamp, sequence long")
    return latest_status(spark.read.parquet(*read))


def read_status(spark: SparkSession, path: str) -> DataFrame:
    """Current status per transfer from the written changes."""
    return latest_status(spark.read.parquet(path).drop("batch"))
