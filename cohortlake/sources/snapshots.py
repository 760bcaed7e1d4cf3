"""Versions of a set of tables: staged writes, gates inside the write, one atomic commit.

A build writes every table into a folder of its own and commits it by creating one small file,
``commits/<version>``, which fails if another build has created it. Nothing that a reader
sees changes before that file exists, so a build that fails midway, or whose gate refuses,
leaves the last version as it was. A reader opens one version and keeps its paths, whatever is
committed meanwhile. Row, null and distinct counts are observed while a table is written, so
the gates need no second scan.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from cohortlake.operators import profile as P
from cohortlake.sources import tables as S

Builders = Mapping[str, Mapping[str, Callable[[dict[str, DataFrame]], DataFrame]]]


class GateRefused(ValueError):
    """A build whose tables have errors; ``findings`` holds them."""

    def __init__(self, findings: DataFrame):
        super().__init__(f"refused: {P.quality_totals(findings).first()['total_errors']} errors")
        self.findings = findings


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _names(spark: SparkSession, folder: str) -> dict[str, int]:
    """Names in a folder with the time of their last change in milliseconds."""
    fs, target = _fs(spark, folder)
    if not fs.exists(target):
        return {}
    return {s.getPath().getName(): s.getModificationTime() for s in fs.listStatus(target)}


def versions(spark: SparkSession, root: str) -> list[int]:
    """Committed versions, ascending."""
    return sorted(int(n) for n in _names(spark, f"{root}/commits") if n.isdigit())


def _commit(spark: SparkSession, root: str, body: dict) -> int:
    """Create the next commit file; of two builds at once, one takes the number after.

    This needs a rename that does not replace, as that of HDFS; where a store lacks it, let one
    build run at a time.
    """
    while True:
        version = max(versions(spark, root), default=0) + 1
        staged, staged_path = _fs(spark, f"{root}/staging/{uuid.uuid4().hex}")
        out = staged.create(staged_path, True)
        out.write(bytearray(json.dumps(body).encode()))
        out.close()
        fs, target = _fs(spark, f"{root}/commits/{version}")
        fs.mkdirs(target.getParent())
        # the file is whole before it has its name, and a rename does not replace another file
        if not fs.exists(target) and fs.rename(staged_path, target):
            return version


@dataclass(frozen=True)
class Snapshot:
    """One version: its tables are read from the paths that its commit names."""

    spark: SparkSession
    version: int
    run: str
    entries: tuple[dict, ...] = field(repr=False)

    def table(self, layer: str, name: str) -> DataFrame:
        entry = next(e for e in self.entries if (e["layer"], e["table_name"]) == (layer, name))
        schema = T.StructType.fromJson(json.loads(entry["schema_json"]))
        return self.spark.read.schema(schema).parquet(entry["path"])

    def manifest(self) -> DataFrame:
        """Version, run, layer, table, rows, schema and path."""
        rows = [(self.version, self.run, e["layer"], e["table_name"], e["row_count"], e["schema_json"], e["path"])
                for e in self.entries]
        return self.spark.createDataFrame(
            rows, "version int, run_id string, layer string, table_name string, row_count long, schema_json string, path string")

    def metrics(self) -> DataFrame:
        """Counts observed while the tables were written, one row per column."""
        rows = [(e["layer"], e["table_name"], e["row_count"], *m) for e in self.entries for m in e["metrics"]]
        return self.spark.createDataFrame(
            rows, "layer string, table_name string, row_count long, field string, kind string, count long, distinct long")


def open_version(spark: SparkSession, root: str, version: int | None = None) -> Snapshot | None:
    """A committed version, the newest by default; none if there is none."""
    known = versions(spark, root)
    if version is None:
        if not known:
            return None
        version = known[-1]
    elif version not in known:
        raise ValueError(f"version {version} is not committed")
    fs, target = _fs(spark, f"{root}/commits/{version}")
    stream = spark.sparkContext._jvm.java.util.Scanner(fs.open(target), "UTF-8").useDelimiter("\\A")
    body = json.loads(stream.next())
    stream.close()
    return Snapshot(spark, version, body["run"], tuple(body["tables"]))


def _observed(df: DataFrame) -> tuple[DataFrame, Callable[[], tuple[int, list]]]:
    """The rows, and how many there are, are not null and are different, once they are written.

    Different values are counted by a sketch (5 % standard error), as an observation keeps no sets.
    """
    watch = Observation()
    kinds = [(f.name, P.field_kind(f.dataType)) for f in df.schema.fields]
    counted = [(n, k) for n, k in kinds if k]
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, (n, _) in enumerate(counted):
        aggs += [F.count(F.col(f"`{n}`")).alias(f"c{i}"), F.approx_count_distinct(F.col(f"`{n}`")).alias(f"d{i}")]

    def found() -> tuple[int, list]:
        got = watch.get
        return got["rows"], [(n, k, got[f"c{i}"], got[f"d{i}"]) for i, (n, k) in enumerate(counted)]

    return df.observe(watch, *aggs), found


def build(
    spark: SparkSession, root: str, sources: Mapping[str, DataFrame], builders: Builders,
    partitions: Mapping[str, Sequence[str]] | None = None, gate: Callable[[DataFrame, DataFrame | None], DataFrame] | None = P.quality_findings,
) -> Snapshot:
    """Build every table in order, judge them against the last version, and commit.

    Later builders see the stored earlier tables. ``gate`` gets the observed counts of the new
    and the last version and returns findings; with an error among them nothing is committed
    and ``GateRefused`` is raised. Whatever fails, the folder of the build stays for
    ``collect_garbage``.
    """
    run = uuid.uuid4().hex
    built: dict[str, DataFrame] = dict(sources)
    entries = []
    for layer, tables in builders.items():
        for name, make in tables.items():
            path = f"{root}/data/{run}/{layer}/{name}"
            df, counts = _observed(make(built))
            S.write_table(df, path, by=tuple((partitions or {}).get(name, ())))
            n, metrics = counts()
            built[name] = spark.read.schema(df.schema).parquet(path)
            entries.append({"layer": layer, "table_name": name, "row_count": n, "schema_json": df.schema.json(),
                            "path": path, "metrics": metrics})
    before = open_version(spark, root)
    staged = Snapshot(spark, 0, run, tuple(entries))
    if gate is not None:
        findings = gate(staged.metrics(), before.metrics() if before else None)
        if not P.quality_totals(findings).first()["overall_passed"]:
            raise GateRefused(findings)
    version = _commit(spark, root, {"run": run, "tables": entries})
    return Snapshot(spark, version, run, tuple(entries))


def collect_garbage(spark: SparkSession, root: str, keep: int = 2, hours: float = 24.0) -> list[str]:
    """Delete all but the newest ``keep`` versions, and builds without a commit older than ``hours``.

    Readers pinned to a deleted version lose it, so ``keep`` covers the longest read, and
    ``hours`` the longest build. Returns the runs deleted.
    """
    known = versions(spark, root)
    old = known[:-keep] if keep else known
    held = {open_version(spark, root, v).run for v in known if v not in old}
    for v in old:
        # the commit goes first, so that nobody opens what is being deleted
        fs, target = _fs(spark, f"{root}/commits/{v}")
        gone = open_version(spark, root, v).run
        fs.delete(target, False)
        fs, target = _fs(spark, f"{root}/data/{gone}")
        fs.delete(target, True)
    deleted = []
    limit = (time.time() - hours * 3600) * 1000
    for run, changed in _names(spark, f"{root}/data").items():
        if run not in held and changed <= limit:
            fs, target = _fs(spark, f"{root}/data/{run}")
            fs.delete(target, True)
            deleted.append(run)
    return deleted
