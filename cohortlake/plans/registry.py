"""Registration of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from cohortlake.sources.bindings import Tables


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Tables(spark, folder))


CATALOGUE: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a function of ``Tables`` under a name, with the SQL that must agree with it."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in CATALOGUE:
            raise ValueError(f"query {name} is registered twice")
        CATALOGUE[name] = Query(name, build, sql)
        return build

    return register
