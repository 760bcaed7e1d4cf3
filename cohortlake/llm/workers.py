"""Settings that Python workers need for whole documents, and a map that keeps columns as they are."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: rows and bytes of one Arrow batch; the default of 10,000 whole documents fills a small
#: executor, and a few very long texts weigh as much as many usual ones
ROWS_PER_BATCH, BYTES_PER_BATCH = 1_000, "8m"


def prepare(spark: SparkSession, rows: int = ROWS_PER_BATCH, size: str = BYTES_PER_BATCH) -> None:
    """Smaller Arrow batches, and this package on the workers' path if it was not shipped."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))


# fixed values: the types that operators add, in Arrow
_ARROW = {"string": pa.string(), "double": pa.float64(), "long": pa.int64(), "binary": pa.binary()}


def map_texts(docs: DataFrame, keep: tuple[str, ...], added: dict[str, str],
              make: Callable[[list[str | None]], list[list]], rows: int = 512) -> DataFrame:
    """``keep`` columns beside columns that ``make`` derives from the texts of a few rows.

    Kept columns pass as Arrow data, so nulls and large numbers stay what they are.
    """
    source = docs.select(*[F.col(f"`{c}`").alias(c) for c in keep], F.col("text").alias("__text"))
    schema = T.StructType([source.schema[c] for c in keep])
    for name, kind in added.items():
        schema = schema.add(name, kind)
    names = [*keep, *added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                made = make(part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(len(keep))]
                    + [pa.array(v, type=_ARROW[k]) for v, k in zip(made, added.values())], names)

    return source.mapInArrow(run, schema)
