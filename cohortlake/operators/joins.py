"""Joins whose strategy depends on a measured size."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

SMALL_ROWS = 100_000


def join_small(
    large: DataFrame, small: DataFrame, on: str | Sequence[str] | Column, how: str = "inner",
    limit: int = SMALL_ROWS,
) -> DataFrame:
    """Join with a side that is expected to be small, after counting it.

    Within ``limit`` rows it is broadcast, so a large side with few distinct keys is not
    shuffled onto a few tasks. Beyond the limit the join is left to the adaptive planner,
    which splits skewed partitions.
    """
    fits = small.limit(limit + 1).count() <= limit
    return large.join(F.broadcast(small) if fits else small, on, how)


def null_safe(left: str, right: str, keys: Sequence[str]) -> Column:
    """Equality of the keys of two aliased frames, NULL matching NULL."""
    tests = [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys]
    return reduce(lambda a, b: a & b, tests, F.lit(True))
