"""Ordered computations that never put one group into one task.

A window keyed by a column sends a whole key to one task; an unkeyed window sends
everything to one task. Here rows are range-partitioned on the complete order instead,
so a hot key is cut into several runs, and what has to pass from run to run (one row
per run) is stitched on afterwards. The sorted rows are written to the shared folder with
their run numbers: these stay the same when an executor is lost, and every use of the
rows sees the same cut.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlake.operators.joins import join_small, null_safe
from cohortlake.session import materialise

RUN, POS, ROW = "_run", "_pos", "_row"
_ROW_BITS = 33  # monotonically_increasing_id keeps the partition above these bits


def _col(c: str | Column) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def _same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


@dataclass(frozen=True)
class SortedRuns:
    """Rows with ``_run``, ``_row`` (in run) and ``_pos`` (global, from 0)."""

    rows: DataFrame
    present: tuple[int, ...]  # runs that hold rows
    ends: tuple[int, ...]  # position of the last row of each run, of an empty one the row before it

    def numbered(self, name: str) -> DataFrame:
        """Global row number from 1."""
        return self.rows.withColumn(name, F.col(POS) + 1).drop(RUN, POS, ROW)

    def running(self, keys: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
        """Running sums inside each key, current row included.

        ``keys`` must be a prefix of the order the rows were sorted by.
        """
        rows = self.rows
        for name, value in sums.items():
            rows = rows.withColumn(f"_in_{name}", value)
        groups = rows.groupBy(RUN, *keys).agg(
            F.min(POS).alias("_start"),
            *[F.sum(f"_in_{name}").alias(f"_sum_{name}") for name in sums],
        )
        key = F.struct(*keys) if keys else F.lit(0)
        totals = F.struct(*[F.col(f"_sum_{name}").alias(name) for name in sums])
        # one row per run reaches the driver
        edges = (
            groups.groupBy(RUN)
            .agg(
                F.min_by(key, F.col("_start")).alias("first"),
                F.max_by(key, F.col("_start")).alias("last"),
                F.max_by(totals, F.col("_start")).alias("tail"),
                F.count(F.lit(1)).alias("n_groups"),
            )
            .orderBy(RUN)
            .collect()
        )
        carries: dict[int, tuple] = {}
        held_key, held = object(), tuple(0 for _ in sums)
        for edge in edges:
            carry = held if edge["first"] == held_key else tuple(0 for _ in sums)
            carries[edge[RUN]] = carry
            tail = tuple(edge["tail"])
            if edge["n_groups"] == 1:
                tail = tuple(a + b for a, b in zip(carry, tail))
            held_key, held = edge["last"], tail
        size = max(carries, default=0) + 1
        local = (
            Window.partitionBy(RUN, *keys)
            .orderBy(POS)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        rows = rows.withColumn("_nth", F.count(F.lit(1)).over(local))
        for i, name in enumerate(sums):
            offsets = F.lit([carries.get(r, (0,) * len(sums))[i] for r in range(size)])
            first_group = F.col("_nth") == F.col(ROW) + 1
            offset = F.when(first_group, F.element_at(offsets, F.col(RUN).cast("int") + 1)).otherwise(
                F.lit(0)
            )
            rows = rows.withColumn(name, F.sum(f"_in_{name}").over(local) + offset)
        return rows.drop("_nth", RUN, POS, ROW, *[f"_in_{name}" for name in sums])

    def row_number(self, keys: Sequence[str], name: str = "rn") -> DataFrame:
        """Row number inside each key, from 1."""
        return self.running(keys, {name: F.lit(1).cast("bigint")})

    def shifted(self, keys: Sequence[str], columns: Mapping[str, str], step: int) -> DataFrame:
        """Values of the row ``step`` (1 back, -1 ahead) from this one inside each key.

        ``keys`` must be a prefix of the order the rows were sorted by. Inside a run the
        window is keyed by run and keys, so the runs spread over the tasks.
        """
        if step not in (1, -1):
            raise ValueError("step is 1 (previous row) or -1 (next row)")
        taken = F.struct(
            *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)],
            *[F.col(source).alias(name) for name, source in columns.items()],
        )
        rows = self.rows.withColumn("_taken", taken)
        # the last (first) row of a run goes to the run after (before) it: one row per run
        receiver = [None] * (max(self.present, default=0) + 1)
        for before, after in zip(self.present, self.present[1:]):
            giver, taker = (before, after) if step == 1 else (after, before)
            receiver[giver] = taker
        to_run = F.element_at(F.lit(receiver).cast("array<bigint>"), F.col(RUN).cast("int") + 1)
        # the positions of the edges are known, so they are filtered, not aggregated
        end = F.element_at(F.lit(list(self.ends) or [-1]).cast("array<bigint>"), F.col(RUN).cast("int") + 1)
        at_edge = F.col(POS) == end if step == 1 else F.col(ROW) == 0
        edges = rows.filter(at_edge).select(to_run.alias(RUN), F.col("_taken").alias("_edge")).filter(F.col(RUN).isNotNull())
        in_run = Window.partitionBy(RUN, *keys).orderBy(POS)
        rows = rows.withColumn("_near", F.lag("_taken", step).over(in_run))
        rows = rows.join(F.broadcast(edges), RUN, "left")
        near = F.coalesce("_near", "_edge")
        match = F.lit(True)
        for i, k in enumerate(keys):
            match = match & _same(near[f"k{i}"], F.col(k))
        for name in columns:
            rows = rows.withColumn(name, F.when(near.isNotNull() & match, near[name]))
        return rows.drop("_taken", "_near", "_edge", RUN, POS, ROW)


def sorted_runs(df: DataFrame, order: Sequence[str | Column], partitions: int | None = None) -> SortedRuns:
    """Sort rows globally into balanced runs; give a complete order, ties included."""
    columns = [_col(c) for c in order]
    if partitions:
        ranged = df.repartitionByRange(partitions, *columns)
    else:
        ranged = df.repartitionByRange(*columns)  # adjacent small ranges may be merged
    placed = ranged.sortWithinPartitions(*columns).withColumn("_id", F.monotonically_increasing_id())
    stored = materialise(placed)
    marked = stored.withColumn(RUN, F.shiftright("_id", _ROW_BITS)).withColumn(
        ROW, F.col("_id").bitwiseAND((1 << _ROW_BITS) - 1)
    )
    sizes = {r[RUN]: r["count"] for r in marked.groupBy(RUN).count().collect()}
    starts, total = [], 0
    for run in range(max(sizes, default=0) + 1):
        starts.append(total)
        total += sizes.get(run, 0)
    offset = F.element_at(F.lit(starts), F.col(RUN).cast("int") + 1).cast("bigint")
    ends = tuple(start + sizes.get(run, 0) - 1 for run, start in enumerate(starts))
    return SortedRuns(marked.withColumn(POS, offset + F.col(ROW)).drop("_id"), tuple(sorted(sizes)), ends)


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: Mapping[str, float]
) -> DataFrame:
    """Exact linearly interpolated quantiles per key.

    Equal values are counted before the sort, so a repeated value costs one row, and no
    group is gathered in memory. Keys whose values are all NULL are left out.
    """
    keys = list(keys)
    counted = (
        df.select(*keys, F.col(value).cast("double").alias("_v"))
        .filter(F.col("_v").isNotNull())
        .groupBy(*keys, "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    runs = sorted_runs(counted, [*keys, "_v"])
    placed = runs.running(keys, {"_cum": F.col("_n")})
    totals = runs.rows.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    if keys:
        placed = join_small(placed.alias("p"), totals.alias("t"), null_safe("p", "t", keys)).select(
            "p.*", "t._total"
        )
    else:
        total = totals.first()["_total"] or 0  # one number
        placed = placed.withColumn("_total", F.lit(total).cast("bigint"))
    aggs = []
    for name, p in probabilities.items():
        at = F.lit(float(p)) * (F.col("_total") - 1)
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            holds = (F.col("_cum") - F.col("_n") <= rank) & (rank < F.col("_cum"))
            aggs.append(F.max(F.when(holds, F.col("_v"))).alias(f"_{side}_{name}"))
        aggs.append(F.max(at - F.floor(at)).alias(f"_w_{name}"))
    found = placed.groupBy(*keys).agg(*aggs)
    return found.select(
        *keys,
        *[
            (
                F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_w_{n}")
            ).alias(n)
            for n in probabilities
        ],
    )
