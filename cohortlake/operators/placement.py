"""Placement of requests under capacity: deferred acceptance in the order of risk.

Every hospital prefers requests by risk, every request prefers the hospitals that have its
capability by tier and free beds. As all hospitals share one order, a request that is served
after all of higher risk is never turned out again: each takes the first hospital on its list
with a free bed, and the placement is stable, and the only stable one. Requests are served in
blocks of a bounded size, one block a round; a block needs no more of a list than its first
open hospitals, and leaves the beds that it has taken to the next.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from cohortlake.functions import terms
from cohortlake.functions.scalars import flag_map
from cohortlake.operators.joins import join_small
from cohortlake.operators.runs import sorted_runs
from cohortlake.session import materialise

_OPEN = (1 << 62)
#: requests of one block, over the number of capabilities; each list gives at most twice as many hospitals
BLOCK, LEAST_BLOCK = 400_000, 10_000


def _preferences(resources: DataFrame) -> DataFrame:
    """Hospitals of each capability in order: ``capability``, ``nth``, ``hospital_id``, ``beds``."""
    flags = F.coalesce(flag_map(F.col("specialized_capabilities")), F.create_map().cast("map<string,boolean>"))
    rank = [terms.tier_priority(F.col("hospital_tier")).alias("tier"), (-F.col("icu_beds_available")).alias("less")]
    having = resources.select("hospital_id", F.coalesce("icu_beds_available", F.lit(0)).alias("beds"), *rank,
                              F.explode(flags).alias("capability", "has")).filter("has")
    # as many rows as hospitals in a capability
    order = Window.partitionBy("capability").orderBy(F.col("tier"), F.col("less").asc_nulls_last(), "hospital_id")
    return having.select("capability", "hospital_id", "beds", F.row_number().over(order).alias("nth"))


def _serve(rows: DataFrame) -> DataFrame:
    """Serve the requests of one block in order: ``target`` and ``bed``, and ``first``, where each asked at the start.

    The rows of the one partition are the open hospitals of each list in order, then the requests.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: dict[str, list[str]] = {}
        beds: dict[str, int] = {}
        free: dict[str, int] = {}
        # the first open place of each list and the one after it; full hospitals stay full
        heads: dict[str, int] = {}
        seconds: dict[str, int] = {}

        def open_from(names: list[str], at: int) -> int:
            while at < len(names) and not free[names[at]]:
                at += 1
            return at

        for batch in batches:
            asked = batch.column("asked").to_pylist()
            options = len(asked) - sum(asked)
            held = batch.slice(0, options).to_pydict()
            for capability, name, has, left in zip(held["capability"], held["hospital"], held["beds"], held["free"]):
                lists.setdefault(capability, []).append(name)
                beds[name], free[name] = has, left
            part = batch.slice(options)
            first: list[str | None] = []
            target: list[str | None] = []
            bed: list[int | None] = []
            for capability, own in zip(part.column("capability").to_pylist(), part.column("hospital").to_pylist()):
                names = lists.get(capability, [])
                start = 1 if names and names[0] == own else 0
                first.append(names[start] if start < len(names) else None)
                at = heads[capability] = open_from(names, heads.get(capability, 0))
                if at < len(names) and names[at] == own:
                    at = seconds[capability] = open_from(names, max(seconds.get(capability, 0), at + 1))
                name = names[at] if at < len(names) else None
                target.append(name)
                bed.append(None if name is None else beds[name] - free[name] + 1)
                if name is not None:
                    free[name] -= 1
            if len(part):
                text = batch.schema.field("hospital").type
                yield pa.RecordBatch.from_arrays(
                    [part.column("request_id"), pa.array(target, text), pa.array(bed, pa.int64()), pa.array(first, text)],
                    ["request_id", "target", "bed", "first"])

    id_type, hospital = rows.schema["request_id"].dataType.simpleString(), rows.schema["hospital"].dataType.simpleString()
    return rows.mapInArrow(run, f"request_id {id_type}, target {hospital}, bed bigint, first {hospital}")


def place_requests(requests: DataFrame, resources: DataFrame, most_rounds: int = 10_000) -> tuple[DataFrame, list[dict]]:
    """Each request with its ``target`` (null if none is left) and ``bed`` from 1, and a log of the rounds.

    ``requests`` has unique ``request_id``, ``capability``, ``requesting_hospital`` (never a
    target) and ``risk_score``; higher risk comes first, null last, ties by id. A round serves
    one block. The log has a row for each that rejects proposals to the first hospital open at
    its start: hospitals with too many proposals, and proposals rejected; and one for the end,
    counted anew over all that was placed. What reaches the driver is two numbers a round.
    """
    listed = materialise(_preferences(resources).filter("hospital_id is not null"))
    # a hospital on several rows has the least of their beds, and stands where its first row does
    beds = listed.filter("beds > 0").groupBy("hospital_id").agg(F.min("beds").cast("bigint").alias("beds"))
    lists = materialise(listed.groupBy("capability", "hospital_id").agg(F.min("nth").alias("nth")).join(beds, "hospital_id").select(
        "capability", "nth", "hospital_id", "beds", F.col("beds").alias("free")))
    size = max(LEAST_BLOCK, BLOCK // max(1, lists.select("capability").distinct().count()))
    wanted = requests.select("request_id", "capability", "requesting_hospital", "risk_score")
    runs = sorted_runs(wanted.join(lists.select("capability").distinct(), "capability", "left_semi"),
                       [F.col("risk_score").desc_nulls_last(), F.col("request_id")])
    asked, total = runs.numbered("place").drop("risk_score"), max(runs.ends) + 1
    log: list[dict] = []
    served: list[DataFrame] = []
    before = Window.partitionBy("capability").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    for start in range(0, total, size):
        if len(served) == most_rounds:
            raise RuntimeError(f"placement is not stable after {most_rounds} rounds")
        # of a list no more than a block can use, wherever its requests come from
        ahead = F.coalesce(F.sum(F.least("free", F.lit(size))).over(before), F.lit(0))
        options = lists.withColumn("ahead", ahead).filter(F.col("ahead") < 2 * size)
        block = asked.filter(F.col("place").between(start + 1, start + size)).join(
            lists.select("capability").distinct(), "capability", "left_semi")
        rows = options.select(F.lit(0).alias("asked"), "capability", F.col("nth").cast("bigint").alias("at"),
                              F.col("hospital_id").alias("hospital"), "beds", "free").unionByName(
            block.select(F.lit(1).alias("asked"), "capability", F.col("place").alias("at"),
                         F.col("requesting_hospital").alias("hospital"), "request_id"), allowMissingColumns=True)
        done = materialise(_serve(rows.repartition(1).sortWithinPartitions("asked", "at")))
        served.append(done)
        moved = done.filter("first is not null and not (first <=> target)")
        found = moved.agg(F.count_distinct("first").alias("hospitals"), F.count(F.lit(1)).alias("rejected")).first()
        if found["rejected"]:
            log.append({"round": len(served), **found.asDict()})
        taken = done.filter("target is not null").groupBy(F.col("target").alias("hospital_id")).agg(
            F.count(F.lit(1)).alias("taken"))
        lists = materialise(lists.join(taken, "hospital_id", "left").withColumn(
            "free", F.col("free") - F.coalesce("taken", F.lit(0))).filter("free > 0").drop("taken").select(*lists.columns))
        if lists.isEmpty():
            break
    placed = reduce(DataFrame.unionAll, served) if served else wanted.limit(0).select(
        "request_id", F.col("requesting_hospital").alias("target"), F.lit(0).cast("bigint").alias("bed"))
    held = placed.filter("target is not null").select("request_id", "target", "bed")
    over = held.groupBy(F.col("target").alias("hospital_id")).agg(F.count(F.lit(1)).alias("n")).join(
        beds, "hospital_id", "left").filter("beds is null or n > beds")
    end = over.agg(F.count(F.lit(1)).alias("hospitals"), F.sum(F.col("n") - F.coalesce("beds", F.lit(0))).alias("rejected")).first()
    log.append({"round": len(served) + 1, "hospitals": end["hospitals"], "rejected": end["rejected"] or 0})
    return wanted.drop("risk_score").join(held, "request_id", "left"), log


def unstable_pairs(placements: DataFrame, requests: DataFrame, resources: DataFrame) -> DataFrame:
    """Requests and hospitals that would rather have each other: empty for a stable placement.

    A hospital would rather have a request if it has a free bed or holds a request of less risk,
    which its last holder tells; a request prefers what stands earlier on its list.
    """
    lists = _preferences(resources)
    order = sorted_runs(requests.select("request_id", F.col("risk_score")), [
        F.col("risk_score").desc_nulls_last(), F.col("request_id")]).numbered("place").select("request_id", "place")
    placed = materialise(placements.join(order, "request_id"))
    held = placed.filter("target is not null").groupBy(F.col("target").alias("hospital_id")).agg(
        F.count(F.lit(1)).alias("n"), F.max("place").alias("worst"))
    wanting = materialise(lists.join(held, "hospital_id", "left").filter("beds > 0").select(
        "capability", "nth", "hospital_id",
        F.when(F.coalesce("n", F.lit(0)) < F.col("beds"), F.lit(_OPEN)).otherwise(F.col("worst")).alias("limit")))
    options = wanting.groupBy("capability").agg(F.array_sort(F.collect_list(
        F.struct("nth", "hospital_id", "limit"))).alias("options"))
    own = lists.select("capability", F.col("hospital_id").alias("target"), F.col("nth").alias("own_nth"))
    met = join_small(join_small(placed, own, ["capability", "target"], "left"), options, "capability")
    better = F.filter("options", lambda o: (o["limit"] > F.col("place")) & (
        F.col("own_nth").isNull() | (o["nth"] < F.col("own_nth"))) & ~o["hospital_id"].eqNullSafe(F.col("requesting_hospital")))
    return met.select("request_id", F.explode(better).alias("o")).select("request_id", F.col("o.hospital_id").alias("hospital_id"))
