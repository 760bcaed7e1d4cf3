"""Equalized odds by the convex hulls of the groups' ROC curves, with randomised thresholds.

Mixing two thresholds reaches every point on the segment between their ROC points, so a group
reaches the upper hull of its curve; giving a constant share of rows a positive decision
whatever their score reaches everything below. The groups meet at a point under all hulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlake.functions.scalars import hash_unit, known
from cohortlake.operators import evaluate as E
from cohortlake.operators.joins import join_small
from cohortlake.operators.runs import sorted_runs
from cohortlake.session import materialise

#: false positive rates tried, evenly spaced; points of a curve whose hull is taken at once
GRID, CHUNK = 1000, 512
_POINT = "array<struct<fp:bigint,tp:bigint,threshold:double>>"


def _upper(points: Column) -> Column:
    """The upper hull of points that ascend by ``fp``.

    A point joins the hull at the vertex from which the slope to it is least; the vertices
    between, and those on the line, leave it.
    """
    def join(hull: Column, p: Column) -> Column:
        slopes = F.transform(hull, lambda v, i: F.struct(
            ((p["tp"] - v["tp"]) / (p["fp"] - v["fp"]).cast("double")).alias("slope"), i.alias("i")))
        left = F.slice(hull, F.lit(1), F.array_min(slopes)["i"] + 1)
        return F.when(F.size(hull) == 0, F.array(p)).otherwise(F.concat(left, F.array(p))).cast(_POINT)

    return F.aggregate(points, F.array().cast(_POINT), join)


def roc_hull(points: DataFrame, group: str, chunk: int = CHUNK) -> DataFrame:
    """Vertices of the upper hull of each group's curve: ``group``, ``fp``, ``tp``, ``threshold``, ``p``, ``n``.

    ``points`` come from ``evaluate.curve``. A curve is cut into chunks along its sorted runs and
    each chunk keeps its own hull; the hulls of two chunks are then joined, until one is left, so
    no task holds a whole curve, only vertices. The start, where nothing is selected, has no threshold.
    """
    totals = points.groupBy(group).agg(F.max("p").alias("p"), F.max("n").alias("n"))
    start = totals.select(group, F.lit(0).cast("bigint").alias("fp"), F.lit(0).cast("bigint").alias("tp"),
                          F.lit(None).cast("double").alias("threshold"))
    # of points with equal false positives only the highest can be a vertex
    rows = materialise(points.select(group, "fp", "tp", "threshold").unionByName(start).groupBy(group, "fp").agg(
        F.max("tp").alias("tp"), F.max_by("threshold", "tp").alias("threshold")))
    while True:
        placed = sorted_runs(rows, [group, "fp"]).row_number([group], "_order")
        chunks = placed.groupBy(group, F.floor((F.col("_order") - 1) / chunk).alias("_chunk")).agg(
            F.array_sort(F.collect_list(F.struct("fp", "tp", "threshold"))).alias("points"))
        rows = materialise(chunks.select(group, "_chunk", F.inline(_upper(F.col("points")))))
        several = rows.filter("_chunk > 0").limit(1).count()
        rows = rows.drop("_chunk")
        if not several:
            return join_small(rows, totals, group)
        chunk *= 2


def equalized_odds(df: DataFrame, group: str, grid: int = GRID) -> DataFrame:
    """One row per group: how to decide so that all groups have the same two error rates.

    Columns: the group, ``strict_threshold`` (null selects nothing), ``lenient_threshold``,
    ``lenient_weight`` (share of rows judged by it), ``ignored`` (share of rows decided
    without their score, positive for a share ``fpr`` of them), and the common ``fpr`` and
    ``recall``. Of ``grid`` + 1 false positive rates the one with most right decisions is
    taken, the smallest of ties. A null group is the group ``Unknown``. A group without both
    classes has no curve: such input is refused.
    """
    rows = df.withColumn(group, known(F.col(group)))
    hull = materialise(roc_hull(E.curve(rows, [group]), group))
    sizes = hull.groupBy(group).agg(F.max("p").alias("p"), F.max("n").alias("n"))
    # three numbers
    total = sizes.agg(F.count(F.lit(1)).alias("groups"), F.count_if((F.col("p") == 0) | (F.col("n") == 0)).alias("bad"),
                      F.sum("p").alias("p"), F.sum("n").alias("n")).first()
    if total["bad"]:
        raise ValueError(f"{total['bad']} groups lack one of the classes")
    fpr, tpr = F.col("fp") / F.col("n").cast("double"), F.col("tp") / F.col("p").cast("double")
    # a hull has few vertices
    along = Window.partitionBy(group).orderBy("fp")
    ends = hull.select(group, fpr.alias("x1"), tpr.alias("y1"), F.col("threshold").alias("t1"),
                       F.lag(fpr).over(along).alias("x0"), F.lag(tpr).over(along).alias("y0"),
                       F.lag("threshold").over(along).alias("t0"),
                       F.expr(f"(fp * {grid}) div n").alias("to"),
                       F.coalesce(F.lag(F.expr(f"(fp * {grid}) div n")).over(along), F.lit(-1)).alias("after"))
    cells = ends.filter("to > after").withColumn("i", F.explode(F.sequence(F.col("after") + 1, F.col("to"))))
    x = F.col("i") / F.lit(float(grid))
    weight = F.when(F.col("x0").isNull(), F.lit(1.0)).otherwise((x - F.col("x0")) / (F.col("x1") - F.col("x0")))
    reach = cells.withColumn("w", weight).withColumn(
        "y", F.when(F.col("x0").isNull(), F.col("y1")).otherwise(F.col("y0") + F.col("w") * (F.col("y1") - F.col("y0"))))
    reach = materialise(reach.select(group, "i", x.alias("x"), "y", "w", "t0", "t1"))
    common = reach.groupBy("i", "x").agg(F.min("y").alias("recall"), F.count(F.lit(1)).alias("k")).filter(
        F.col("k") == total["groups"])
    right = F.lit(float(total["p"] or 0)) * F.col("recall") + F.lit(float(total["n"] or 0)) * (1 - F.col("x"))
    best = common.agg(F.min_by(F.struct("i", "recall"), F.struct((-right).alias("r"), F.col("i"))).alias("b"))
    # one row
    met = reach.join(F.broadcast(best.select("b.i", "b.recall")), "i")
    below = F.col("y") - F.col("x")
    return met.select(
        group, F.col("t0").alias("strict_threshold"), F.col("t1").alias("lenient_threshold"),
        F.col("w").alias("lenient_weight"),
        F.when(below > 0, (F.col("y") - F.col("recall")) / below).otherwise(F.lit(0.0)).alias("ignored"),
        F.col("x").alias("fpr"), "recall")


def randomised_decisions(df: DataFrame, rule: DataFrame, group: str, key: str, salt: str = "odds") -> DataFrame:
    """Rows with a 0/1 ``predicted`` by a rule of ``equalized_odds``; chance is a hash of the row's key.

    Rows without a score get no decision, nor do groups that the rule does not know.
    """
    named = df.withColumn("_group", known(F.col(group)))
    joined = join_small(named, rule.withColumnRenamed(group, "_group"), "_group", "left")
    blind = hash_unit(F.col(key), f"{salt}a") < F.col("ignored")
    lenient = hash_unit(F.col(key), f"{salt}b") < F.col("lenient_weight")
    threshold = F.when(lenient, F.col("lenient_threshold")).otherwise(F.col("strict_threshold"))
    chosen = F.when(blind, hash_unit(F.col(key), f"{salt}c") < F.col("fpr")).otherwise(
        F.coalesce(F.col("score") >= threshold, F.lit(False)))
    known_row = F.col("score").isNotNull() & F.col("fpr").isNotNull()
    return joined.withColumn("predicted", F.when(known_row, chosen.cast("int"))).select(*df.columns, "predicted")
