"""Hospital resources: views, capability look-ups, transfer targets, bed allocation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortlake.functions import capacity as P, terms
from cohortlake.functions.scalars import flag_map, lenient_list
from cohortlake.operators.joins import join_small
from cohortlake.operators.runs import sorted_runs


def parsed(resources: DataFrame) -> DataFrame:
    """Resources with ``capabilities`` as a map and ``specialists`` as a list."""
    return resources.withColumn(
        "capabilities", F.coalesce(flag_map(F.col("specialized_capabilities")), P.default_capabilities())
    ).withColumn("specialists", lenient_list(F.col("specialists_on_staff")))


def resource_view(resources: DataFrame) -> DataFrame:
    """Derived resource columns."""
    rate, beds = F.col("icu_occupancy_rate"), F.col("icu_beds_available")
    staff = F.col("specialists")
    return parsed(resources).select(
        "hospital_id",
        "hospital_tier",
        (F.col("ventilators_total") - F.col("ventilators_available")).alias("ventilators_in_use"),
        F.concat((rate * 100).cast("int").cast("string"), F.lit("%")).alias("occupancy_percentage"),
        P.capacity_status(rate, beds).alias("capacity_status"),
        P.overall_status(rate, beds, F.col("capabilities")).alias("overall_status"),
        F.size(staff).alias("n_specialists"),
        F.array_contains(staff, "cardiac_surgeon").alias("has_cardiac_surgeon"),
        F.array_contains(staff, "interventional_cardiologist").alias("has_interventional_cardiologist"),
        F.array_contains(staff, "infectious_disease").alias("has_infectious_disease"),
    )


def capability_report(resources: DataFrame, name: str) -> DataFrame:
    """Availability of one capability at every hospital."""
    status = P.capability_status(F.lit(name), F.col("capabilities"), F.col("specialists"))
    return parsed(resources).select("hospital_id", F.lit(name).alias("capability"), status.alias("s")).select(
        "hospital_id", "capability", "s.*"
    )


def best_targets(requests: DataFrame, resources: DataFrame) -> DataFrame:
    """Best other hospital with the capability, per request.

    Hospitals are reduced to the best two per capability before the join, which is
    enough to leave out the requester; requests meet one row per capability.
    """
    flags = F.coalesce(
        flag_map(F.col("specialized_capabilities")), F.create_map().cast("map<string,boolean>")
    )
    rank = F.struct(
        terms.tier_priority(F.col("hospital_tier")).alias("tier"),
        (-F.col("icu_beds_available")).alias("beds"),
        F.col("hospital_id").alias("hospital_id"),
    )
    having = (
        resources.select(rank.alias("rank"), F.explode(flags).alias("capability", "has"))
        .filter("has")
        .select("capability", "rank")
    )
    first = having.groupBy("capability").agg(F.min("rank").alias("first"))
    second = (
        having.join(first, "capability")
        .filter(F.col("rank") != F.col("first"))
        .groupBy("capability")
        .agg(F.min("rank").alias("second"))
    )
    best = first.join(second, "capability", "left")
    own = F.col("first.hospital_id") == F.col("requesting_hospital")
    return join_small(requests, best, "capability", "left").withColumn(
        "target", F.when(own, F.col("second.hospital_id")).otherwise(F.col("first.hospital_id"))
    ).drop("first", "second")


def transfer_decisions(requests: DataFrame, resources: DataFrame) -> DataFrame:
    """Outcome of each transfer request, with bed and transport time."""
    hospitals = resources.select(
        F.col("hospital_id").alias("target_hospital"),
        F.col("hospital_tier").alias("target_tier"),
        F.col("icu_beds_available").alias("_beds"),
        lenient_list(F.col("specialists_on_staff")).alias("_staff"),
    )
    target, beds = F.col("target_hospital"), F.col("_beds")
    known, free = F.col("target_tier").isNotNull(), F.coalesce(F.col("_beds"), F.lit(0)) > 0
    confirmed = known & free
    return join_small(requests, hospitals, "target_hospital", "left").select(
        "request_id",
        "target_hospital",
        F.when(confirmed, "CONFIRMED").otherwise("FAILED").alias("status"),
        F.when(~known, F.concat(F.lit("Target hospital '"), target, F.lit("' not found in network")))
        .when(~free, F.concat(F.lit("No ICU beds available at "), target))
        .alias("error"),
        F.when(confirmed, F.concat(F.lit("ICU_BED_"), beds.cast("string"))).alias("bed_id"),
        F.when(confirmed, F.size("_staff")).alias("n_specialists"),
        F.when(
            confirmed, terms.transport_minutes(F.col("requesting_hospital"), target)
        ).alias("transport_minutes"),
    )


def allocate_beds(requests: DataFrame, resources: DataFrame) -> DataFrame:
    """Beds of each hospital to its highest-risk requests.

    The order inside a hospital comes from balanced runs, so one hospital with most of
    the requests is still spread over tasks.
    """
    order = ["target_hospital", F.col("risk_score").desc(), "request_id"]
    placed = sorted_runs(requests.select("request_id", "target_hospital", "risk_score"), order).row_number(
        ["target_hospital"], "position"
    )
    beds = resources.select(
        F.col("hospital_id").alias("target_hospital"),
        "icu_beds_available",
        "icu_beds_occupied",
    )
    given = F.col("position") <= F.coalesce(F.col("icu_beds_available"), F.lit(0))
    return join_small(placed, beds, "target_hospital", "left").select(
        "request_id",
        "target_hospital",
        "position",
        given.alias("bed_allocated"),
        F.when(given, F.col("icu_beds_occupied") + F.col("position")).alias("bed_number"),
        F.when(F.col("risk_score") > 0.7, "HIGH").otherwise("MODERATE").alias("priority"),
    )
