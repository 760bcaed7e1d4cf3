"""Role tables (patients, admissions, movements, ...) derived from the star-schema tables.

The clinical roles are pure projections of the given tables, plus the one join that
gives a movement its admission time, so every query grows with its inputs.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortlake.functions import vocabulary as V
from cohortlake.operators import curated

# fixed values: units and codes that movements cycle through
CAREUNITS = [
    *V.ICU_CAREUNITS,
    "Intensive Care Unit (ICU)",
    *V.EMERGENCY_CAREUNITS,
    "Neuro Intermediate",
    "Surgery Stepdown",
    "PACU",
    "Observation",
    "Unknown",
    "Medicine",
]
EVENT_TYPES = ["ED", "admit", "transfer", "discharge"]
ROUTES = ["IV", "PO", "SC", "IM", "NG"]
DRUG_TYPES = ["MAIN", "BASE", "ADDITIVE"]
TIERS = ["Tertiary Care Center", "Community Hospital", "Rural Hospital", "Clinic"]
ETHNICITIES = ["WHITE", "BLACK", "ASIAN", "HISPANIC", "OTHER"]
ACTIONS = ["prediction", "external_query", "patient_transfer", "transfer_receipt", "privacy_operation"]
FREE_TERMS = [
    "emergency", "URGENT", "Planned ", "ew emer.", "obs", "day surgery case", "cardiac", "Heart",
    "neurosurgical", "mixed icu", "walk in", "nursing home", "unknown thing", "TSICU", "x-ray",
]


def pick(values: list[str], index: Column) -> Column:
    """The value at a non-negative index modulo the list length."""
    items = F.array(*[F.lit(v) for v in values])
    return F.element_at(items, (index % len(values)).cast("int") + 1)


def minutes(n: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), n.cast("int"))


def _site(key: Column, even: int) -> Column:
    return pick(V.SITES, key + even)


def shape_predictions(orders: DataFrame) -> DataFrame:
    """One scored admission per order, with site, split and sensitive columns."""
    key, who = F.col("o_orderkey"), F.col("o_custkey")
    died = (F.col("o_orderstatus") == "F").cast("int")
    noise = (key * 31 + who * 17) % 1000
    scored = orders.select(
        key.alias("row_id"),
        who.alias("subject_id"),
        F.col("o_orderdate").alias("scored_at"),
        died.alias("y_true"),
        ((noise * 6 + died * 3000 + 500) / F.lit(10000.0)).alias("score"),
        F.when(who % 3 == 0, "F").otherwise("M").alias("gender"),
        (F.lit(18) + (who * 7) % 74).cast("int").alias("age"),
        pick(V.INSURANCES, who + key % 2).alias("insurance"),
        F.when(who % 11 != 0, pick(ETHNICITIES, who * 3)).alias("race"),
    )
    return curated.assign_site_and_split(scored).withColumnRenamed("assigned_hospital", "site")


def shape_access_events(events: DataFrame) -> DataFrame:
    """Log-worthy actions, one per event; works on batch and streaming frames."""
    key, who = F.col("event_id"), F.col("user_id")
    return events.select(
        F.format_string("evt_%d", key).alias("event_id"),
        F.col("ts").cast("timestamp").alias("event_timestamp"),
        F.concat(F.lit("user_"), who.cast("string")).alias("user_id"),
        F.when(who % 5 != 0, pick(["clinician", "nurse"], who)).alias("user_role"),
        pick(ACTIONS, key).alias("kind"),
        _site(who, 0).alias("hospital_id"),
        _site(who, 1).alias("target_hospital"),
        (F.lit(18) + (who * 7) % 74).cast("int").alias("age"),
        ((key * 7 % 101) / F.lit(100.0)).alias("risk_score"),
        F.when(key % 4 != 0, F.col("event_type")).alias("query_type"),
        F.col("event_type").alias("reason"),
        pick(V.ADMISSION_TYPES, key).alias("admission_type"),
        F.when(key % 3 != 0, pick(V.ICU_TYPES, key)).alias("icu_type"),
        (key % 4).cast("int").alias("early_icu_score"),
    )


def shape_transfer_updates(events: DataFrame) -> DataFrame:
    """Status records of transfers: the event type is the status, the user the transfer."""
    return events.select(
        F.format_string("xfer_%d", F.col("user_id")).alias("transfer_id"),
        F.col("ts").cast("timestamp").alias("updated_at"),
        F.col("event_type").alias("status"),
        F.col("event_id").alias("sequence"),
    )


class Tables:
    """Lazy access to the given tables and the role tables derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # ---- clinical roles ---------------------------------------------------

    @cached_property
    def patients(self) -> DataFrame:
        key = F.col("c_custkey")
        died = F.date_add(F.to_date(F.lit("2002-01-01")), (key % 365).cast("int"))
        year = (F.lit(1996) + F.col("c_nationkey") % 5).cast("int")
        return self.raw("customer").select(
            key.alias("subject_id"),
            F.when(key % 3 == 0, "F").otherwise("M").alias("gender"),
            (F.lit(18) + (key * 7) % 74).cast("int").alias("anchor_age"),
            year.alias("anchor_year"),
            F.concat(year.cast("string"), F.lit(" - "), (year + 2).cast("string")).alias("anchor_year_group"),
            F.when(F.col("c_acctbal") < 500, died).alias("dod"),
        )

    @cached_property
    def admissions(self) -> DataFrame:
        key, who = F.col("o_orderkey"), F.col("o_custkey")
        start = F.col("o_orderdate") + minutes((key * 37) % 1440)
        end = start + minutes(F.lit(360) + (key * 131) % 24000)
        died = F.col("o_orderstatus") == "F"
        urgent = F.col("o_orderpriority") == "1-URGENT"
        return self.raw("orders").select(
            key.alias("hadm_id"),
            who.alias("subject_id"),
            start.alias("admittime"),
            end.alias("dischtime"),
            F.when(died, end).alias("deathtime"),
            F.when(urgent, start - minutes(F.lit(30) + key % 300)).alias("edregtime"),
            F.when(urgent, start).alias("edouttime"),
            pick(V.ADMISSION_TYPES, key * 5 + who).alias("admission_type"),
            pick(V.ADMISSION_LOCATIONS, key * 3).alias("admission_location"),
            F.when(~died, pick(["HOME", "REHAB", "HOSPICE"], key)).alias("discharge_location"),
            pick(V.INSURANCES, who + key % 2).alias("insurance"),
            F.when(who % 4 == 0, "OTHER").otherwise("ENGLISH").alias("language"),
            F.when(key % 9 != 0, pick(V.MARITAL_STATUSES, who)).alias("marital_status"),
            pick(ETHNICITIES, who * 3).alias("ethnicity"),
            died.cast("int").alias("hospital_expire_flag"),
        )

    @cached_property
    def transfers(self) -> DataFrame:
        line = self.raw("lineitem").select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag"
        )
        adm = self.raw("orders").select(
            "o_orderkey", "o_custkey", "o_orderdate"
        )
        key, part, supp = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
        number = F.col("l_linenumber")
        base = F.col("o_orderdate") + minutes((key * 37) % 1440)
        start = base + minutes((number - 1) * 420 + (part * 11) % 2880)
        unit = (part + number) % 17
        return line.join(adm, key == F.col("o_orderkey")).select(
            (key * 1000000 + (part * 7 + supp * 3 + number) % 1000000).alias("transfer_id"),
            F.col("o_custkey").alias("subject_id"),
            F.when(~((number == 7) & (part % 10 == 0)), key).alias("hadm_id"),
            pick(EVENT_TYPES, number + supp).alias("eventtype"),
            F.when(unit != 16, pick(CAREUNITS, unit)).alias("careunit"),
            start.alias("intime"),
            F.when(
                (part + supp) % 23 != 0,
                start + minutes(F.lit(61) * F.col("l_quantity").cast("int")),
            ).alias("outtime"),
        )

    @cached_property
    def prescriptions(self) -> DataFrame:
        line = self.raw("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")
        part = self.raw("part").select("p_partkey", "p_name", "p_size")
        number = F.col("l_linenumber")
        return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
            F.col("l_orderkey").alias("hadm_id"),
            F.col("p_name").alias("drug"),
            pick(DRUG_TYPES, F.col("p_size").cast("bigint")).alias("drug_type"),
            F.when(
                ~((F.col("l_returnflag") == "N") & (number == 1)),
                pick(ROUTES, F.col("l_orderkey") + number),
            ).alias("route"),
        )

    @cached_property
    def resources(self) -> DataFrame:
        """One hospital per supplier, with capabilities in three encodings."""
        key = F.col("s_suppkey")
        beds = F.greatest(F.lit(0), F.floor(F.col("s_acctbal") / 1000)).cast("int")
        total = (F.lit(10) + key % 7).cast("int")
        free = F.least(total, beds)
        flag = lambda test: F.when(test, "true").otherwise("false")
        flat = F.concat(
            F.lit('{"ecmo": '), flag(key % 2 == 0),
            F.lit(', "cardiac_surgery": '), flag(key % 3 == 0),
            F.lit(', "advanced_cardiac_care": '), flag(key % 5 == 0),
            F.lit(', "dialysis": '), flag(key % 4 != 0), F.lit("}"),
        )
        nested = F.concat(F.lit('{"specialized_capabilities": '), flat, F.lit("}"))
        return self.raw("supplier").select(
            F.concat(F.lit("hospital_"), key.cast("string")).alias("hospital_id"),
            total.alias("icu_beds_total"),
            free.alias("icu_beds_available"),
            (total - free).alias("icu_beds_occupied"),
            ((total - free) / total.cast("double")).alias("icu_occupancy_rate"),
            (total * 2).alias("ventilators_total"),
            (free * 2).alias("ventilators_available"),
            (key % 2 == 0).alias("ecmo_available"),
            (key % 3 == 0).alias("cardiac_surgery_available"),
            (key % 5 == 0).alias("advanced_cardiac_care_available"),
            (F.lit(20) + key % 50).cast("int").alias("total_providers"),
            F.when(key % 6 == 0, "not a list")
            .when(key % 2 == 0, "['cardiac_surgeon', 'infectious_disease']")
            .otherwise('["interventional_cardiologist"]')
            .alias("specialists_on_staff"),
            F.when(key % 7 == 0, F.lit(None).cast("string"))
            .when(key % 3 == 1, nested)
            .otherwise(flat)
            .alias("specialized_capabilities"),
            pick(TIERS, F.col("s_nationkey").cast("bigint")).alias("hospital_tier"),
        )

    # ---- derived layers ---------------------------------------------------

    @cached_property
    def dim_patient(self) -> DataFrame:
        return curated.dim_patient(self.patients, self.admissions)

    @cached_property
    def fact_admission(self) -> DataFrame:
        return curated.fact_hospital_admission(self.admissions, self.patients)

    @cached_property
    def fact_transfers(self) -> DataFrame:
        return curated.fact_transfers(self.transfers)

    @cached_property
    def icu_stays(self) -> DataFrame:
        """Stays without the surrogate key."""
        return curated.fact_icu_stay(self.transfers, surrogate_key=False)

    @cached_property
    def site_stays(self) -> DataFrame:
        return curated.site_stays(
            curated.counted_stays(self.transfers), self.fact_admission, self.dim_patient
        )

    # ---- scores, logs, runs -------------------------------------------------

    @cached_property
    def predictions(self) -> DataFrame:
        return shape_predictions(self.raw("orders"))

    @cached_property
    def events(self) -> DataFrame:
        return self.raw("events")

    @cached_property
    def access_events(self) -> DataFrame:
        return shape_access_events(self.events)

    @cached_property
    def requests(self) -> DataFrame:
        """Free-text requests, one per event."""
        key, who = F.col("event_id"), F.col("user_id")
        return self.events.select(
            key.alias("request_id"),
            _site(who, 0).alias("requesting_hospital"),
            F.concat(F.lit("hospital_"), (key % 120).cast("string")).alias("target_hospital"),
            F.when(key % 17 != 0, pick(FREE_TERMS, key)).alias("admission_text"),
            F.when(key % 13 != 0, pick(FREE_TERMS, key + 6)).alias("icu_text"),
            F.when(key % 19 != 0, pick(FREE_TERMS, key + 10)).alias("location_text"),
            pick(["m", " Female", "MAN", "w", "F"], key).alias("gender_text"),
            ((key % 7) - 1).cast("int").alias("score_text"),
            pick(["ecmo", "cardiac_surgery", "advanced_cardiac_care", "dialysis",
                  "cardiac_surgeon", "mechanical_ventilation", "mri"], key).alias("capability"),
            F.round((key * 13 % 1000) / F.lit(1000.0), 3).alias("risk_score"),
        )

    @cached_property
    def runs(self) -> DataFrame:
        """Experiment runs, one per supplier, with parameters and metrics."""
        key = F.col("l_suppkey")
        metric = self.raw("lineitem").groupBy(key.alias("run_id")).agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("l_returnflag") == "R").alias("r"),
            F.count_if(F.col("l_linestatus") == "O").alias("o"),
            F.max("l_shipdate").alias("finished_at"),
        )
        run = F.col("run_id")
        return metric.select(
            "run_id",
            "finished_at",
            F.col("n").alias("n_examples"),
            pick(["0.001", "0.01", "0.1"], run).alias("learning_rate"),
            pick(["1", "2"], run * 3 + 1).alias("local_epochs"),
            pick(["adam", "sgd"], F.floor(run / 3)).alias("optimizer"),
            F.lit("64").alias("batch_size"),
            (F.col("r") / F.col("n").cast("double")).alias("val_auc"),
            (F.col("o") / F.col("n").cast("double")).alias("recall"),
            ((F.col("n") - F.col("r")) / F.col("n").cast("double")).alias("accuracy"),
        )

    @cached_property
    def site_weights(self) -> DataFrame:
        """Parameter vectors, one per embedding row, with a round, a site and a weight."""
        key = F.col("vec_id")
        return self.raw("embeddings").select(
            (F.floor(key / 3) % 4).cast("int").alias("round"),
            key.alias("client_id"),
            (F.lit(10) + key % 90).alias("n_examples"),
            F.transform("embedding", lambda x: x.cast("double")).alias("weights"),
        )
