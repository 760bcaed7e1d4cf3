"""Privacy operators: anonymisation, leak checks, k-anonymity, noise, the network query."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from cohortlake.functions import clinical as C, generalise as G, terms, vocabulary as V
from cohortlake.functions.scalars import canonical_json, hash_unit
from cohortlake.operators.joins import join_small
from cohortlake.session import materialise

#: rows that share a window before it counts as frequent, and windows that one task sorts
OFTEN, ROWS_PER_TASK = 100_000, 1_000_000


def identifier_columns(df: DataFrame, names: Sequence[str] = tuple(V.DIRECT_IDENTIFIERS)) -> list[str]:
    """Columns that are direct identifiers, whatever their case."""
    listed = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() in listed]


def drop_identifiers(df: DataFrame, names: Sequence[str] = tuple(V.DIRECT_IDENTIFIERS)) -> DataFrame:
    """Rows without direct identifiers, with the removed names as a column."""
    found = identifier_columns(df, names)
    removed = F.array(*[F.lit(n) for n in (found or ["none_present"])])
    return df.drop(*found).withColumn("removed_fields", removed)


def anonymise(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Shareable form of patient rows: generalised, mapped, without identifiers.

    Reads age_at_admission, risk_score, admission_type, icu_type, gender,
    early_icu_score, weekend_admission, night_admission, hospital_id. ``keep`` names
    extra columns to pass through.
    """
    age = F.coalesce(F.col("age_at_admission"), F.lit(65))
    raw_type = F.coalesce(F.col("admission_type"), F.lit(V.EMERGENCY_LITERAL))
    checked = df.withColumn(
        "_v",
        terms.validate_parameters(raw_type, F.col("icu_type"), F.col("early_icu_score"), F.col("gender")),
    )
    removed = identifier_columns(df) or ["none_present"]
    v = lambda name: F.col(f"_v.{name}")
    return checked.select(
        *keep,
        G.age_bucket(age).alias("age_bucket"),
        v("gender").alias("gender"),
        v("admission_type_primary").alias("admission_type"),
        v("admission_type_category").alias("admission_type_category"),
        v("admission_types").alias("admission_types_all"),
        v("early_icu_score").alias("early_icu_score"),
        v("icu_type_primary").alias("icu_type"),
        v("icu_type_category").alias("icu_type_category"),
        G.score_range(F.col("risk_score")).alias("risk_score_range"),
        F.coalesce("weekend_admission", F.lit(0)).alias("weekend_admission"),
        F.coalesce("night_admission", F.lit(0)).alias("night_admission"),
        (v("admission_type_category") == "EMERGENCY").cast("int").alias("emergency_admission"),
        F.col("hospital_id").alias("source_hospital"),
        F.lit(V.PRIVACY_LEVEL).alias("privacy_level"),
        F.size(v("warnings")).alias("n_warnings"),
        F.array(*[F.lit(n) for n in removed]).alias("removed_fields"),
    )


def leaked_values(original: DataFrame, output: DataFrame, row_id: str, identifiers: Sequence[str]) -> DataFrame:
    """Identifier values longer than three characters found inside the output row."""
    payload = F.to_json(F.struct(*[c for c in output.columns if c != row_id]))
    sent = output.select(row_id, payload.alias("_payload"))
    kept = original.select(row_id, *[F.col(c).cast("string").alias(f"_id_{c}") for c in identifiers])

    def inside(c: str) -> Column:
        # the value as JSON writes it, without its frame: quotes and backslashes are escaped alike
        written = F.to_json(F.struct(F.col(f"_id_{c}").alias("v")))
        return F.contains(F.col("_payload"), F.substring(written, 7, F.length(written) - 8))

    leaks = F.array_compact(F.array(*[
        F.when((F.length(f"_id_{c}") > 3) & inside(c), F.lit(c)) for c in identifiers
    ]))
    return kept.join(sent, row_id).select(row_id, leaks.alias("leaked")).filter(F.size("leaked") > 0)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def foreign_leaks(original: DataFrame, output: DataFrame, row_id: str, identifiers: Sequence[str]) -> DataFrame:
    """Identifiers of *any* person found in an output row: ``row_id``, ``identifier``, ``owner``.

    Every identifier longer than three characters is indexed by its words, and the word windows
    of the output texts are joined with that index by their hash, so no row meets all
    identifiers; a hit counts if the words agree. Case and punctuation do not matter. A window
    inside a longer word is not seen: ``leaked_values`` looks for that in a person's own row.
    Rows whose ``row_id`` is null are not sent under an id and are left out.
    Windows in more than ``OFTEN`` rows are not shuffled; each of them stands for many rows, so
    they are few.
    """
    index = materialise(
        original.select(F.col(row_id).alias("owner"), F.inline(F.array(*[
            F.struct(F.lit(c).alias("identifier"), F.col(c).cast("string").alias("value")) for c in identifiers])))
        .filter(F.length("value") > 3).withColumn("words", _words(F.col("value"))).filter(F.size("words") > 0)
        .select("owner", "identifier", "words", F.xxhash64("words").alias("hash")))
    # a few numbers: how many words identifiers have
    sizes = sorted(r["n"] for r in index.select(F.size("words").alias("n")).distinct().collect())
    texts = [f.name for f in output.schema.fields if f.name != row_id]
    # the fields are kept apart, so that no window spans two of them
    said = output.filter(F.col(row_id).isNotNull()).select(row_id, F.explode(F.array(*[
        F.to_json(F.struct(F.col(c).alias("v"))) if isinstance(output.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType))
        else F.col(c).cast("string") for c in texts])).alias("text")).select(row_id, _words(F.col("text")).alias("said"))

    def runs(n: int) -> Column:
        places = F.sequence(F.lit(1), F.size("said") - n + 1)
        return F.when(F.size("said") >= n, F.transform(places, lambda i: F.slice("said", i, n))).otherwise(
            F.array().cast("array<array<string>>"))

    windows = F.flatten(F.array(*[runs(n) for n in sizes])) if sizes else F.array().cast("array<array<string>>")
    met = materialise(said.select(row_id, F.explode(F.array_distinct(windows)).alias("window")).select(
        row_id, F.xxhash64("window").alias("hash"), F.array_join("window", " ").alias("window")))
    index = index.withColumn("words", F.array_join("words", " "))
    # windows that many rows hold meet their identifiers where they are; of the others a task gets a bounded number
    often = materialise(met.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > OFTEN).select("hash"))
    usual = met.join(F.broadcast(often), "hash", "left_anti").repartition(met.count() // ROWS_PER_TASK + 1, "hash")
    hits = [usual.join(index, "hash"), join_small(met, index.join(F.broadcast(often), "hash", "left_semi"), "hash")]
    return reduce(DataFrame.unionByName, [
        h.filter(F.col("window") == F.col("words")).select(row_id, "identifier", "owner") for h in hits]).distinct()


def pattern_hits(df: DataFrame, text: Column | None = None, patterns: Sequence[str] = tuple(V.SUSPICIOUS_PATTERNS)) -> DataFrame:
    """Rows with the suspicious patterns their text contains (V06); whole text, case-blind."""
    body = F.lower(text if text is not None else F.to_json(F.struct(*df.columns)))
    hits = F.array_compact(F.array(*[F.when(F.contains(body, F.lit(p)), F.lit(p)) for p in patterns]))
    return df.withColumn("found_patterns", hits)


def pattern_summary(hits: DataFrame) -> DataFrame:
    """Rows per pattern."""
    return hits.select(F.explode("found_patterns").alias("pattern")).groupBy("pattern").agg(
        F.count(F.lit(1)).alias("n_rows")
    )


def require_clean(hits: DataFrame) -> None:
    """Raise when any row holds a suspicious pattern."""
    blocked = hits.filter(F.size("found_patterns") > 0).limit(1).count()
    if blocked:
        raise ValueError("suspicious patterns in outgoing data")


def compliance(df: DataFrame) -> DataFrame:
    """Schema and age check before rows leave a site."""
    columns = {c.lower() for c in df.columns}
    found = [c for c in df.columns if c.lower() in set(V.FORBIDDEN_COLUMNS)]
    texts = [F.lit(f"identifier found: {c}") for c in found]
    too_old = F.lit(False)
    if "age_at_admission" in columns:
        too_old = F.coalesce(F.max("age_at_admission") > 89, F.lit(False))
    warnings = (
        [F.lit("combination may be re-identifying")]
        if set(V.REIDENTIFYING_COMBINATION) <= columns
        else []
    )
    none = F.array().cast("array<string>")
    checked = df.agg(F.count(F.lit(1)).alias("n_rows"), too_old.alias("_old"))
    violations = F.array_compact(
        F.array(*texts, F.when(F.col("_old"), "exact age > 89 is an identifier"))
    )
    return checked.select(
        "n_rows",
        violations.alias("violations"),
        (F.array(*warnings) if warnings else none).alias("warnings"),
        (F.size(violations) == 0).alias("is_compliant"),
    )


def with_fingerprint(df: DataFrame, fields: Sequence[str] = tuple(V.SHARED_FIELDS)) -> DataFrame:
    """Matching fingerprint over generalised fields."""
    return df.withColumn("fingerprint", F.sha2(canonical_json(fields), 256))


def k_anonymous(df: DataFrame, quasi: Sequence[str], k: int = V.K_ANONYMITY) -> DataFrame:
    """Groups of at least k rows with their size, and one row that counts the others.

    That somebody has the values of a small group is what k-anonymity hides, so its values
    are not released; the last row has no values and the number of suppressed groups.
    """
    groups = df.groupBy(*quasi).agg(F.count(F.lit(1)).alias("n"))
    met = groups.filter(F.col("n") >= k).select(*quasi, "n", F.lit(None).cast("bigint").alias("suppressed_groups"))
    rest = groups.agg(F.count_if(F.col("n") < k).alias("suppressed_groups")).select(
        *[F.lit(None).cast(groups.schema[c].dataType).alias(c) for c in quasi],
        F.lit(None).cast("bigint").alias("n"), "suppressed_groups")
    return met.unionByName(rest)


def noisy_counts(
    answers: DataFrame, keys: Sequence[str], epsilon: float | None = V.EPSILON,
    k: int = V.K_ANONYMITY, seed: str = "",
) -> DataFrame:
    """k gate, Laplace noise, clamps and rates over exact cohort counts.

    Two counts are released, each with noise of scale 1 / epsilon, so an answer costs
    2 epsilon; the averages carry no noise. Cohorts below k release nothing, not even
    their size. With ``seed`` empty the noise is fresh per run; a seed makes it a
    function of the keys, for tests. ``epsilon=None`` releases exact counts.
    """
    met = F.col("case_count") >= k

    def noise(salt: str) -> Column:
        if epsilon is None:
            return F.lit(0).cast("bigint")
        if seed:
            text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in keys])
            uniform = hash_unit(text, f"{seed}{salt}")
        else:
            uniform = F.rand()
        return F.round(G.laplace(uniform, 1.0 / epsilon)).cast("bigint")

    gated = answers.withColumn("k_anonymity_met", met).withColumn(
        "_count", F.when(met, F.greatest(F.lit(k), F.col("case_count") + noise("count")))
    )
    gated = gated.withColumn(
        "_deaths",
        F.when(met, F.greatest(F.lit(0), F.least(F.col("_count"), F.col("deaths") + noise("deaths")))),
    )
    rate = F.col("_deaths") / F.col("_count").cast("double")
    return gated.select(
        *keys,
        "k_anonymity_met",
        F.coalesce("_count", F.lit(0)).cast("bigint").alias("cases_found"),
        F.round(1 - rate, 3).alias("survival_rate"),
        F.round(rate, 3).alias("mortality_rate"),
        F.when(met, F.round("avg_icu_los", 1)).alias("avg_icu_los_hours"),
        F.when(met, F.round("avg_hospital_los", 1)).alias("avg_hospital_los_days"),
    )


def fingerprinted_patients(df: DataFrame, day: str) -> DataFrame:
    """Pseudonym, age bucket and score range per patient."""
    return df.select(
        G.pseudonym(F.col("subject_id"), F.lit(day)).alias("patient_fingerprint"),
        G.age_bucket(F.col("age")).alias("age_bucket"),
        G.score_range(F.col("risk_score")).alias("risk_score_range"),
        C.risk_level(F.col("risk_score")).alias("risk_level"),
    )
