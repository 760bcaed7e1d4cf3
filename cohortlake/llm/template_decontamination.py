"""Benchmark decontamination by templates: typed placeholders, window join, slot consistency.

Numbers, names and units of a text become placeholders, so that a question with other
parameters has the same template. Windows of template words are hash-joined with those of
the benchmark, and a match counts only if its slots are consistent: along one alignment
each value of the item stands for one value of the document and the other way round.

Everything is DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.session import materialise

#: template words of a window, and the shortest item that can be recognised
WINDOW, SHORTEST = 10, 5
#: benchmark windows up to this many are broadcast (16 bytes each); more are shuffled
BROADCAST_WINDOWS = 500_000
# fixed values: units of measure
UNITS = (
    "mm|cm|m|km|mg|g|kg|t|ml|cl|l|s|ms|min|h|hours|hour|minutes|minute|seconds|second|days|day|weeks|week|years|year"
    "|miles|mile|feet|foot|inches|inch|euros|euro|dollars|dollar|cents|percent|degrees|degree|meters|meter|metres|metre"
)
# possessive groups: the matcher must not keep a frame for each of thousands of names or numbers
_CAPITALISED = r"\p{Lu}\p{Ll}++(?!\p{L})"
NAME = rf"([\p{{Ll}}\p{{N}},;][ \t\r\n])({_CAPITALISED}(?:[ \t]{_CAPITALISED})*+)"
NUMBER = r"[0-9]++(?:[.,:/][0-9]++)*+"
UNIT = rf"(<num>[ ]*)({UNITS})(?:[^\p{{L}}\p{{N}}]|$)"
_SPLIT = r"[^\p{L}\p{N}<>]+"


def _named(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, "<>", "  "), NAME, "$1 <name> ")


def _numbered(text: Column) -> Column:
    return F.regexp_replace(text, NUMBER, " <num> ")


def template(text: Column) -> Column:
    """Template words of a text, in order; none for a null or empty one."""
    marked = F.regexp_replace(_numbered(_named(text)), UNIT, "$1<unit> ")
    return F.filter(F.split(F.lower(marked), _SPLIT), lambda w: w != "")


def _slots(rows: DataFrame, key: str) -> DataFrame:
    """Place, kind and value of every placeholder of a text, from ``text`` and ``words``."""
    values = {
        "<name>": F.regexp_extract_all(F.translate("text", "<>", "  "), F.lit(NAME), 2),
        "<num>": F.regexp_extract_all(_named(F.col("text")), F.lit(NUMBER), 0),
        "<unit>": F.regexp_extract_all(_numbered(_named(F.col("text"))), F.lit(UNIT), 2),
    }

    def of(kind: str, value: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.col("words")[i] == kind)
        zipped = F.arrays_zip(places.alias("place"), value.alias("value"))
        return F.transform(zipped, lambda z: F.struct(
            z["place"].alias("place"), F.lit(kind).alias("kind"), F.lower(z["value"]).alias("value")))

    return rows.filter(F.size("words") > 0).select(key, F.inline(F.concat(*[of(k, v) for k, v in values.items()])))


def windows(words: Column, size: int) -> Column:
    """Hash of every run of ``size`` template words with its place."""
    places = F.sequence(F.lit(0), F.size(words) - size)
    return F.when(F.size(words) >= size, F.transform(places, lambda i: F.struct(
        i.alias("place"), F.xxhash64(F.slice(words, i + 1, size)).alias("hash"))))


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document text and item it holds: ``row_key``, ``item_id``, place and windows.

    ``row_key`` is the hash of the text, as copies of a text are contaminated alike. An item
    of fewer than ``window`` but at least ``SHORTEST`` template words has one window, the
    whole item; shorter or null items are never found. ``first_word`` and ``last_word`` are
    template words of the document, ``same_values`` tells whether all slots have the item's values.
    Null and empty texts hold nothing; equal items are found each.
    """
    items = materialise(benchmark.select(F.col("item_id"), F.col("text").alias("text"))
                        .filter(F.col("item_id").isNotNull())
                        .withColumn("words", template(F.col("text"))).filter(F.size("words") >= SHORTEST))
    sizes = sorted(r["size"] for r in items.select(
        F.least(F.size("words"), F.lit(window)).alias("size")).distinct().collect())
    parts = [items.filter(F.least(F.size("words"), F.lit(window)) == size).select(
        "item_id", F.lit(size).alias("size"), F.inline(windows(F.col("words"), size))) for size in sizes]
    if not parts:
        return docs.sparkSession.createDataFrame([], (
            "row_key long, item_id long, first_word int, last_word int, n_windows long, same_values boolean"))
    wanted = parts[0]
    for part in parts[1:]:
        wanted = wanted.union(part)
    wanted = materialise(wanted)
    keys = wanted.select("hash").distinct()
    if wanted.count() <= BROADCAST_WINDOWS:
        keys = F.broadcast(keys)

    texts = docs.filter(F.col("text").isNotNull()).select(
        F.xxhash64("text").alias("row_key"), F.col("text").alias("text"))
    worded = texts.select("row_key", template(F.col("text")).alias("words"))
    runs = F.concat(*[F.coalesce(windows(F.col("words"), size), F.array()) for size in sizes]) if len(sizes) > 1 \
        else windows(F.col("words"), sizes[0])
    hits = materialise(worded.select("row_key", F.inline(runs)).join(keys, "hash").distinct())

    # one alignment: the difference of the places in document and item
    met = hits.join(wanted.withColumnRenamed("place", "item_place"), "hash").select(
        "row_key", "item_id", "place", (F.col("place") - F.col("item_place")).alias("shift"), "size")
    aligned = materialise(met.groupBy("row_key", "item_id", "shift").agg(
        F.min("place").alias("first_word"), F.max(F.col("place") + F.col("size") - 1).alias("last_word"),
        F.count("*").alias("n_windows")))
    # the texts with a hit are read again for their slots
    held = texts.join(aligned.select("row_key").distinct(), "row_key").dropDuplicates(["row_key"])
    slots = _slots(held.withColumn("words", template(F.col("text"))), "row_key")
    own = _slots(items, "item_id").select(
        "item_id", F.col("place").alias("item_place"), F.col("kind").alias("item_kind"), F.col("value").alias("item_value"))
    pairs = (aligned.join(slots, "row_key")
             .filter((F.col("place") >= F.col("first_word")) & (F.col("place") <= F.col("last_word")))
             .withColumn("item_place", F.col("place") - F.col("shift"))
             .join(own, ["item_id", "item_place"]).filter("kind = item_kind")
             .select("row_key", "item_id", "shift", "kind", "value", "item_value").distinct())
    each = pairs.groupBy("row_key", "item_id", "shift").agg(
        F.count("*").alias("pairs"), F.count_distinct("kind", "value").alias("values"),
        F.count_distinct("kind", "item_value").alias("item_values"),
        F.min((F.col("value") == F.col("item_value")).cast("int")).alias("same"))
    judged = aligned.join(each, ["row_key", "item_id", "shift"], "left").filter(
        F.col("pairs").isNull() | ((F.col("pairs") == F.col("values")) & (F.col("pairs") == F.col("item_values"))))
    return judged.groupBy("row_key", "item_id").agg(
        F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"),
        F.sum("n_windows").alias("n_windows"), (F.min(F.coalesce("same", F.lit(1))) == 1).alias("same_values"))


def findings(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The contaminated documents, one row for each row of ``docs`` and item found in it."""
    found = contaminated(docs, benchmark, window)
    return docs.select("doc_id", F.xxhash64("text").alias("row_key")).join(found, "row_key").drop("row_key")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that hold no item, with all their columns; null texts stay."""
    key = "__row_key"
    found = contaminated(docs, benchmark, window).select(F.col("row_key").alias(key)).distinct()
    return docs.withColumn(key, F.xxhash64("text")).join(found, key, "left_anti").drop(key)
