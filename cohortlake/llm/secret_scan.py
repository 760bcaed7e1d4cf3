"""Secret scan: candidates of two forms, and a random forest that removes false positives.

A candidate is a run of 16 or more characters of keys, tokens and passwords, or a shorter value
after an announcing word (``password = ...``) or between a user and a host
(``://user:...@host``). The forest sees its length, its character transitions, how much of it a dictionary covers, whether it is
part of a path, and the words around it. It is trained from labelled findings, a bounded
sample. Everything is DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.session import materialise

#: shortest run, shortest announced value; characters of context kept on each side
SHORTEST, ANNOUNCED_SHORTEST, AROUND = 16, 6, 48
#: bounds of the training sample and of the dictionary
SAMPLE, DICTIONARY = 10_000, 2_000
LEAST = 0.5
CANDIDATE = rf"(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{{{SHORTEST},}}+"
# fixed values: published formats of keys, and words that announce a secret
FORMATS = (
    r"^(AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{36,}$|^xox[abprs]-[A-Za-z0-9\-]{10,}$"
    r"|^sk_live_[A-Za-z0-9]{16,}$|^AIza[A-Za-z0-9_\-]{35}$|^glpat-[A-Za-z0-9_\-]{20,}$"
)
WORDS = r"password|passwd|pwd|secret|token|api[_\-]?key|access[_\-]?key|auth|credential"
_LEADS = r"[\"' ]{0,3}[=:][\"' ]{0,3}"
ANNOUNCED = rf"(?i)({WORDS}){_LEADS}$"
USER = r"://[^\s/:@\"']+:$"
# an announced value holds a digit or a sign: letters alone cannot be told from prose
_ASSIGNED = (
    rf"((?<![A-Za-z0-9+/_\-])[A-Za-z_\-]*?(?i:{WORDS}){_LEADS})"
    rf"((?=[^\s\"'<>,;:=]*[0-9#$%&*+@^_~])[^\s\"'<>,;]{{{ANNOUNCED_SHORTEST - 1},}}[^\s\"'<>,;.:!?)\]}}])"
)
_LOGIN = rf"(://[^\s/:@\"']++:)([^\s/@\"']{{{ANNOUNCED_SHORTEST},}}+)(?=@)"
EVERY = rf"{_ASSIGNED}|{_LOGIN}|({CANDIDATE})"
KEYWORD = r"(?i)(pass|pwd|secret|token|key|auth|cred|bearer)"
FEATURES = (
    "length", "digits", "uppers", "hex", "changes", "distinct", "vowels", "covered", "longest_letters",
    "path", "mail_or_host", "assigned", "quoted", "keyword", "sentence",
)
_START, _END = "\u0001", "\u0002"


def candidates(docs: DataFrame) -> DataFrame:
    """``text_key``, ``finding``, ``before`` and ``after`` of every candidate of every distinct text.

    ``text_key`` is the hash of the text: copies of a text have equal findings, so each text
    is scanned for its rows once the copies have met. Null and empty texts have none.
    """
    text = F.translate("text", _START + _END, "  ")
    pieces = F.split(F.regexp_replace(text, EVERY, f"$1$3{_START}$2$4$5{_END}"), _START)
    found = docs.filter(F.col("text").rlike(EVERY)).select(
        F.xxhash64("text").alias("text_key"), pieces.alias("p")).select(
        "text_key", F.inline(F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.struct(
            F.substring_index(F.col("p")[i], _END, 1).alias("finding"),
            F.right(F.substring_index(F.col("p")[i - 1], _END, -1), F.lit(AROUND)).alias("before"),
            F.left(F.substring_index(F.col("p")[i], _END, -1), F.lit(AROUND)).alias("after")))))
    return found.distinct()


def dictionary(docs: DataFrame, words: int = DICTIONARY) -> list[str]:
    """The most frequent letter words of four letters or more, over all documents."""
    listed = docs.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word"))
    counted = listed.filter(F.length("word") >= 4).groupBy("word").count()
    return [r["word"] for r in counted.orderBy(F.desc("count"), "word").limit(words).collect()]


def _share(pattern: str) -> Column:
    return F.length(F.regexp_replace("finding", pattern, "")) / F.length("finding")


def _login() -> Column:
    return F.col("before").rlike(USER) & F.col("after").startswith("@")


def with_features(found: DataFrame, known: list[str]) -> DataFrame:
    """The features of each candidate, as one vector."""
    runs = F.filter(F.split(F.lower("finding"), "[^a-z]+"), lambda r: F.length(r) >= 4)
    listed = F.array(*map(F.lit, known)) if known else F.array().cast("array<string>")
    in_words = F.aggregate(F.array_intersect(runs, listed), F.lit(0), lambda n, r: n + F.length(r))
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(
        "finding", "[0-9]+", "9"), "[A-Z]+", "A"), "[a-z]+", "a")
    letters = F.transform(F.split("finding", "[^A-Za-z]+"), lambda r: F.length(r))
    # a value between user and host is announced by its place, and is no part of a path
    login = _login()
    values = {
        "length": F.length("finding"),
        "digits": _share("[^0-9]"),
        "uppers": _share("[^A-Z]"),
        "hex": _share("[^0-9a-fA-F]"),
        "changes": F.length(classes) / F.length("finding"),
        "distinct": F.size(F.array_distinct(F.split("finding", ""))) / F.length("finding"),
        "vowels": _share("[^aeiouAEIOU]"),
        "covered": in_words / F.length("finding"),
        "longest_letters": F.coalesce(F.array_max(letters), F.lit(0)),
        "path": F.length(F.regexp_replace("finding", "[^/]", "")) + (
            F.col("before").rlike(r"(://|www\.|[\\/])[^ ]*$") & ~login).cast("int"),
        "mail_or_host": ((F.col("before").rlike(r"[@.]$") | F.col("after").rlike(r"^[@.][A-Za-z0-9]")) & ~login).cast("int"),
        "assigned": F.col("before").rlike(r"[=:] ?[\"']?$").cast("int"),
        "quoted": (F.col("before").rlike(r"[\"']$") & F.col("after").rlike(r"^[\"']")).cast("int"),
        "keyword": (F.col("before").rlike(KEYWORD + r"[^ ]* ?[=:]? ?[^ ]{0,2}$") | login).cast("int"),
        "sentence": F.col("after").rlike(r"^[,.;!?]? +\p{Ll}").cast("int"),
    }
    table = found.select("*", *[v.cast("double").alias(f"__{k}") for k, v in values.items()])
    return VectorAssembler(inputCols=[f"__{k}" for k in FEATURES], outputCol="features").transform(table).drop(
        *[f"__{k}" for k in FEATURES])


def labelled(found: DataFrame) -> DataFrame:
    """Findings whose label is beyond doubt: published formats and announced values are
    secrets, plain words and numbers, hosts and paths are not. The others have no label."""
    announced = (F.col("before").rlike(ANNOUNCED) | _login()) & F.col("finding").rlike("[0-9]")
    plain = F.col("finding").rlike(r"^[A-Za-z]?[a-z]+$|^[0-9]+$|^[A-Z]+$") & ~F.col("before").rlike(ANNOUNCED)
    label = F.when(F.col("finding").rlike(FORMATS) | announced, 1.0).when(
        plain | F.col("after").rlike(r"^\.[a-z]{2,6}\b") | F.col("finding").rlike("/.*/"), 0.0)
    return found.withColumn("label", label).filter("label is not null")


def fit(findings: DataFrame, known: list[str], rows: int = SAMPLE, trees: int = 20, depth: int = 6,
        ) -> RandomForestClassificationModel | float:
    """A forest from at most ``rows`` labelled findings of each label, chosen by a hash.

    ``findings`` has ``finding``, ``before``, ``after`` and ``label``. With one label only, or
    none, there is nothing to tell apart and the share of secrets is returned.
    """
    parts = [findings.filter(F.col("label") == label).orderBy(
        F.xxhash64("finding", "before", "after"), "finding").limit(rows) for label in (0.0, 1.0)]
    train = materialise(with_features(parts[0].union(parts[1]), known).select("features", "label"))
    seen = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    if len(seen) < 2:
        return 1.0 if seen.get(1.0) else 0.0
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=17, featureSubsetStrategy="sqrt").fit(train)


def scored(found: DataFrame, model: RandomForestClassificationModel | float, known: list[str]) -> DataFrame:
    """Candidates with ``score``, the forest's probability of a secret."""
    if isinstance(model, float):
        return found.withColumn("score", F.lit(model))
    out = model.transform(with_features(found, known))
    return out.select(*found.columns, vector_to_array("probability")[1].alias("score"))


def secrets(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """``text_key``, ``finding``, ``before`` and ``score`` of the candidates that the forest accepts."""
    found = materialise(candidates(docs))
    known = dictionary(docs)
    model = fit(labelled(found), known)
    return scored(found, model, known).filter(F.col("score") >= least).select(
        "text_key", "finding", "before", "score")


def scan(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The secrets of every row of ``docs``: ``doc_id``, ``finding`` and the best ``score``.

    A secret that stands several times in a text is one row. Repeated rows and null ids are
    answered row by row. Null and empty texts have no secret.
    """
    found = secrets(docs, least).groupBy("text_key", "finding").agg(F.max("score").alias("score"))
    return docs.select("doc_id", F.xxhash64("text").alias("text_key")).join(found, "text_key").select(
        "doc_id", "finding", "score")


def redacted(docs: DataFrame, least: float = LEAST, mark: str = "<SECRET>") -> DataFrame:
    """``docs`` with every secret replaced by ``mark``; ``n_chars``, if there, follows the text.

    All rows and columns stay; texts without a secret are unchanged.
    """
    key, words = "__text_key", "__secrets"
    # the longest first, so that no secret is cut by a shorter one inside it
    listed = F.transform(F.reverse(F.array_sort(F.collect_set(F.struct(
        F.length("finding").alias("n"), F.col("finding").alias("f"))))), lambda s: s["f"])
    found = secrets(docs, least).groupBy(F.col("text_key").alias(key)).agg(listed.alias(words))
    joined = docs.withColumn(key, F.xxhash64("text")).join(found, key, "left")
    text = F.when(F.col(words).isNull(), F.col("text")).otherwise(
        F.aggregate(words, F.col("text"), lambda t, s: F.replace(t, s, F.lit(mark))))
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(words).isNull(), F.col("n_chars")).otherwise(
            F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
