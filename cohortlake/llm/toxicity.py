"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned: words that documents marked toxic hold far more often than the
others. Features are densities, so they do not grow with the length of a text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.text import pieces
from cohortlake.llm.workers import map_texts
from cohortlake.session import materialise

#: bounds of what the model learns from: labelled documents, words of the lexicon
SAMPLE, LEXICON, LEAST_DOCS = 20_000, 2_000, 4
#: parts of the sample, of which the last is for the calibration
PARTS = 4
#: letters of word beginnings that enter the lexicon beside whole words, longest first
STEMS = (5, 4)
#: words this many standard errors over the other documents enter the lexicon
LEAST_WEIGHT = 1.5
# fixed values: words of the second person in the four languages
SECOND_PERSON = (
    "you your yours yourself du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre vos "
    "tú usted ustedes vosotros ti tus"
)
FEATURES = ("lexicon", "lexicon_any", "lexicon_near_you", "you", "capitals", "shouting", "marks", "obfuscated",
            "repeated", "length")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = ".,;:!?\"'()[]{}«»¡¿*%$#&|"
# fixed values: characters written in place of letters
_LEET = str.maketrans("013457@$!", "oieastasi")


@dataclass(frozen=True)
class Scorer:
    lexicon: dict[str, float]
    trees: GBTClassificationModel | None
    steps: IsotonicRegressionModel | None
    prior: float


def normal(word: str) -> str:
    return word.strip(_EDGE).lower()


def features(text: str, lexicon: dict[str, float], you: frozenset[str]) -> tuple[float, ...]:
    """Dense features of a whole text; all zero for an empty one."""
    raw = _WORD.findall(text)
    n = len(raw)
    if not n:
        return (0.0,) * len(FEATURES)
    weight, hits, near, second, obfuscated, repeated, shouting, last_you, before = 0.0, 0, 0, 0, 0, 0, 0, -99, None
    marked: list[int] = []
    for i, token in enumerate(raw):
        word = token if token.islower() and token.isalpha() else normal(token)
        found = lexicon.get(word) or lexicon.get(word[:5] + "*") or lexicon.get(word[:4] + "*")
        if found:
            weight += found
            hits += 1
            near += i - last_you <= 5
            marked.append(i)
        elif word in you:
            second += 1
            last_you = i
            near += sum(i - m <= 5 for m in marked[-5:])
        elif not word.isalpha() and len(word) > 2:
            plain = word.translate(_LEET)
            if plain != word and plain in lexicon:
                obfuscated += 1
                weight += lexicon[plain]
        repeated += word == before
        before = word
        shouting += len(token) > 2 and token.isupper()
    chars = len(text)
    return (weight / n * 100, float(hits + obfuscated > 0) + math.log1p(hits + obfuscated), near / n * 100,
            second / n * 100, sum(map(str.isupper, text)) / chars, shouting / n,
            sum(text.count(m) for m in "!?*#$%") / chars, obfuscated / n * 100, repeated / n, math.log1p(n))


def _you() -> frozenset[str]:
    return frozenset(SECOND_PERSON.split())


def with_features(docs: DataFrame, lexicon: dict[str, float], keep: tuple[str, ...]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def make(texts: list[str | None]) -> list[list]:
        words, you = shared.value, _you()
        return list(map(list, zip(*[features(t or "", words, you) for t in texts])))

    return map_texts(docs, keep, dict.fromkeys(FEATURES, "double"), make)


def sample(labelled: DataFrame, key: str, rows: int = SAMPLE) -> DataFrame:
    """At most ``rows`` labelled rows, chosen by a hash of the key, so always the same ones."""
    return labelled.orderBy(F.xxhash64(F.col(key)), F.col(key)).limit(rows)


def learn_lexicon(train: DataFrame) -> dict[str, float]:
    """Words and word beginnings with the largest log odds of a marked document, from document counts.

    ``train`` is the bounded sample, with ``text`` and ``label``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in pieces(batches, 256):
            held: dict[str, list[int]] = {}
            for text, label in zip(part["text"], part["label"]):
                words = set(map(normal, _WORD.findall(text)))
                for word in words.union(*({w[:n] + "*" for w in words if len(w) > n} for n in STEMS)):
                    held.setdefault(word, [0, 0])[int(label)] += 1
            yield pd.DataFrame([(w, m, o) for w, (o, m) in held.items()], columns=["word", "marked", "other"])

    listed = train.select("text", "label").mapInPandas(run, "word string, marked long, other long")
    counted = listed.groupBy("word").agg(
        F.sum("marked").alias("marked"), F.sum("other").alias("other")).filter(
        (F.col("marked") >= LEAST_DOCS) & (F.length("word") > 1))
    total = train.agg(F.sum("label").alias("m"), F.sum(1 - F.col("label")).alias("o")).first()
    if not total["m"] or not total["o"]:
        return {}
    odds = (F.log((F.col("marked") + 0.5) / (total["m"] + 1.0))
            - F.log((F.col("other") + 0.5) / (total["o"] + 1.0)))
    error = F.sqrt(1.0 / (F.col("marked") + 0.5) + 1.0 / (F.col("other") + 0.5))
    best = (counted.withColumn("weight", odds - LEAST_WEIGHT * error).filter(F.col("weight") > 1.0)
            .orderBy(F.desc("weight"), "word").limit(LEXICON).collect())
    return {r["word"]: float(r["weight"]) for r in best}


def fit(docs: DataFrame, labels: DataFrame, trees: int = 12, depth: int = 4, rows: int = SAMPLE) -> Scorer:
    """Lexicon, trees and calibration from at most ``rows`` labelled documents.

    ``labels`` has ``doc_id`` and ``label`` (0 or 1) of the rows that may be learned from.
    Three parts of four of the sample (by a hash of the id) give the lexicon and the trees, the
    last the calibration, whose rows neither has seen. Of an id on
    several rows the text with the smallest hash is learned from. Without both labels the scorer
    answers the share of label 1, or 0.
    """
    known = labels.filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max("label").alias("label"))
    chosen = sample(known, "doc_id", rows)
    train = materialise(docs.select("doc_id", "text").filter(F.col("text").isNotNull())
                        .join(F.broadcast(chosen), "doc_id")
                        .groupBy("doc_id", "label").agg(
                            F.min(F.struct(F.xxhash64("text").alias("place"), "text"))["text"].alias("text"))
                        .withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(PARTS))))
    shares = train.agg(F.count("*").alias("n"), F.sum("label").alias("m")).first()
    if not shares["n"] or shares["m"] in (0, shares["n"]):
        return Scorer({}, None, None, float((shares["m"] or 0) / shares["n"]) if shares["n"] else 0.0)
    lexicon = learn_lexicon(train.filter(F.col("part") < PARTS - 1))
    table = materialise(assembled(with_features(train, lexicon, ("doc_id", "label", "part"))))
    inner = table.filter(F.col("part") < PARTS - 1)
    model = GBTClassifier(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, maxBins=32,
                          stepSize=0.3, seed=7).fit(inner)
    outer = raw_scores(table.filter(F.col("part") == PARTS - 1), model)
    steps = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="score").fit(
        outer.select(F.col("raw"), F.col("label").cast("double").alias("label")))
    return Scorer(lexicon, model, steps, 0.0)


def assembled(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(df)


def raw_scores(df: DataFrame, model: GBTClassificationModel) -> DataFrame:
    return model.transform(df).withColumn("raw", vector_to_array("probability")[1])


def score(docs: DataFrame, scorer: Scorer, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with ``score`` from 0 to 1, higher for likelier toxic.

    Null and empty texts have all features zero and are scored as such. Each row is scored
    on its own; ties and repeated rows get equal scores.
    """
    if scorer.trees is None:
        return docs.select(*[F.col(c).alias(c) for c in keep], F.lit(scorer.prior).alias("score"))
    scored = raw_scores(assembled(with_features(docs, scorer.lexicon, keep)), scorer.trees)
    # linear between the steps of the isotonic fit, and constant outside them
    return scorer.steps.transform(scored.select(*keep, "raw")).select(*keep, "score")
