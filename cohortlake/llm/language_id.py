"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts are summed over every training row: a task adds its own rows into one bounded
table and emits that, so the shuffle holds tables, not n-grams. The matrix of log
probabilities has ``buckets`` rows and one column per language and is broadcast; documents
are scored in numpy from the n-grams they hold.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.workers import map_texts

UNDETERMINED = "und"
#: bounds of the model: hashed n-grams, lengths of n-grams, additive smoothing
BUCKETS, LENGTHS, SMOOTHING = 1 << 15, (1, 2, 3), 0.5
#: how far, in nats an n-gram, a text may fall below the usual one of its language
SLACK = 4.0
#: characters hashed at a time
_SLICE = 1 << 19
# a run of letters that is no part of a number, key, address or path
_TOKEN = re.compile(r"(?<![\w@./=+-])[^\W\d_]+(?![\w@/=+-])")


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    log_prior: np.ndarray
    log_prob: np.ndarray

    @property
    def expected(self) -> np.ndarray:
        """Mean log probability of an n-gram in a text of each language."""
        return (np.exp(self.log_prob) * self.log_prob).sum(axis=0)


def buckets_of(text: str, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Buckets of all character n-grams of a lower-cased text, in slices."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    code = np.concatenate([[np.uint64(32)], code, [np.uint64(32)]])
    longest = max(LENGTHS)
    for at in range(0, len(code), _SLICE):
        part = code[at:at + _SLICE + longest - 1]
        for n in LENGTHS:
            m = min(len(part) - n + 1, _SLICE)
            if m <= 0:
                continue
            h = np.full(m, np.uint64(n), np.uint64)
            for j in range(n):
                h = (h + part[j:j + m]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            yield (h >> np.uint64(17)) % np.uint64(buckets)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text)) if isinstance(text, str) else False


def fit(docs: DataFrame, training: Column, buckets: int = BUCKETS) -> Model:
    """Counts of n-grams per language over all rows where ``training`` holds.

    Rows with a null text or language teach nothing. What a task emits, and what reaches
    the driver, is at most one count per language and bucket, whatever the number of rows.
    """
    rows = docs.filter(training & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        F.col("lang").alias("lang"), F.col("text").alias("text"))

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                table = counts.setdefault(lang, np.zeros(buckets + 1, np.int64))
                table[buckets] += 1
                for b in buckets_of(text, buckets):
                    table[:buckets] += np.bincount(b.astype(np.int64), minlength=buckets)
        for lang, table in counts.items():
            used = np.flatnonzero(table)
            yield pd.DataFrame({"lang": lang, "bucket": used.astype(np.int32), "n": table[used]})

    # the last bucket counts documents
    found = (rows.mapInPandas(local, "lang string, bucket int, n long")
             .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())
    languages = tuple(sorted(found["lang"].unique()))
    if not languages:
        return Model((), np.empty(0), np.empty((buckets, 0)))
    table = np.zeros((buckets + 1, len(languages)))
    place = {lang: k for k, lang in enumerate(languages)}
    table[found["bucket"], found["lang"].map(place)] = found["n"]
    smooth, seen = table[:buckets] + SMOOTHING, table[buckets]
    return Model(languages, np.log(seen / seen.sum()), np.log(smooth / smooth.sum(axis=0)))


def posterior(model: Model, text: str) -> tuple[str, float]:
    """The likeliest language of a text with letters, and its probability."""
    log = model.log_prior.copy()
    for b in buckets_of(text, len(model.log_prob)):
        # sparse scoring: each n-gram held adds its row of the matrix
        held, times = np.unique(b, return_counts=True) if len(b) < 4096 else _dense(b, len(model.log_prob))
        log += times @ model.log_prob[held]
    share = np.exp(log - log.max())
    share /= share.sum()
    best = int(share.argmax())
    return model.languages[best], float(share[best])


def usual(model: Model, text: str, language: str, expected: np.ndarray) -> float:
    """How usual the words of a text are in a language.

    Mean log probability of an n-gram less that expected of the language: about 0 for prose,
    and far below for a language or a script that the model never saw. Only words of letters
    count, as numbers, keys and addresses tell nothing of a language; without any it is 0.
    """
    words = " ".join(_TOKEN.findall(text))
    if not words:
        return 0.0
    place, log, grams = model.languages.index(language), 0.0, 0
    for b in buckets_of(words, len(model.log_prob)):
        log += float(model.log_prob[b.astype(np.int64), place].sum())
        grams += len(b)
    return log / grams - float(expected[place])


def _dense(b: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    times = np.bincount(b.astype(np.int64), minlength=buckets)
    held = np.flatnonzero(times)
    return held, times[held]


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), judged: bool = False) -> DataFrame:
    """``keep`` columns with ``lang_pred`` and ``score``, the probability of that language.

    The whole text is read. A null text, one without a letter, or a model without languages
    gives ``und`` and score 0. Ties go to the first language by name. Every row is answered
    on its own, so repeated rows get equal answers. ``judged`` adds ``usual``, null where ``und``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(texts: list[str | None]) -> list[list]:
        m = shared.value
        found = [posterior(m, t) if m.languages and has_letter(t) else (UNDETERMINED, 0.0) for t in texts]
        out = [[f[0] for f in found], [f[1] for f in found]]
        if judged:
            expected = m.expected
            out.append([usual(m, t, f[0], expected) if f[0] in m.languages else None for t, f in zip(texts, found)])
        return out

    added = {"lang_pred": "string", "score": "double"} | ({"usual": "double"} if judged else {})
    return map_texts(docs, keep, added, make)


def identified(docs: DataFrame, model: Model, least: float = 0.5, slack: float = SLACK) -> DataFrame:
    """Documents in a language of the model: probability ``least`` or more, and ``usual`` at least ``-slack``.

    Texts of other languages and scripts, and strings of random letters, go. The rows keep all their columns; the language column is left as it came.
    """
    # columns travel under numbers, so that none can clash with the prediction's
    numbered = tuple(f"__c{i}" for i in range(len(docs.columns)))
    moved = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, numbered)], F.col("text").alias("text"))
    kept = predict(moved, model, numbered, judged=True).filter(
        (F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least) & (F.col("usual") >= -slack))
    return kept.select(*[F.col(n).alias(c) for n, c in zip(numbered, docs.columns)])
