"""Quality: random-indexing word vectors pooled per document, and a two-layer network.

Each bucket of tokens has a sparse random index vector; its context vector is the sum of
the index vectors of its neighbours over every document. A document is the mean of its
tokens' vectors. A small numpy network is trained on a bounded sample of labelled rows,
and a temperature fitted on held-back rows calibrates its probabilities.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.workers import map_texts

#: bounds of the model: buckets of tokens, dimensions, ones in an index vector, neighbours on a side
BUCKETS, DIMENSIONS, ONES, REACH = 1 << 12, 48, 4, 1
#: bound of the labelled sample
SAMPLE = 20_000
#: buckets of one token shape
_SHAPES = 8
_TOKEN = re.compile(r"\w+|[^\w\s]+")
#: tokens held at a time
_SLICE = 1 << 18


@dataclass(frozen=True)
class Network:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float


def _shape(token: str) -> int:
    if token.islower():
        return 0
    if token.isupper():
        return 1 if len(token) > 1 else 2
    if token.istitle():
        return 3
    if token.isdigit():
        return 4
    if token.isalnum():
        return 5
    return 6 if len(token) == 1 else 7


_known: dict[str, int] = {}


def bucket(token: str) -> int:
    """Bucket of a token: its shape and a hash, the same on every machine."""
    found = _known.get(token)
    if found is None:
        if len(_known) > 300_000:
            _known.clear()
        each = BUCKETS // _SHAPES
        found = _known[token] = _shape(token) * each + zlib.crc32(token.lower().encode("utf-8", "replace")) % each
    return found


def buckets(text: str) -> np.ndarray:
    return np.array([bucket(t) for t in _TOKEN.findall(text)], np.int64)


def index_vectors(seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the ones in each bucket's index vector."""
    rng = np.random.default_rng(seed)
    places = np.array([rng.choice(DIMENSIONS, ONES, replace=False) for _ in range(BUCKETS)])
    signs = np.where(np.arange(ONES) % 2 == 0, 1, -1)
    return places, np.tile(signs, (BUCKETS, 1))


def learn_vectors(docs: DataFrame) -> np.ndarray:
    """Context and index vectors of all buckets, from the whole texts of all documents.

    A task counts neighbouring buckets' ones in one bounded table; tables are added up by
    bucket, and at most ``BUCKETS`` rows reach the driver.
    """
    source = docs.select(F.col("text").alias("text")).filter(F.col("text").isNotNull())

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places, signs = index_vectors()
        total = np.zeros(BUCKETS * DIMENSIONS)
        held: list[np.ndarray] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if not held:
                return
            b = np.concatenate(held)
            held.clear()
            size = 0
            for step in range(1, REACH + 1):
                for word, near in ((b[step:], b[:-step]), (b[:-step], b[step:])):
                    inside = (word >= 0) & (near >= 0)
                    w, c = word[inside] * DIMENSIONS, near[inside]
                    for j in range(ONES):
                        total[:] += np.bincount(w + places[c, j], weights=signs[c, j], minlength=len(total))

        for batch in batches:
            for text in batch["text"]:
                b = buckets(text)
                held.append(np.append(b, -1))
                size += len(b) + 1
                if size > _SLICE:
                    flush()
        flush()
        table = total.reshape(BUCKETS, DIMENSIONS).astype(np.int64)
        used = np.flatnonzero(table.any(axis=1))
        yield pd.DataFrame({"bucket": used.astype(np.int32), "sums": pd.Series(list(table[used]), dtype=object)})

    partial = source.mapInPandas(local, "bucket int, sums array<long>")
    added = partial.groupBy("bucket").agg(
        *[F.sum(F.element_at("sums", d + 1)).alias(f"s{d}") for d in range(DIMENSIONS)]).toPandas()
    context = np.zeros((BUCKETS, DIMENSIONS))
    if len(added):
        context[added["bucket"].to_numpy()] = added[[f"s{d}" for d in range(DIMENSIONS)]].to_numpy()
    length = np.linalg.norm(context, axis=1, keepdims=True)
    context /= np.where(length > 0, length, 1)
    own = np.zeros((BUCKETS, DIMENSIONS))
    places, signs = index_vectors()
    np.put_along_axis(own, places, signs / np.sqrt(ONES), axis=1)
    return np.hstack([context, own]).astype(np.float32)


def pooled(text: str | None, vectors: np.ndarray) -> np.ndarray:
    """Mean vector of a whole text, shares of token shapes, share of distinct tokens, log length."""
    b = buckets(text) if isinstance(text, str) else np.empty(0, np.int64)
    if not len(b):
        return np.zeros(vectors.shape[1] + _SHAPES + 2, np.float32)
    times = np.bincount(b, minlength=BUCKETS)
    used = np.flatnonzero(times)
    mean = (times[used] / len(b)) @ vectors[used]
    shapes = np.add.reduceat(times, np.arange(0, BUCKETS, BUCKETS // _SHAPES)) / len(b)
    return np.concatenate([mean, shapes, [len(used) / len(b) ** 0.5, np.log1p(len(b))]]).astype(np.float32)


def _forward(x: np.ndarray, n: Network) -> np.ndarray:
    z = (x - n.mean) / n.scale
    return np.maximum(z @ n.w1 + n.b1, 0) @ n.w2 + n.b2


def train(x: np.ndarray, y: np.ndarray, vectors: np.ndarray, hidden: int = 32, epochs: int = 60,
          seed: int = 5) -> Network:
    """Adam on the cross entropy, then one temperature on the fifth of rows held back."""
    rng = np.random.default_rng(seed)
    back = np.arange(len(x)) % 5 == 4
    if not back.any() or back.all():
        back = np.zeros(len(x), bool)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z, t = ((x - mean) / scale)[~back], y[~back].astype(float)
    p = [rng.normal(0, (2 / z.shape[1]) ** 0.5, (z.shape[1], hidden)), np.zeros(hidden),
         rng.normal(0, hidden ** -0.5, hidden), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(z))
        for at in range(0, len(z), 256):
            rows = order[at:at + 256]
            h = np.maximum(z[rows] @ p[0] + p[1], 0)
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - t[rows]) / len(rows)
            back_h = np.outer(d, p[2]) * (h > 0)
            grads = [z[rows].T @ back_h + 1e-4 * p[0], back_h.sum(axis=0), h.T @ d + 1e-4 * p[2], np.array([d.sum()])]
            step += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - 3e-3 * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.999 ** step)) + 1e-8)
    net = Network(vectors, mean, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
    if back.any():
        logits, truth = _forward(x[back], net), y[back]
        choices = np.geomspace(0.25, 8, 60)
        loss = [np.mean(np.logaddexp(0, np.where(truth == 1, -1, 1) * logits / c)) for c in choices]
        net = Network(vectors, mean, scale, p[0], p[1], p[2], float(p[3][0]), float(choices[int(np.argmin(loss))]))
    return net


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Network | float:
    """Vectors from all documents; the network from at most ``rows`` labelled ones.

    ``labels`` has ``doc_id`` and ``label`` of the rows that may be learned from; the sample
    is chosen by a hash of the id, and of an id on several rows one text is learned from.
    Without both labels the share of label 1 (or 0) is returned
    and every document gets it as its score.
    """
    known = labels.filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    vectors = learn_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["doc_id", "label", "place"]].assign(x=[pooled(t, shared.value) for t in batch["text"]])

    # one row per labelled id, the text with the smallest hash, so the bound holds for repeated ids
    table = (docs.select("doc_id", "text", F.xxhash64("text").alias("place")).join(F.broadcast(chosen), "doc_id")
             .mapInPandas(run, "doc_id long, label int, place long, x array<float>")
             .groupBy("doc_id", "label").agg(F.min(F.struct("place", "x"))["x"].alias("x"))
             .toPandas().sort_values("doc_id"))
    if not len(table) or table["label"].nunique() < 2:
        return float(table["label"].mean()) if len(table) else 0.0
    order = np.random.default_rng(3).permutation(len(table))
    return train(np.stack(table["x"].to_numpy())[order], table["label"].to_numpy()[order], vectors)


def score(docs: DataFrame, model: Network | float, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with ``score``, the calibrated probability of label 1.

    Null and empty texts pool to the zero vector and are scored as such; each row is scored
    on its own, so repeated rows agree.
    """
    if isinstance(model, float):
        return docs.select(*[F.col(c).alias(c) for c in keep], F.lit(model).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(texts: list[str | None]) -> list[list]:
        n = shared.value
        x = np.stack([pooled(t, n.vectors) for t in texts])
        return [1 / (1 + np.exp(-np.clip(_forward(x, n) / n.temperature, -60, 60)))]

    return map_texts(docs, keep, {"score": "double"}, make)
