"""Near-duplicate embeddings through robust-pruned graphs on overlapping cluster shards.

Equal vectors form a class, and one vector of each class is searched. Every class goes to
its nearest centres, so shards overlap; a graph is built on each shard, pruned so that the
kept neighbours lie in different directions, and the lists of a class over all its shards
are united. A search walks greedily from a few medoids towards the query and then widens
over everything within a margin of the threshold. It starts from a few medoids, the query's
own node and one node of every connected part of a block. Found pairs are verified in double
precision. Recall is audited against brute force on a sample of queries that has seen enough
true links. Where it is low, blocks are compared exactly, the overlap is raised, and in the
end all classes are compared with all.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.components import components
from cohortlake.session import materialise

#: classes for each centre, most centres, and vectors that the centres are fitted on
PER_CENTRE, CENTRES, SAMPLE = 1_000, 1_024, 16_384
#: members of one graph, queries of one task, neighbours before and after pruning
BLOCK, SHARE, NEAR, KEPT = 4_096, 4_096, 48, 24
#: medoids that a search starts from, nodes that it holds, and margin of the widening
MEDOIDS, BEAM, MARGIN = 24, 32, 0.04
#: audited queries of the first and of a later round, true links that an audit must see, and the recall it asks for
AUDIT, AUDIT_MORE, SEEN, RECALL = 256, 4_096, 64, 0.97


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def fit_centres(x: np.ndarray, n: int, rounds: int = 6, seed: int = 3) -> np.ndarray:
    """Spherical k-means on a bounded sample of unit vectors."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(n, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        length = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(length > 0, total / np.where(length > 0, length, 1), c)
    return c


def build(x: np.ndarray, alpha: float = 1.2) -> list[np.ndarray]:
    """Neighbours of each unit vector: the nearest, less those that a kept one stands for."""
    n = len(x)
    k = min(NEAR, n - 1)
    out: list[np.ndarray] = []
    for at in range(0, n, 1024):
        sims = x[at:at + 1024] @ x.T
        sims[np.arange(len(sims)), np.arange(at, at + len(sims))] = -2
        for row in sims:
            near = np.argpartition(-row, k - 1)[:k] if k else np.empty(0, np.int64)
            near = near[np.argsort(-row[near], kind="stable")]
            kept: list[int] = []
            apart = 1 - row[near]
            between = 1 - x[near] @ x[near].T
            alive = np.ones(len(near), bool)
            for i in range(len(near)):
                if alive[i]:
                    kept.append(int(near[i]))
                    if len(kept) == KEPT:
                        break
                    alive &= alpha * between[i] > apart
            out.append(np.array(kept, np.int64))
    return out


def both_ways(lists: list[np.ndarray]) -> list[np.ndarray]:
    back: list[list[int]] = [[] for _ in lists]
    for i, near in enumerate(lists):
        for j in near:
            back[j].append(i)
    return [np.unique(np.concatenate([near, np.array(b, np.int64)])) for near, b in zip(lists, back)]


def medoids(x: np.ndarray) -> np.ndarray:
    """The vector nearest to the mean, then the ones farthest from those chosen."""
    chosen = [int(np.argmax(x @ x.mean(axis=0)))]
    nearest = x @ x[chosen[0]]
    while len(chosen) < min(MEDOIDS, len(x)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, x @ x[chosen[-1]])
    return np.array(chosen)


def entries(lists: list[np.ndarray]) -> np.ndarray:
    """One node of every connected part of a graph."""
    seen, first = np.zeros(len(lists), bool), []
    for i in range(len(lists)):
        if not seen[i]:
            first.append(i)
            seen[i] = True
            front = [i]
            while front:
                near = lists[front.pop()]
                near = near[~seen[near]]
                seen[near] = True
                front.extend(near.tolist())
    return np.array(first, np.int64)


def search(q: np.ndarray, x: np.ndarray, lists: list[np.ndarray], starts: np.ndarray, least: float) -> np.ndarray:
    """Nodes with a similarity over ``least`` less the margin, by greedy walk and widening."""
    seen = np.zeros(len(x), bool)
    seen[starts] = True
    sims = x[starts] @ q
    best = heapq.nlargest(BEAM, zip(sims.tolist(), starts.tolist()))
    frontier = [(-s, i) for s, i in best]
    held = [s for s, _ in best]
    heapq.heapify(frontier)
    heapq.heapify(held)
    close = [i for s, i in zip(sims, starts) if s >= least - MARGIN]
    while frontier:
        s, i = heapq.heappop(frontier)
        # beyond the beam only what lies within the margin is widened
        if -s < held[0] and len(held) >= BEAM and -s < least - MARGIN:
            break
        near = lists[i]
        near = near[~seen[near]]
        if not len(near):
            continue
        seen[near] = True
        for v, j in zip((x[near] @ q).tolist(), near.tolist()):
            if v >= least - MARGIN:
                close.append(j)
            if len(held) < BEAM or v > held[0] or v >= least - MARGIN:
                heapq.heappush(frontier, (-v, j))
                heapq.heappush(held, v)
                if len(held) > BEAM:
                    heapq.heappop(held)
    return np.array(close, np.int64)


def _graphs(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, x in _blocks(batches, ["shard", "block"]):
            lists = both_ways(build(unit(x)))
            yield pd.DataFrame({"id": ids, "near": pd.Series([ids[n] for n in lists], dtype=object)})

    return rows.mapInPandas(run, "id long, near array<long>")


def _blocks(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The ids and vectors of each block of bounded size, from rows sorted by the keys."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        for _, part in batch.groupby(keys, sort=False):
            if held and tuple(held[0][keys].iloc[0]) != tuple(part[keys].iloc[0]):
                whole = pd.concat(held)
                yield whole["id"].to_numpy(), np.stack(whole["vec"].to_numpy()).astype(float)
                held = []
            held.append(part)
    if held:
        whole = pd.concat(held)
        yield whole["id"].to_numpy(), np.stack(whole["vec"].to_numpy()).astype(float)


def _searches(rows: DataFrame, least: float, exact: bool) -> DataFrame:
    """Verified links between the queries and the members of each block, searched or all compared."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, members, ready = None, [], None
        for batch in batches:
            links = []
            for key, query, id_, vec, near in zip(zip(batch["shard"], batch["block"], batch["share"]), batch["query"],
                                                  batch["id"], batch["vec"], batch["near"]):
                if key != at:
                    at, members, ready = key, [], None
                if not query:
                    members.append((id_, vec, near))
                    continue
                if ready is None:
                    ids = np.array([m[0] for m in members])
                    full = np.stack([m[1] for m in members]).astype(float)
                    order = np.argsort(ids)
                    lists = []
                    for m in members:
                        place = np.minimum(np.searchsorted(ids, m[2], sorter=order), len(ids) - 1)
                        lists.append(order[place[ids[order[place]] == m[2]]])
                    x = unit(full)
                    starts = None if exact else np.union1d(medoids(x), entries(lists))
                    ready = ids, order, full, np.linalg.norm(full, axis=1), x, lists, starts
                ids, order, full, length, x, lists, starts = ready
                vec = vec.astype(float)
                norm = np.linalg.norm(vec)
                if exact:
                    found = np.flatnonzero(x @ (vec / norm) >= least - MARGIN)
                else:
                    own = order[min(np.searchsorted(ids, id_, sorter=order), len(ids) - 1)]
                    found = search(vec / norm, x, lists, np.union1d(starts, [own]), least)
                found = found[ids[found] != id_]
                cosine = full[found] @ vec / (length[found] * norm)
                links.extend((min(id_, j), max(id_, j)) for j in ids[found[cosine >= least]].tolist())
            if links:
                yield pd.DataFrame(links, columns=["a", "b"])

    return rows.mapInPandas(run, "a long, b long")


def _links(classes: DataFrame, centres: np.ndarray, overlap: int, least: float, exact: bool) -> DataFrame:
    shared = classes.sparkSession.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        for batch in batches:
            if len(batch):
                sims = unit(np.stack(batch["vec"].to_numpy()).astype(float)) @ c.T
                near = np.argsort(-sims, axis=1, kind="stable")[:, :overlap]
                yield batch.assign(shards=list(near.astype(np.int32)))

    placed = materialise(classes.mapInPandas(assign, "id long, vec array<double>, shards array<int>").select(
        "id", "vec", F.explode("shards").alias("shard")))
    load = materialise(placed.groupBy("shard").agg(
        F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.ceil(F.count("*") / SHARE).cast("int").alias("shares")))
    sized = placed.join(load, "shard").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # enough partitions that a shard is one task's work, as a shard weighs far more than a row
    parts = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(len(centres), 512))
    none = F.array().cast("array<long>")
    if exact:
        listed = sized.withColumn("near", none)
    else:
        graphs = _graphs(sized.select("shard", "block", "id", "vec").repartition(parts, "shard", "block")
                         .sortWithinPartitions("shard", "block"))
        listed = sized.join(materialise(graphs.groupBy("id").agg(
            F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))), "id")
    held = listed.select(
        "shard", "block", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"),
        F.lit(False).alias("query"), "id", "vec", "near")
    asked = sized.select(
        "shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.pmod(F.xxhash64("id", F.lit("share")), F.col("shares")).cast("int").alias("share"),
        F.lit(True).alias("query"), "id", "vec", none.alias("near"))
    met = held.union(asked).repartition(parts, "shard", "block", "share").sortWithinPartitions(
        "shard", "block", "share", "query")
    return materialise(_searches(met, least, exact).distinct())


def _audit(classes: DataFrame, n: int, links: DataFrame, least: float) -> float:
    """Share of the true links of a sample of classes that were found.

    Further classes are audited until the sample has ``SEEN`` true links, or all are.
    """
    slices = -(-n // AUDIT)
    mine = F.pmod(F.xxhash64("id"), F.lit(slices))
    at, step, true, hit = 0, 1, 0, 0
    while at < slices and true < SEEN:
        marked = _audited(classes, classes.filter((mine >= at) & (mine < at + step)), links, least)
        true, hit = true + marked[0], hit + marked[1]
        at, step = at + step, min(2 * step, AUDIT_MORE // AUDIT)
    return hit / true if true else 1.0


def _audited(classes: DataFrame, chosen: DataFrame, links: DataFrame, least: float) -> tuple[int, int]:
    """True links of the chosen classes with all classes, and how many of them were found."""
    sample = chosen.toPandas()
    if not len(sample):
        return 0, 0
    ids, q = sample["id"].to_numpy(), np.stack(sample["vec"].to_numpy())
    shared = classes.sparkSession.sparkContext.broadcast((ids, unit(q)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = shared.value
        for batch in batches:
            own = batch["id"].to_numpy()
            if len(own):
                row, column = np.nonzero(unit(np.stack(batch["vec"].to_numpy())) @ q.T >= least)
                a, b = own[row], ids[column]
                yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})[a != b]

    true = classes.mapInPandas(run, "a long, b long").distinct()
    marked = true.join(links.withColumn("hit", F.lit(1)), ["a", "b"], "left").agg(
        F.count("*").alias("n"), F.count("hit").alias("hit")).first()
    return marked["n"], marked["hit"]


def near_duplicates(vectors: DataFrame, least: float = 0.95) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` and the audited ``recall`` of every row.

    Vectors link if their cosine is ``least`` or more; labels play no part. Null, zero and
    empty vectors and those with null or non-finite parts link with nothing, and vectors of
    different length never link. Equal vectors always link, repeated rows included. A row
    without an id counts as a vector; its component is that of its links, null if it has none.
    """
    spark = vectors.sparkSession
    none = -(1 << 63)
    rows = vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(none)).alias("vec_id"),
                          F.transform("embedding", lambda v: v.cast("double")).alias("vec"))
    # equal vectors are one class, known by its digest; unsound vectors have none
    sound = F.col("vec").isNotNull() & (F.size("vec") > 0) & ~F.exists(
        "vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("vec", lambda v: v != 0)
    rows = rows.withColumn("name", F.when(
        sound, F.sha2(F.concat_ws(",", F.transform("vec", lambda v: (v + 0.0).cast("string"))), 256)))
    keyed = rows.filter("name is not null")
    classes = materialise(keyed.groupBy("name").agg(F.count("*").alias("n"), F.min(F.when(F.col("vec_id") != none, F.col("vec_id"))).alias("least_id"),
                                                    F.first("vec").alias("vec"))
                          .withColumn("id", F.monotonically_increasing_id()))
    pairs = None
    recall = 1.0
    for row in classes.groupBy(F.size("vec").alias("size")).count().orderBy("size").collect():
        own = classes.filter(F.size("vec") == row["size"]).select("id", "vec")
        if row["count"] < 2:
            continue
        sample = own.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()
        n = max(1, min(CENTRES, -(-row["count"] // PER_CENTRE)))
        centres = fit_centres(unit(np.stack(sample["vec"].to_numpy())), n)
        overlap, exact = min(3, len(centres)), False
        while True:
            links = _links(own, centres, overlap, least, exact)
            found = _audit(own, row["count"], links, least)
            # one shard of all classes, compared exactly, has every link
            if found >= RECALL or (exact and len(centres) == 1):
                break
            overlap, exact = 2 * overlap if exact else overlap, True
            if overlap >= len(centres):
                centres, overlap = centres[:1], 1
        recall = min(recall, found)
        pairs = links if pairs is None else pairs.union(links)
    if pairs is None:
        pairs = spark.createDataFrame([], "a long, b long")
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sizes = classes.select(F.col("id").alias("b"), "n")
    degree = both.join(sizes, "b").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("others"))
    member = components(pairs).withColumnRenamed("node", "id")
    known = classes.join(member, "id", "left").join(degree, "id", "left").select(
        "name", "n", "least_id", F.coalesce("component", "id").alias("component"), F.coalesce("others", F.lit(0)).alias("others"))
    heads = known.groupBy("component").agg(F.min("least_id").alias("head"))
    answer = materialise(known.join(heads, "component").select(
        "name", (F.col("others") + F.col("n") - 1).alias("n_links"), "head"))
    id_ = F.when(F.col("vec_id") != none, F.col("vec_id"))
    out = rows.join(answer, "name", "left").select(
        id_.alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce(F.col("head"), id_).alias("component_id"), F.lit(recall).alias("recall"))
    return out.select("vec_id", "n_links", "component_id",
                      F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"), "recall")
