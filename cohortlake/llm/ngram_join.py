"""Similarity join on word shingles through a token-group matrix.

Documents of equal shingle sets form a class. Classes that share frequent tokens form small
groups, and the matrix stores each group's union of tokens. A class opens a group only if
the tokens it shares with the union, by their places in one global order, leave room for
the overlap that the threshold asks for, and if the bit sketch of a member is near enough;
the members of opened groups are compared exactly.

Only the first tokens of a set in the global order (rare before frequent) can be decisive:
sets over the threshold share one of them. The order needs no exact counts, so the frequent
tokens come from a bounded list and all others count as rare.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.components import components
from cohortlake.llm.text import block_hashes, gram_hashes, many_word_hashes, pieces, signed
from cohortlake.session import materialise

#: bound of the list of frequent tokens, and the count in one batch of rows that makes a candidate
FREQUENT, LEAST_IN_BATCH = 1 << 16, 4
#: classes of one group, and queries that one task compares with a group
GROUP, SHARE = 48, 512
#: bits of the filter of texts that are read again, and of one of its rows (as powers of two)
FILTER_BITS, ROW_BITS = 26, 15
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_NO_ID = -(1 << 63)


def shingles(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Per text the distinct hashes of its runs of ``words`` words, ascending; of the whole if shorter."""
    out = []
    for found in many_word_hashes([(t or "").encode("utf-8", "replace").translate(_LOWER) for t in texts], block_hashes):
        n = len(found)
        out.append(np.unique(gram_hashes(found, words)) if n >= words
                   else gram_hashes(found, n) + np.uint64(n) if n else found)
    return out


def digest(tokens: np.ndarray) -> str:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).hexdigest()


def class_id(name: str) -> int:
    return int.from_bytes(bytes.fromhex(name[:16]), "big", signed=True)


def sketch(tokens: np.ndarray) -> bytes:
    """Parities of the tokens that fall on each bit; about one bit for each token.

    Two sketches differ in at most as many bits as the sets have tokens apart, and folding
    one in half keeps that true, so a difference over the threshold's proves a pair too far.
    """
    bits = max(256, 1 << (len(tokens) - 1).bit_length())
    counts = np.bincount((tokens % np.uint64(bits)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def _fold(bits: np.ndarray) -> np.ndarray:
    half = bits.shape[-1] // 2
    return bits[..., :half] ^ bits[..., half:]


def least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """Per row the size and digest of its set, and beside these the tokens frequent in a batch."""
    schema = "id long, key long, n long, name string, sketch binary, token long, times long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in pieces(batches):
            sets = shingles(list(batch["text"]), words)
            yield pd.DataFrame({"id": batch["id"], "key": batch["key"], "n": [len(s) for s in sets],
                                "name": [digest(s) if len(s) else None for s in sets],
                                "sketch": [sketch(s) if len(s) else None for s in sets], "token": 0, "times": 0})
            every = np.sort(np.concatenate(sets)) if sets else np.empty(0, np.uint64)
            if len(every):
                at = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
                times = np.diff(np.append(at, len(every)))
                often = times >= LEAST_IN_BATCH
                yield pd.DataFrame({"id": None, "key": None, "n": None, "name": None, "sketch": None,
                                    "token": signed(every[at[often]]), "times": times[often]})

    return docs.mapInPandas(run, schema)


def _first_tokens(docs: DataFrame, words: int, percent: int, often: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """The decisive tokens of each row's set: class, size, token, place in the order."""
    shared = docs.sparkSession.sparkContext.broadcast(often)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frequent, times = shared.value
        for batch in pieces(batches):
            out: list[tuple[np.ndarray, ...]] = []
            rows = 0
            for s in shingles(list(batch["text"]), words):
                n = len(s)
                if not n:
                    continue
                weight = np.zeros(n, np.int64)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                    weight = np.where(frequent[at] == s, times[at], 0)
                first = np.lexsort((s, weight))[:n - least_overlap(n, percent) + 1]
                m = len(first)
                out.append((np.full(m, class_id(digest(s))), np.full(m, n), signed(s[first]), np.arange(m)))
                rows += m
                if rows > 50_000:
                    yield pd.DataFrame({k: np.concatenate(c) for k, c in zip(("cls", "n", "token", "place"), zip(*out))})
                    out, rows = [], 0
            if out:
                yield pd.DataFrame({k: np.concatenate(c) for k, c in zip(("cls", "n", "token", "place"), zip(*out))})

    return docs.mapInPandas(run, "cls long, n int, token long, place int")


def _bounded(rows: DataFrame, percent: int) -> DataFrame:
    """The opened groups that hold a member within the sketches' bound of the query."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, levels = None, [], {}
        for batch in batches:
            kept: list[tuple[int, int]] = []
            for gid, share, query, cls, n, raw in zip(batch["gid"], batch["share"], batch["query"], batch["cls"],
                                                      batch["n"], batch["sketch"]):
                own = np.frombuffer(raw, np.uint8)
                if (gid, share) != at:
                    at, held, levels = (gid, share), [], {}
                if not query:
                    held.append((cls, n, own))
                    continue
                if not levels:
                    # sizes within the threshold differ by one level at most
                    for member, size, bits in held:
                        levels.setdefault((len(bits), False), []).append((member, size, bits))
                        levels.setdefault((len(bits) // 2, True), []).append((member, size, _fold(bits)))
                    levels = {k: (np.array([m for m, _, _ in v]), np.array([c for _, c, _ in v]),
                                  np.stack([b for _, _, b in v])) for k, v in levels.items()}
                for level, bits in (((len(own), False), own), ((len(own), True), own),
                                    ((len(own) // 2, False), _fold(own))):
                    if level not in levels:
                        continue
                    members, sizes, table = levels[level]
                    apart = np.bitwise_count(table ^ bits).sum(axis=1, dtype=np.int64)
                    if np.any((members != cls) & (apart * (100 + percent) <= (sizes + n) * (100 - percent))):
                        kept.append((cls, gid))
                        break
            if kept:
                yield pd.DataFrame(kept, columns=["cls", "gid"])

    return rows.mapInPandas(run, "cls long, gid long")


def _meet(opened: DataFrame, groups: DataFrame, values: DataFrame) -> DataFrame:
    """Queries and members of opened groups with their values, a bounded share of queries at a time.

    The members of a group are few, and are repeated for every share of its queries.
    """
    load = opened.groupBy("gid").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares"))
    asked = opened.join(load, "gid").select(
        "cls", "gid", F.pmod(F.xxhash64("cls"), F.col("shares")).cast("int").alias("share"),
        F.lit(True).alias("query"))
    held = groups.join(load, "gid").select(
        "cls", "gid", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"),
        F.lit(False).alias("query"))
    return asked.union(held).join(values, "cls").repartition("gid", "share").sortWithinPartitions(
        "gid", "share", "query")


class _Forest:
    """Which of a task's links join what its earlier links have not joined yet."""

    def __init__(self, nodes: int = 200_000):
        self.root: dict[str, str] = {}
        self.nodes = nodes

    def find(self, x: str) -> str:
        root = self.root
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def joins(self, a: str, b: str) -> bool:
        if len(self.root) > self.nodes:
            # forgetting costs repeated links, nothing else
            self.root.clear()
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.root[max(a, b)] = min(a, b)
        return True


def _compare(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between the queries and the members that meet under one group and share.

    Texts meet, and their sets are made here: hashes are larger and cannot be compressed.

    Components need no more than a spanning forest, so a task leaves out the links between
    classes that it has joined already.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest = _Forest()
        at, names, sizes, tokens, owners, built = None, [], [], [], [], False
        flat = owner = size = np.empty(0)
        for batch in pieces(batches, 256):
            links: list[tuple[str, str]] = []
            for key, query, name, own in zip(zip(batch["gid"], batch["share"]), batch["query"], batch["name"],
                                             shingles(list(batch["text"]), words)):
                if key != at:
                    at, names, sizes, tokens, built = key, [], [], [], False
                if not query:
                    names.append(name)
                    sizes.append(len(own))
                    tokens.append(own)
                    continue
                if not built:
                    if not names:
                        continue
                    flat = np.concatenate(tokens)
                    order = np.argsort(flat, kind="stable")
                    owner = np.repeat(np.arange(len(names)), sizes)[order]
                    flat, size, built = flat[order], np.array(sizes), True
                low, high = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
                held = high - low
                # the overlap with the group's union bounds the overlap with any member
                if np.count_nonzero(held) < least_overlap(len(own), percent):
                    continue
                low, held = low[held > 0], held[held > 0]
                place = np.repeat(low - np.append(0, np.cumsum(held)[:-1]), held) + np.arange(held.sum())
                both = np.bincount(owner[place], minlength=len(names))
                near = np.flatnonzero(100 * both >= percent * (size + len(own) - both))
                links.extend((name, names[k]) for k in near if names[k] != name and forest.joins(name, names[k]))
            if links:
                yield pd.DataFrame(links, columns=["a", "b"])

    return rows.mapInPandas(run, "a string, b string")


def _admitted(source: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of ``source`` whose ``key`` may be in ``chosen``, so that the other texts are not shuffled.

    The filter has a fixed size and is broadcast; a key that it admits in vain finds no partner later.
    """
    at = F.col("key").bitwiseAND((1 << FILTER_BITS) - 1)
    slot, place = F.shiftright(at, ROW_BITS).alias("slot"), at.bitwiseAND((1 << ROW_BITS) - 1).alias("place")
    bits = chosen.select(slot, place).repartition("slot").groupBy("slot").agg(F.bitmap_construct_agg("place").alias("bits"))
    marked = source.select("*", slot, place.cast("int").alias("place")).join(F.broadcast(bits), "slot")
    byte = F.conv(F.hex(F.expr("substring(bits, place div 8 + 1, 1)")), 16, 10).cast("bigint")
    return marked.filter(F.bit_get(byte, F.expr("place % 8")) == 1).select(*source.columns)


def join(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row, by exact Jaccard similarity.

    Two sets link when 100 * intersection >= ``percent`` * union. A row without words (null,
    empty or blank text) has 0 shingles, links with nothing and is its own component. Equal
    sets link, so repeated rows and rows that repeat an id are one component; ``component_id``
    is the smallest id in it, null only if none of its rows has one. ``percent`` is above 50
    and at most 100: the bound by sketches compares sizes that differ by less than half.
    """
    if not 50 < percent <= 100:
        raise ValueError(f"percent must be above 50 and at most 100, not {percent}")
    # rows without an id carry a number that no id has, as a null would turn ids into floats
    source = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), F.col("text").alias("text"),
                         F.xxhash64("text").alias("key"))
    both = materialise(_sets(source, words))
    rows = both.filter("n is not null").select("id", "key", "n", "name", "sketch")
    often = (both.filter("n is null").groupBy("token").agg(F.sum("times").alias("times"))
             .orderBy(F.desc("times"), "token").limit(FREQUENT).collect())
    frequent = np.array([r["token"] for r in often], np.int64).view(np.uint64)
    order = np.argsort(frequent)
    counts = np.array([r["times"] for r in often], np.int64)

    # tokens that decide for one row only lead nowhere
    first = _first_tokens(source, words, percent, (frequent[order], counts[order]))
    repeated = materialise(first.groupBy("token").count().filter("count > 1").select("token"))
    shared = materialise(first.join(repeated, "token").distinct())
    df = materialise(shared.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1"))
    live = materialise(shared.join(df, "token"))

    # a group: classes with the same most frequent decisive token, cut by their id
    best = live.groupBy("cls").agg(F.max(F.struct("df", "token")).alias("best")).select("cls", "best.token")
    heads = best.groupBy(F.col("token")).agg(F.count("*").alias("members"))
    groups = materialise(best.join(heads, "token").select("cls", F.xxhash64(
        "token", F.pmod("cls", F.ceil(F.col("members") / GROUP))).alias("gid")))
    placed = materialise(live.join(groups, "cls"))
    matrix = placed.groupBy("token", "gid").agg(
        F.max(F.col("n") - F.col("place")).alias("room"), F.min("n").alias("low"), F.max("n").alias("high"),
        F.count("*").alias("members"), F.min("cls").alias("one"))
    query = placed.select("cls", F.col("gid").alias("home"), "token", F.col("n").alias("size"), "place")
    need = F.greatest(F.col("size") * percent, F.col("low") * percent) / 100.0
    need = F.greatest(need, (F.col("size") + F.col("low")) * percent / (100.0 + percent))
    opened = materialise(query.join(matrix.withColumnRenamed("token", "key"), (
        (F.col("token") == F.col("key")) & (F.col("home") <= F.col("gid"))
        & ((F.col("members") > 1) | (F.col("one") != F.col("cls")))
        & (F.least(F.col("size") - F.col("place"), F.col("room")) >= need - 1e-6)
        & (100 * F.col("high") >= percent * F.col("size")) & (percent * F.col("low") <= 100 * F.col("size"))
    )).select("cls", "gid").distinct())

    # one row answers for its class: of its rows the one with the smallest id and text
    names = materialise(rows.filter("n > 0").groupBy("name").agg(
        F.min(F.struct("id", "key")).alias("own"), F.min(F.when(F.col("id") != _NO_ID, F.col("id"))).alias("least_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"),
    ).select("*", "own.*", F.conv(F.substring("name", 1, 16), 16, -10).cast("long").alias("cls")).drop("own"))
    opened = materialise(_bounded(_meet(opened, groups, names.select("cls", "n", "sketch")), percent).distinct())

    # texts are read again for the classes that take part, by id and text: an id may be missing or repeated
    wanted = opened.select("cls").union(groups.join(opened.select("gid").distinct(), "gid").select("cls")).distinct()
    times = rows.filter("n > 0").groupBy("id", "key").agg(F.count("*").alias("times")).filter("times > 1")
    chosen = materialise(names.join(wanted, "cls").select("id", "key", "name", "cls").join(
        times, ["id", "key"], "left").fillna(1, ["times"]))
    texts = _admitted(source, chosen).join(chosen, ["id", "key"])

    def own_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in pieces(batches, 256):
            yield part[[digest(s) == name for s, name in zip(shingles(list(part["text"]), words), part["name"])]]

    read = materialise(texts.select("cls", "name", "times", "text").mapInPandas(
        own_texts, "cls long, name string, times long, text string"))
    # a row that stands several times is read several times and kept once
    read = read.filter("times = 1").union(read.filter("times > 1").dropDuplicates(["cls"])).drop("times")
    # written, as the components read both directions of a link
    links = materialise(_compare(_meet(opened, groups, read), words, percent))

    linked = components(links)
    smallest = names.join(linked.withColumnRenamed("node", "name"), "name", "left").select(
        "name", F.coalesce("component", "name").alias("component"), "least_id")
    heads = smallest.groupBy("component").agg(F.min("least_id").alias("head"))
    named = materialise(smallest.join(heads, "component").select("name", "head"))
    id_ = F.when(F.col("id") != _NO_ID, F.col("id"))
    return rows.join(named, "name", "left").select(
        id_.alias("doc_id"), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("head")).otherwise(id_).alias("component_id"))
