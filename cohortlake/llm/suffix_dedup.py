"""Substring deduplication with a sparse suffix array.

Suffixes are kept at anchors, places that the content selects, and only where another
document holds the same anchor. They are sorted by the words to the right and then by the
words to the left, range by range, so a passage that many documents share is cut into
several ranges. Neighbours are compared and their match is extended to both sides; a match
of ``least`` words or more is a repeated passage.

The neighbour with the longest match to the right need not have the longest to the left, so
a suffix is compared with several before it; these are the partners of a passage. They cannot
tell every passage, nor who holds it first, so each run of ``least`` words whose anchor is
shared also carries its hash to an aggregate that knows the smallest and the largest id that
hold it. Spans and copies are exact by these, up to hashes of 64 bits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.anchors import chosen, repeated
from cohortlake.llm.text import block_hashes, gram_hashes, many_word_hashes, pieces, signed
from cohortlake.session import materialise

#: words of an anchor, and neighbours before a suffix that it is compared with
ANCHOR, BACK = 10, 6
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_ORDER = ("right", "left", "id", "text_key", "place")


def _suffixes(docs: DataFrame, least: int) -> DataFrame:
    """One row per shared anchor of a text: the words after it and, backwards, those before it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in pieces(batches, 256):
            anchors = chosen(list(part["text"]), ANCHOR, least)
            out = []
            for id_, key, text, held, (_, places, _) in zip(
                    part["id"], part["text_key"], part["text"], part["places"], anchors):
                words = _WORD.findall(text)
                # rows that repeat an id bring places of one another
                for place in np.intersect1d(held, places).tolist():
                    out.append((id_, key, place, " ".join(words[place:place + least]),
                                " ".join(words[max(0, place - least):place][::-1])))
            if out:
                yield pd.DataFrame(out, columns=["id", "text_key", "place", "right", "left"])

    return docs.mapInPandas(run, "id long, text_key long, place int, right string, left string")


def _runs(docs: DataFrame, least: int, placed: bool) -> DataFrame:
    """Hashes of the runs of ``least`` words of a text whose anchor is shared, with their places."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in pieces(batches, 256):
            texts, out = list(part["text"]), []
            hashed = many_word_hashes([t.encode("utf-8", "replace") for t in texts], block_hashes)
            for id_, key, held, found, (_, places, of_run) in zip(
                    part["id"], part["text_key"], part["places"], hashed, chosen(texts, ANCHOR, least)):
                at = np.flatnonzero(np.isin(places, held)[of_run])
                if not len(at):
                    continue
                hashes = signed(gram_hashes(found, least)[at])
                hashes = hashes if placed else np.unique(hashes)
                n = len(hashes)
                out.append((hashes, np.full(n, id_), np.full(n, key), at.astype(np.int32))[:4 if placed else 2])
            if out:
                yield pd.DataFrame(dict(zip(("run", "id", "text_key", "place"), map(np.concatenate, zip(*out)))))

    return docs.mapInPandas(run, "run long, id long" + (", text_key long, place int" if placed else ""))


def _held_runs(docs: DataFrame, least: int) -> DataFrame:
    """Spans of the runs that another id holds: once with the smallest such id if it is smaller
    than the own one, and once with the largest if it is larger.

    Holders are counted by a partial aggregate, so a passage that many documents hold is one
    record of a task for each of its runs.
    """
    ends = materialise(_runs(docs, least, False).groupBy("run").agg(
        F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last"))
    met = _runs(docs, least, True).join(ends, "run")
    listed = met.groupBy("id", "text_key").agg(F.collect_list(F.struct("place", "first", "last")).alias("runs")).select(
        "id", "text_key", "runs.place", "runs.first", "runs.last")

    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for id_, key, place, first, last in zip(
                    batch["id"], batch["text_key"], batch["place"], batch["first"], batch["last"]):
                order = np.argsort(place, kind="stable")
                for partner, wanted in ((first[order], first[order] < id_), (last[order], last[order] > id_)):
                    at, of = place[order][wanted], partner[wanted]
                    if not len(at):
                        continue
                    cut = np.flatnonzero((at[1:] - at[:-1] > 1) | (of[1:] != of[:-1])) + 1
                    low, high = np.append(0, cut), np.append(cut, len(at)) - 1
                    out.extend((id_, key, int(a), int(b) + least, int(c)) for a, b, c in zip(at[low], at[high], of[low]))
            if out:
                yield pd.DataFrame(out, columns=["id", "text_key", "place", "end", "partner"])

    return listed.mapInPandas(spans, "id long, text_key long, place int, end int, partner long")


def common(a: str, b: str) -> int:
    """Leading words that two word lists share."""
    if a == b:
        return a.count(" ") + 1 if a else 0
    n = 0
    for x, y in zip(a.split(" "), b.split(" ")):
        if x != y or not x:
            break
        n += 1
    return n


def _match(a: tuple, b: tuple, least: int) -> tuple[int, int] | None:
    """Words shared to the right and left of two suffixes, if they are ``least`` or more together."""
    right = common(a[3], b[3])
    if not right:
        return None
    left = common(a[4], b[4])
    return (right, left) if right + left >= least and a[0] != b[0] else None


def _pairs(s: tuple, before: list[tuple], least: int) -> Iterator[tuple]:
    """Spans that a suffix and its neighbours before it hold in common, for both of them.

    The nearest comes first; a neighbour farther off counts only for what it adds.
    """
    most_right = most_left = 0
    for other in reversed(before):
        m = _match(other, s, least)
        if m and (m[0] > most_right or m[1] > most_left):
            most_right, most_left = max(most_right, m[0]), max(most_left, m[1])
            for x, y in ((s, other), (other, s)):
                yield x[0], x[1], x[2] - m[1], x[2] + m[0], y[0]


def _neighbours(suffixes: DataFrame, least: int) -> DataFrame:
    """Matches of neighbours within a range, and the first and last suffixes of the range."""
    columns = ["id", "text_key", "place", "end", "partner", "part", "edge", "right", "left"]

    def edge(s: tuple, part: int, at: int) -> tuple:
        return (s[0], s[1], s[2], None, None, part, at, s[3], s[4])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, before, n = TaskContext.get().partitionId(), [], 0
        for batch in batches:
            out = []
            for s in zip(batch["id"], batch["text_key"], batch["place"], batch["right"], batch["left"]):
                if before and s[:3] == before[-1][:3]:
                    # a repeated row
                    continue
                if n < BACK:
                    out.append(edge(s, part, n))
                out.extend((*found, None, None, None, None) for found in _pairs(s, before, least))
                before = [*before[1 - BACK:], s]
                n += 1
            if out:
                yield pd.DataFrame(out, columns=columns, dtype=object)
        if n > BACK:
            first = max(BACK, n - len(before))
            yield pd.DataFrame([edge(s, part, first + i) for i, s in enumerate(before[first - n:])], columns=columns, dtype=object)

    return suffixes.mapInPandas(run, (
        "id long, text_key long, place int, end int, partner long, part int, edge long, right string, left string"))


def _across(edges: list, least: int) -> list[tuple]:
    """Matches over the borders of ranges, from a few suffixes at each end of a range."""
    out: list[tuple] = []
    before: list[tuple] = []
    part = None
    for r in sorted(edges, key=lambda r: (r["part"], r["edge"])):
        s = (r["id"], r["text_key"], r["place"], r["right"], r["left"])
        if r["part"] != part:
            part, earlier = r["part"], before
        if earlier and r["edge"] < BACK:
            out.extend(_pairs(s, earlier[r["edge"] - BACK:], least))
        before = [*before[1 - BACK:], s]
    return out


def repeated_passages(docs: DataFrame, least: int = 50) -> DataFrame:
    """Passages of ``least`` or more words that another document holds.

    One row per document text and maximal passage: ``doc_id``, ``text_key`` (hash of the text),
    ``first_word``, ``end_word``, ``partners`` (ids of neighbours that hold a part of it, the
    smallest id that does or the largest) and ``is_copy``: every run of ``least`` words of it
    stands in a document with a smaller id, otherwise in one with a larger id. Null, empty and shorter
    texts have no passage; rows that repeat an id are not compared with one another; rows
    without an id are left out.
    """
    source = docs.filter("doc_id is not null and text is not null").select(
        F.col("doc_id").cast("long").alias("id"), F.col("text").alias("text"))
    held = repeated(source, ANCHOR, least).select("id", "text_key", "places")
    held = materialise(source.withColumn("text_key", F.xxhash64("text")).join(held, ["id", "text_key"]))
    suffixes = materialise(_suffixes(held, least))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = suffixes.repartitionByRange(parts, *_ORDER).sortWithinPartitions(*_ORDER)
    met = materialise(_neighbours(ranged, least))
    # a few rows for each range
    edges = met.filter("edge is not null").collect()
    schema = "id long, text_key long, place int, end int, partner long"
    spans = met.filter("edge is null").select("id", "text_key", "place", "end", "partner").union(
        docs.sparkSession.createDataFrame(_across(edges, least), schema)).union(_held_runs(held, least))
    listed = spans.groupBy("id", "text_key").agg(F.collect_set(F.struct(
        "place", "end", "partner", (F.col("partner") < F.col("id")).alias("copy"))).alias("spans"))

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for id_, key, found in zip(batch["id"], batch["text_key"], batch["spans"]):
                at = None
                # copies and first places are merged apart, so that each can be removed alone
                for copy in (False, True):
                    own = sorted((s["place"], s["end"], s["partner"]) for s in found if s["copy"] == copy)
                    at = None
                    for place, end, partner in own:
                        if at is not None and place <= at[1]:
                            at[1] = max(at[1], end)
                            at[2].add(partner)
                        else:
                            if at is not None:
                                out.append((id_, key, at[0], at[1], sorted(at[2]), copy))
                            at = [place, end, {partner}]
                    if at is not None:
                        out.append((id_, key, at[0], at[1], sorted(at[2]), copy))
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "text_key", "first_word", "end_word", "partners", "is_copy"])

    return listed.mapInPandas(
        merge, "doc_id long, text_key long, first_word int, end_word int, partners array<long>, is_copy boolean")


def deduplicated(docs: DataFrame, least: int = 50) -> DataFrame:
    """``doc_id`` and the ``kept`` text of every row: words of copied passages are removed.

    Kept words are joined by one space; texts without a copied passage stay as they are.
    """
    spans = repeated_passages(docs, least).filter("is_copy").groupBy(
        F.col("doc_id").alias("id"), "text_key").agg(F.collect_list(F.struct("first_word", "end_word")).alias("spans"))
    source = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("text"),
                         F.xxhash64("text").alias("text_key"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    numbered = F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    kept = F.filter(numbered, lambda n: ~F.exists(
        "spans", lambda s: (n["i"] >= s["first_word"]) & (n["i"] < s["end_word"])))
    return source.join(spans, ["id", "text_key"], "left").select(
        F.col("id").alias("doc_id"), F.when(F.col("spans").isNull(), F.col("text")).otherwise(
            F.array_join(F.transform(kept, lambda n: n["w"]), " ")).alias("kept"))
