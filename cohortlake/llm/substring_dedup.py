"""Substring deduplication with suffix automata of reference shards.

Anchors tell which runs of words another document may hold, and the first document that
holds each anchor. A reference shard is what such a first document may share; its suffix
automaton is sent to the tasks that hold the documents to be compared with it, and these
are streamed for their matching statistics. Runs that the shard of their anchor lacks can
still be repeated elsewhere; they are few and are settled by their words.

The whole corpus is the reference, so its automata cannot be one broadcast of bounded size:
a shard goes to the tasks whose documents share an anchor with it, and is repeated for
every share of a bounded number of words to be matched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.anchors import chosen, repeated
from cohortlake.llm.text import pieces
from cohortlake.session import materialise

#: words of an anchor; words that one task streams past a shard; words of one automaton
ANCHOR, SHARE, SHARD = 5, 100_000, 100_000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


class SuffixAutomaton:
    """All runs of words of the texts added, each text ended by a mark of its own."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.last, self.texts = [-1], [0], 0, 0

    def _extend(self, word: object) -> None:
        nxt, link, length = self.next, self.link, self.length
        new, at = len(nxt), self.last
        nxt.append({})
        link.append(0)
        length.append(length[at] + 1)
        while at >= 0 and word not in nxt[at]:
            nxt[at][word] = new
            at = link[at]
        if at >= 0:
            old = nxt[at][word]
            if length[old] == length[at] + 1:
                link[new] = old
            else:
                copy = len(nxt)
                nxt.append(nxt[old].copy())
                link.append(link[old])
                length.append(length[at] + 1)
                while at >= 0 and nxt[at].get(word) == old:
                    nxt[at][word] = copy
                    at = link[at]
                link[old] = link[new] = copy
        self.last = new

    def add(self, words: list[str]) -> None:
        for word in words:
            self._extend(word)
        self.texts += 1
        self._extend(self.texts)

    def statistics(self, words: list[str]) -> Iterator[int]:
        """For each place the length of the longest match that ends there."""
        nxt, link, length, at, n = self.next, self.link, self.length, 0, 0
        for word in words:
            while at and word not in nxt[at]:
                at = link[at]
                n = length[at]
            to = nxt[at].get(word)
            if to is None:
                n = 0
            else:
                at, n = to, n + 1
            yield n


def _cut(held: list[list[str]], window: int) -> Iterator[list[list[str]]]:
    """Texts of a shard in parts of bounded size; parts of one text overlap by a window less one."""
    part: list[list[str]] = []
    size = 0
    for words in held:
        for at in range(0, max(1, len(words) - window + 1), SHARD):
            cut = words[at:at + SHARD + window - 1]
            if part and size + len(cut) > SHARD + window:
                yield part
                part, size = [], 0
            part.append(cut)
            size += len(cut)
    if part:
        yield part


def _passages(docs: DataFrame, window: int) -> DataFrame:
    """Runs of words whose anchors one earlier document (or this one first) holds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in pieces(batches, 256):
            out = []
            anchors = chosen(list(part["text"]), ANCHOR, window)
            for id_, key, text, at_, firsts, (_, places, of_run) in zip(
                    part["id"], part["text_key"], part["text"], part["places"], part["firsts"], anchors):
                if not len(of_run):
                    continue
                first_at = np.full(int(places[-1]) + 1, -1, np.int64)
                known = np.zeros(len(first_at), bool)
                first_at[at_] = firsts
                known[at_] = True
                first, is_known = first_at[places][of_run], known[places][of_run]
                words = _WORD.findall(text)
                edge = np.flatnonzero((first[1:] != first[:-1]) | (is_known[1:] != is_known[:-1])) + 1
                for at, end in zip(np.append(0, edge), np.append(edge, len(first))):
                    if is_known[at]:
                        shard = int(first[at])
                        out.append((shard, shard != id_, id_, key, int(at), int(end - at + window - 1),
                                    " ".join(words[at:end + window - 1])))
            if out:
                yield pd.DataFrame(out, columns=["shard", "query", "id", "text_key", "place", "n", "words"])

    return docs.mapInPandas(
        run, "shard long, query boolean, id long, text_key long, place int, n int, words string")


def _stream(rows: DataFrame, window: int) -> DataFrame:
    """Matched spans, and the windows that the shard lacks with their words."""

    def runs(flags: np.ndarray) -> Iterator[tuple[int, int]]:
        step = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
        yield from zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1))

    def answer(asked: list, held: list[list[str]]) -> pd.DataFrame:
        found = [np.zeros(len(q[3]) - window + 1, bool) for q in asked]
        for part in _cut(held, window):
            automaton = SuffixAutomaton()
            for words in part:
                automaton.add(words)
            for q, flags in zip(asked, found):
                n = np.fromiter(automaton.statistics(q[3]), np.int64, len(q[3]))
                flags |= n[window - 1:] >= window
        out = []
        for (id_, key, place, words), flags in zip(asked, found):
            out.extend((id_, key, place + int(a), place + int(b) + window - 1, None) for a, b in runs(flags))
            out.extend((id_, key, place + int(i), place + int(i) + window, " ".join(words[i:i + window]))
                       for i in np.flatnonzero(~flags))
        return pd.DataFrame(out, columns=["id", "text_key", "place", "end", "words"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, asked, size = None, [], [], 0
        for batch in batches:
            for shard, share, query, id_, key, place, words in zip(
                    batch["shard"], batch["share"], batch["query"], batch["id"], batch["text_key"], batch["place"],
                    batch["words"]):
                if (shard, share) != at or size > SHARE:
                    if asked:
                        yield answer(asked, held)
                    asked, size = [], 0
                    if (shard, share) != at:
                        at, held = (shard, share), []
                if query:
                    asked.append((id_, key, place, words.split(" ")))
                    size += len(asked[-1][3])
                else:
                    held.append(words.split(" "))
        if asked:
            yield answer(asked, held)

    return rows.mapInPandas(run, "id long, text_key long, place int, end int, words string")


def repeated_spans(docs: DataFrame, window: int = 13) -> DataFrame:
    """Spans of words (``id``, ``text_key``, ``place``, ``end``) in windows of earlier documents."""
    source = docs.filter("doc_id is not null and text is not null").select(
        F.col("doc_id").cast("long").alias("id"), F.col("text").alias("text"))
    held = repeated(source, ANCHOR, window)
    passages = materialise(_passages(
        source.withColumn("text_key", F.xxhash64("text")).join(held, ["id", "text_key"]), window))
    load = materialise(passages.filter("query").groupBy("shard").agg(
        F.ceil(F.sum("n") / SHARE).cast("int").alias("shares")))
    sized = passages.join(load, "shard")
    asked = sized.filter("query").withColumn("share", F.pmod(
        F.xxhash64("id", "text_key", "place"), F.col("shares")).cast("int"))
    kept = sized.filter("not query").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    columns = ["shard", "share", "query", "id", "text_key", "place", "words"]
    met = asked.select(columns).union(kept.select(columns)).repartition("shard", "share").sortWithinPartitions(
        "shard", "share", "query")
    found = materialise(_stream(met, window))
    # a window that the shard lacks can stand in a document between
    left = found.filter("words is not null")
    first = materialise(left.groupBy("words").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter(
        "first < last").select("words", "first"))
    late = left.join(first, "words").filter("id > first")
    columns = ["id", "text_key", "place", "end"]
    return found.filter("words is null").select(columns).union(late.select(columns))


def deduplicated(docs: DataFrame, window: int = 13) -> DataFrame:
    """Per row ``doc_id``, ``n_words``, ``n_removed`` and the ``kept`` text.

    A word is removed if a window of ``window`` words of its document covers it whose words
    also start in a document with a smaller id; windows are judged on the input. Kept words
    are joined by one space. Null, empty and short texts lose nothing; rows that repeat an id
    are judged against smaller ids only; rows without an id are neither reduced nor a reference.
    """
    spans = repeated_spans(docs, window).groupBy("id", "text_key").agg(
        F.collect_set(F.struct("place", "end")).alias("spans"))
    source = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("text"),
                         F.xxhash64("text").alias("text_key"))
    joined = source.join(spans, ["id", "text_key"], "left").select("id", "spans", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out = [_reduced(t, s) for s, t in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[pa.array(c, type=t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string()))]],
                    ["doc_id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def _reduced(text: str | None, spans: list[dict] | None) -> tuple[int, int, str]:
    words = _WORD.findall(text) if text else []
    if not spans:
        return len(words), 0, " ".join(words)
    gone = np.zeros(len(words), bool)
    for s in spans:
        gone[s["place"]:s["end"]] = True
    return len(words), int(gone.sum()), " ".join([w for w, g in zip(words, gone) if not g])
