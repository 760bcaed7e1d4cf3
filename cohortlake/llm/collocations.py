"""Phrase collocations by Toivonen mining: a sample proposes, a full pass counts, failures are followed.

A phrase is frequent only if its first and its last words without one are. The phrases that
are frequent in a sample, at a lowered count, go into a filter of fixed size. One pass over
all texts then counts exactly every word and every phrase whose shorter parts the filter
holds: the proposed phrases and their negative border. A border phrase that turns out
frequent was missed by the sample; it joins the filter, and an expansion pass counts what
this opens up. That pass also follows the phrases that it meets first itself: a frequent
phrase that the full pass left out has frequent parts, each of which is in the wider filter or
counted in the expansion for the first time, so after it nothing is open. False positives of
the filter are counted in vain and change no result, so neither do the sample and the size of
the filter.

Inside a task words are numbered per chunk and phrases are counted as exact numbers, so a
record leaves a task once per chunk and phrase, however often the phrase stands there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.text import gram_hashes, mix
from cohortlake.operators.runs import sorted_runs
from cohortlake.session import materialise

#: share of the texts that proposes phrases, and the part of the expected count that suffices there
SHARE, LOWERED = 0.25, 0.8
#: bits of the filter (as a power of two) and bytes of text that a task counts at once
FILTER_BITS, CHUNK = 26, 4 << 20
# fixed values: bytes that end a piece, and a byte that no UTF-8 text holds
_ENDS, _MARK = b".,;:!?\n\x0b\x0c\r", b"\xff"
_CUT = re.compile(b"[" + re.escape(_ENDS) + b"]")
_TO_MARK = bytes.maketrans(_ENDS, _MARK * len(_ENDS))
_COUNTS = "lang string, phrase string, n long"


class PhraseFilter:
    """A Bloom filter of phrase hashes in a fixed number of bits."""

    def __init__(self, bits: int = FILTER_BITS):
        self.mask = np.uint64((1 << bits) - 1)
        self.slots = np.zeros(1 << (bits - 6), np.uint64)

    def places(self, hashes: np.ndarray) -> Iterator[np.ndarray]:
        yield hashes & self.mask
        yield (hashes >> np.uint64(32)) & self.mask

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for at in self.places(hashes):
            found &= (self.slots[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return found

    def joined(self, slots: np.ndarray, values: np.ndarray) -> PhraseFilter:
        out = PhraseFilter.__new__(PhraseFilter)
        out.mask, out.slots = self.mask, self.slots.copy()
        out.slots[slots] |= values
        return out


def _word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    prefix = lang.encode() + b"\0"
    return mix(np.fromiter((xxhash.xxh3_64_intdigest(prefix + w) for w in words), np.uint64, len(words)))


def _phrase_hashes(langs: pa.Array, phrases: pa.Array) -> np.ndarray:
    """Hashes of phrases as ``gram_hashes`` gives them, all of one language and length together."""
    found = []
    lengths = pc.count_substring(phrases, " ").to_numpy() + 1
    for lang in pc.unique(langs).to_pylist():
        of_lang = pc.equal(langs, lang).to_numpy(zero_copy_only=False)
        for length in np.unique(lengths[of_lang]):
            rows = phrases.filter(pa.array(of_lang & (lengths == length)))
            words = pc.split_pattern(rows, " ").flatten().dictionary_encode()
            hashes = _word_hashes(lang, words.dictionary.to_pylist())[words.indices.to_numpy()]
            # the phrases lie end to end, and each begins a run of its length
            found.append(gram_hashes(hashes, int(length))[::length])
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def _slices(texts: list[bytes], size: int) -> Iterator[bytes]:
    """Texts joined to chunks of about ``size`` bytes; a longer text is cut where a piece ends."""
    held, held_size = [], 0
    for text in texts:
        at = 0
        while len(text) - at > 2 * size:
            cut = _CUT.search(text, at + size)
            if cut is None:
                break
            yield text[at:cut.end()]
            at = cut.end()
        held.append(text[at:] if at else text)
        held_size += len(held[-1])
        if held_size >= size:
            yield b"\n".join(held)
            held, held_size = [], 0
    if held:
        yield b"\n".join(held)


def _numbered(data: bytes, longest: int) -> Iterator[tuple[pa.Array, np.ndarray, int]]:
    """Distinct words, their numbers in order (-1 where a piece ends), and words met before.

    A phrase of ``longest`` numbers fits into 62 bits; a run of more words is dealt in parts
    that repeat the last words of the part before.
    """
    words = data.lower().translate(_TO_MARK).replace(_MARK, b" \xff ").split()
    most, back = 1 << (62 // longest), longest - 1
    for at in range(0, max(1, len(words) - back), most - back):
        coded = pa.array(words[at:at + most], pa.binary())
        if len(words) <= most:
            words = words[:back + 1]
        coded = coded.dictionary_encode()
        numbers = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        mark = pc.index(coded.dictionary, pa.scalar(_MARK, pa.binary())).as_py()
        if mark >= 0:
            numbers[numbers == mark] = -1
        yield coded.dictionary, numbers, back if at else 0


def _among(by: PhraseFilter, grams: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Where a phrase is in the filter, of the places asked for."""
    held = np.zeros(len(grams), bool)
    at = np.flatnonzero(asked)
    held[at] = by.holds(grams[at])
    return held


def _held(by: PhraseFilter, numbers: np.ndarray, of_word: np.ndarray) -> np.ndarray:
    """Where a word is in the filter."""
    held = by.holds(mix(of_word))
    held[-1] = False
    return held[numbers]


def _counted(lang: str, data: bytes, longest: int, old: PhraseFilter | None, new: PhraseFilter | None
             ) -> Iterator[pa.RecordBatch]:
    """Counts of the phrases of one chunk that ``new`` admits and ``old`` did not.

    Without ``old`` words are counted too, and under the empty phrase their number. Without
    ``new`` every phrase is admitted.
    """

    def batch(phrases: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(counts), pa.string()), phrases.cast(pa.string()), pa.array(counts, pa.int64())],
            ["lang", "phrase", "n"])

    for dictionary, numbers, before in _numbered(data, longest):
        size = len(dictionary)
        inside = numbers >= 0
        # a phrase counts where its last word is new
        late = np.arange(len(numbers)) >= before
        if old is None:
            own = np.bincount(numbers[inside & late], minlength=size)
            met = np.flatnonzero(own)
            yield batch(dictionary.take(pa.array(met)), own[met])
            yield batch(pa.array([b""], pa.binary()), np.array([own.sum()]))
        if new is not None:
            of_word = np.append(_word_hashes(lang, dictionary.to_pylist()), np.uint64(0))
            hashes = of_word[numbers]
            in_new, in_old = (_held(by, numbers, of_word) if by is not None else None for by in (new, old))

        for length in range(2, longest + 1):
            if len(numbers) < length:
                break
            whole = reduce(np.logical_and, [inside[i:len(numbers) - length + 1 + i] for i in range(length)])
            fresh = whole
            if new is not None:
                fresh = whole & in_new[:-1] & in_new[1:]
                if old is not None:
                    was = whole & in_old[:-1] & in_old[1:]
                    fresh &= ~was
            at = np.flatnonzero(fresh & late[length - 1:])
            if new is not None and length < longest:
                grams = gram_hashes(hashes, length)
                in_new = _among(new, grams, whole)
                if old is not None:
                    # what is counted here for the first time is followed at once
                    in_old, in_new = _among(old, grams, whole), in_new | fresh
            if not len(at):
                continue
            key = numbers[at]
            for i in range(1, length):
                key = key * size + numbers[at + i]
            key, counts = np.unique(key, return_counts=True)
            parts = []
            for _ in range(length):
                key, word = np.divmod(key, size)
                parts.insert(0, dictionary.take(pa.array(word)))
            yield batch(pc.binary_join_element_wise(*parts, b" "), counts)


def _pass(source: DataFrame, longest: int, old: PhraseFilter | None, new: PhraseFilter | None) -> DataFrame:
    """Exact counts over all rows of ``source`` (``lang``, ``text``) of what the filters admit."""
    context = source.sparkSession.sparkContext
    # both filters have a fixed size
    shared = context.broadcast((old, new))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        was, now = shared.value
        held: dict[str, list[bytes]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, texts in held.items():
                for data in _slices(texts, CHUNK):
                    yield from _counted(lang, data, longest, was, now)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                held.setdefault(lang, []).append(text)
                size += len(text)
                if size >= 2 * CHUNK:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()

    # a task has combined its rows by the chunk, and combining few more would cost much
    return source.mapInArrow(run, _COUNTS).repartition("lang", "phrase").groupBy("lang", "phrase").agg(
        F.sum("n").alias("n"))


def _outside(counts: DataFrame, longest: int, known: PhraseFilter) -> tuple[np.ndarray, np.ndarray]:
    """Filter slots and bits of the phrases below ``longest`` words that the filter lacks.

    As many rows as the filter has slots reach the driver at most.
    """
    shared = counts.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = _phrase_hashes(batch.column(0), batch.column(1).cast(pa.binary()))
            hashes = hashes[~shared.value.holds(hashes)]
            at = np.unique(np.concatenate(list(shared.value.places(hashes))))
            slots, first = np.unique(at >> np.uint64(6), return_index=True)
            bits = np.uint64(1) << (at & np.uint64(63))
            values = np.bitwise_or.reduceat(bits, first) if len(at) else bits
            yield pa.RecordBatch.from_arrays(
                [pa.array(slots.astype(np.int64)), pa.array(values.view(np.int64))], ["slot", "bits"])

    shorter = counts.filter((F.col("phrase") != "") & (F.size(F.split("phrase", " ")) < longest))
    rows = shorter.select("lang", "phrase").mapInArrow(run, "slot long, bits long").groupBy("slot").agg(
        F.bit_or("bits").alias("bits")).toArrow()
    return rows["slot"].to_numpy(), rows["bits"].to_numpy().view(np.uint64)


def frequent_phrases(
    docs: DataFrame, least: int = 10, longest: int = 3, share: float = SHARE, filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """``lang``, ``phrase`` and its exact count ``n``, of all phrases up to ``longest`` words met ``least`` times.

    The empty phrase of a language has the number of its word occurrences. ``share`` is the
    part of the texts that proposes; it and ``filter_bits`` change the work, not the result.
    """
    source = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").alias("text")).filter(
        "text is not null and text != ''")
    sample = source.filter(F.pmod(F.xxhash64("text"), F.lit(10_000)) < int(share * 10_000))
    # the longest phrases open up nothing, so they need no proposal
    proposed = _pass(sample, longest - 1, None, None).filter(
        F.col("n") >= max(1, int(least * share * LOWERED)))
    known = PhraseFilter(filter_bits)
    known = known.joined(*_outside(proposed, longest, known))
    enough = (F.col("n") >= least) | (F.col("phrase") == "")
    found = materialise(_pass(source, longest, None, known).filter(enough))
    slots, bits = _outside(found, longest, known)
    if not len(slots):
        return found
    more = _pass(source, longest, known, known.joined(slots, bits)).filter(enough)
    return found.union(more)


def _joined(words: Column, start: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(
    docs: DataFrame, least: int = 10, longest: int = 3, top: int = 2000, covered: int = 50,
    share: float = SHARE, filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """The best phrases of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    A phrase of two to ``longest`` words is a candidate if it is met ``least`` times; ``a`` is
    its count, ``l`` and ``r`` are those of the two parts of its worst cut, whose score
    ``floor(1000000 a a / (l r))`` counts. A candidate inside a longer one goes if the longer
    has at least ``covered`` hundredths of its count. A null language counts as ``und``, a
    null text as empty; repeated rows count each; an empty table gives no rows. Other columns
    are not read.
    """
    counts = materialise(frequent_phrases(docs, least, longest, share, filter_bits))
    words = F.split("phrase", " ")
    phrases = counts.filter("phrase != ''")
    candidates = phrases.withColumn("words", words).filter(F.size("words") > 1).select(
        "lang", "phrase", "words", F.col("n").alias("a"))
    cuts = F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda k: F.struct(
        k.alias("k"), _joined(F.col("words"), 1, k).alias("left"),
        _joined(F.col("words"), k + 1, F.size("words") - k).alias("right")))
    cut = candidates.select("lang", "phrase", "a", F.inline(cuts))
    sides = cut.select("lang", "phrase", "a", "k", F.explode(F.array(
        F.struct(F.lit(True).alias("first"), F.col("left").alias("part")),
        F.struct(F.lit(False).alias("first"), F.col("right").alias("part")))).alias("s")).select(
        "lang", "phrase", "a", "k", "s.first", "s.part")
    known = phrases.select("lang", F.col("phrase").alias("part"), F.col("n").alias("part_n"))
    sized = sides.join(known, ["lang", "part"]).groupBy("lang", "phrase", "a", "k").agg(
        F.max(F.when(F.col("first"), F.col("part_n"))).alias("l"),
        F.max(F.when(~F.col("first"), F.col("part_n"))).alias("r"))
    # counts below 10^14: the dividend has up to 35 digits
    wide = {c: F.col(c).cast("decimal(14,0)") for c in "alr"}
    scored = sized.withColumn("up", F.lit(1_000_000).cast("decimal(7,0)") * (wide["a"] * wide["a"])).withColumn(
        "down", wide["l"] * wide["r"]).withColumn("score", F.expr("cast(up div down as bigint)"))
    worst = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select(
        "lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    parts = F.flatten(F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.size("words") - m + 1), lambda i: _joined(F.col("words"), i, m))))
    inside = candidates.filter(F.size("words") > 2).select("lang", F.explode(parts).alias("phrase"), "a").groupBy(
        "lang", "phrase").agg(F.max("a").alias("longer"))
    kept = worst.join(inside, ["lang", "phrase"], "left").filter(
        F.coalesce(F.lit(100) * F.col("longer") < F.lit(covered) * F.col("a"), F.lit(True)))
    ranked = sorted_runs(kept.drop("longer"), ["lang", F.col("score").desc(), F.col("a").desc(), "phrase"]).row_number(
        ["lang"], "rank").filter(F.col("rank") <= top)
    totals = counts.filter("phrase = ''").select("lang", "n")
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
