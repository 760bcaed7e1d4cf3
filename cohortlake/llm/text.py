"""Words and 64-bit hashes of whole texts, in numpy, one document at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd

_PRIME = np.uint64(0x100000001B3)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: bytes hashed at a time, so that temporary arrays stay small for very long texts
_SLICE = 1 << 18
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: bits of the first bytes of a block that belong to its word
_WITHIN = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_powers = _inverse = np.ones(1, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values so that their order is unrelated to their content."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the prime and of its inverse modulo 2^64."""
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, 2 * len(_powers))
        tables = []
        for base in (int(_PRIME), pow(int(_PRIME), -1, 1 << 64)):
            grown = np.full(size, base, np.uint64)
            grown[0] = 1
            tables.append(np.cumprod(grown, dtype=np.uint64))
        _powers, _inverse = tables
    return _powers, _inverse


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets where words of ``[^\\x20\\x09-\\x0D]+`` start and end."""
    blank = np.ones(len(data) + 2, bool)
    blank[1:-1] = _BLANK[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    return edges[::2], edges[1::2]


def word_hashes(data: bytes) -> np.ndarray:
    """One mixed 64-bit hash for each word of a UTF-8 text.

    A word's polynomial is a difference of running sums, brought back to power zero.
    """
    return hashes_at(data, *word_bounds(data))


def hashes_at(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.empty(0, np.uint64)
    raw, parts, first = np.frombuffer(data, np.uint8), [], 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + _SLICE)))
        base, end = starts[first], ends[last - 1]
        powers, inverse = _power_tables(int(end - base) + 1)
        sums = np.zeros(int(end - base) + 1, np.uint64)
        np.cumsum((raw[base:end].astype(np.uint64) + np.uint64(1)) * powers[:end - base], out=sums[1:])
        low = starts[first:last] - base
        parts.append((sums[ends[first:last] - base] - sums[low]) * inverse[low])
        first = last
    return mix(np.concatenate(parts) + np.uint64(0x9E3779B97F4A7C15))


def block_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words as ``hashes_at``: each block of eight bytes is mixed before and after its place is added.

    A sum over the bytes themselves would not do: words of equal sum can be written down
    for any base (Thue-Morse words for 2^64), and they would count as one word.
    Where a hash only finds candidates, ``hashes_at`` does.
    """
    if not len(starts):
        return np.empty(0, np.uint64)
    # the eight bytes from each place on
    eight = np.ndarray(len(data), "<u8", data + bytes(8), strides=(1,))
    parts, first = [], 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + _SLICE)))
        low, size = starts[first:last], ends[first:last] - starts[first:last]
        blocks = (size + 7) >> 3
        begin = np.cumsum(blocks) - blocks
        nth = np.arange(begin[-1] + blocks[-1]) - np.repeat(begin, blocks)
        left = np.repeat(size, blocks) - 8 * nth
        block = eight[np.repeat(low, blocks) + 8 * nth] & _WITHIN[np.minimum(left, 8)]
        mixed = mix(mix(block + _STEP) + nth.astype(np.uint64) * _STEP)
        parts.append(np.add.reduceat(mixed, begin) + size.astype(np.uint64) * _STEP)
        first = last
    return mix(np.concatenate(parts))


def many_word_hashes(texts: list[bytes], hashes: Callable[..., np.ndarray] = hashes_at) -> list[np.ndarray]:
    """The hashes of the words of several texts; those that fit into a slice are hashed together."""
    out: list[np.ndarray] = []
    first = 0
    while first < len(texts):
        last, size = first + 1, len(texts[first])
        while last < len(texts) and size + len(texts[last]) <= _SLICE:
            size += len(texts[last])
            last += 1
        group = texts[first:last]
        joined = b"\n".join(group)
        starts, ends = word_bounds(joined)
        offsets = np.cumsum([len(t) + 1 for t in group])
        out.extend(np.split(hashes(joined, starts, ends), np.searchsorted(starts, offsets[:-1])))
        first = last
    return out


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every run of ``k`` consecutive words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total = total * np.uint64(0x9E3779B97F4A7C15) + words[j:j + n]
    return mix(total)


def minimisers(grams: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each run of ``window`` grams the place of its smallest, the leftmost of equals.

    Returns the distinct places, ascending, and for each run the index into them. Equal
    runs choose the same offset, as the choice depends on their hashes alone.
    """
    n = len(grams) - window + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    best, value, width = np.arange(len(grams), dtype=np.int64), grams, 1
    while width < window:
        # the smallest of twice as many, as far as the window goes
        step = min(width, window - width)
        later = value[step:] < value[:-step]
        best = np.where(later, best[step:], best[:-step])
        value = np.where(later, value[step:], value[:-step])
        width += step
    # the places ascend with the runs
    new = np.append(True, best[1:] != best[:-1])
    return best[new], np.cumsum(new) - 1


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def pieces(batches: Iterator[pd.DataFrame], rows: int = 1024) -> Iterator[pd.DataFrame]:
    """Batches in smaller pieces, so that what a task derives from one stays small."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.iloc[at:at + rows]
