"""Byte-level BPE encoding by a lazily determinised transducer, and streaming decoding.

The merges of a rank file are compiled into a nondeterministic transducer: at each byte it
guesses whether a token ends, and a guess stands only if the merges would leave that token
beside the one before it. Determinisation runs while texts are read: a state is the set of
guesses still alive, each the place in the trie of token bytes and the token before it, and
a transition writes the one token that can end at its byte. A guess dies when no token
continues, so all guesses agree on what lies a bounded number of bytes back, and the tokens
up to there are given out.

Decoding follows the well-formed byte sequences of UTF-8 in a table of eight states and
writes each character when its last byte has come, whatever the borders of the tokens.
"""

from __future__ import annotations

import base64
import math
import struct
from collections.abc import Iterable, Iterator

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.workers import map_texts

#: pieces kept in memory and the longest kept; determinised transitions kept
MEMORY, LONGEST, TRANSITIONS = 400_000, 48, 1_000_000
#: bytes of a piece that wait before the guesses are asked what they agree on
WAIT = 4_096


class Transducer:
    """The merges of one rank file; states and transitions are made when first met."""

    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a byte-level vocabulary holds every single byte")
        self.rank = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        # the trie of token bytes: (node, byte) to node, nodes that go on, and the token that ends at a node
        self.child: dict[int, int] = {}
        self.inner, self.ends, self.depth = {0}, {}, [0]
        nodes = 1
        for token, i in ranks.items():
            node = 0
            for byte in token:
                self.inner.add(node)
                key = node << 8 | byte
                if key not in self.child:
                    self.child[key] = nodes
                    self.depth.append(self.depth[node] + 1)
                    nodes += 1
                node = self.child[key]
            self.ends[node] = i
        self.length = {i: len(t) for i, t in self.bytes_of.items()}
        self.packed = {i: struct.pack("<I", i) for i in self.bytes_of}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[int, bool] = {}
        self._forget()

    def _forget(self) -> None:
        """Start the determinised part anew.

        A guess is one number: its node above 40 bits, so that 8 bits lie free for the next byte,
        and the token before it below 32 (0 for none, else one more than its id). A transition is
        alike: the next state, and the token that ends.
        """
        self.states, self.number = [(0,)], {(0,): 0}
        self.step: dict[int, int] = {}

    def merged(self, token: bytes) -> tuple[list[bytes], tuple[bytes, bytes] | None]:
        """What the merges make of a token's own bytes, and the last pair merged."""
        parts, last = [token[i:i + 1] for i in range(len(token))], None
        while len(parts) > 1:
            found = [(self.rank.get(a + b, math.inf), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            best, at = min(found)
            if best == math.inf:
                break
            last = parts[at], parts[at + 1]
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts, last

    def made_of(self, i: int) -> tuple[int, int] | None:
        """The two tokens whose merge is token ``i``; none for a byte or a token no merge makes."""
        if i not in self.halves:
            parts, last = self.merged(self.bytes_of[i])
            self.halves[i] = (self.rank[last[0]], self.rank[last[1]]) if len(parts) == 1 and last else None
        return self.halves[i]

    def reachable(self, i: int) -> bool:
        return len(self.bytes_of[i]) == 1 or self.made_of(i) is not None

    def _apart(self, a: int, b: int) -> bool:
        """True if no merge joins ``a`` and ``b``: their own merges are undone, the latest first."""
        until = math.inf
        while True:
            across = self.rank.get(self.bytes_of[a] + self.bytes_of[b], math.inf)
            if across < until:
                return False
            in_a, in_b = self.made_of(a), self.made_of(b)
            if in_a is None and in_b is None:
                return True
            if in_b is None or (in_a is not None and a > b):
                until, a = a, in_a[1]
            else:
                # of equal merges the left one comes first, so an equal one across precedes that inside b
                until, b = b + 0.5, in_b[0]

    def follows(self, before: int, token: int) -> bool:
        """True if a token can stand after the one whose id is one less than ``before``, or first if that is 0."""
        if len(self.pairs) > TRANSITIONS:
            self.pairs.clear()
        fits = self.reachable(token) and (not before or self._apart(before - 1, token))
        self.pairs[before << 32 | token] = fits
        return fits

    def _move(self, state: int, byte: int) -> int:
        """Determinise one transition: the guesses alive after a byte and the token that ends there."""
        alive, ended = [], 0
        child, ends, inner, pairs = self.child.get, self.ends.get, self.inner, self.pairs.get
        for guess in self.states[state]:
            to = child(guess >> 32 | byte)
            if to is None:
                continue
            before = guess & 0xFFFFFFFF
            token = ends(to)
            if token is not None:
                fits = pairs(before << 32 | token)
                if fits or fits is None and self.follows(before, token):
                    ended = token + 1
                    alive.append(ended)
            if to in inner:
                alive.append(to << 40 | before)
        alive.sort()
        after = tuple(alive)
        number = self.number.get(after)
        if number is None:
            number = self.number[after] = len(self.states)
            self.states.append(after)
        out = self.step[state << 8 | byte] = number << 40 | ended
        return out

    def _agreed(self, state: int, moves: list[int]) -> int:
        """How many bytes the tokens span that all guesses of a state agree on."""
        starts = {len(moves) - self.depth[guess >> 40] for guess in self.states[state]}
        while len(starts) > 1:
            last = max(starts)
            starts.remove(last)
            starts.add(last - self.length[(moves[last - 1] & 0xFFFFFFFF) - 1])
        return starts.pop()

    def _back(self, moves: list[int], at: int) -> list[int]:
        """The tokens of the first ``at`` bytes, from the last backwards."""
        out = []
        while at:
            token = (moves[at - 1] & 0xFFFFFFFF) - 1
            out.append(token)
            at -= self.length[token]
        out.reverse()
        return out

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        whole = self.rank.get(piece)
        if whole is not None:
            # a piece that is a token stands for it, also where no merge makes it
            return [whole]
        if len(self.step) > TRANSITIONS:
            self._forget()
        out: list[int] = []
        at, moves, step = 0, [], self.step
        for n, byte in enumerate(piece, 1):
            move = step.get(at | byte)
            if move is None:
                move = self._move(at >> 8, byte)
            at = move >> 32
            moves.append(move)
            if not n % WAIT:
                settled = self._agreed(at >> 8, moves)
                out += self._back(moves, settled)
                moves = moves[settled:]
        # where the text ends, the guess that ends a token is right
        return out + self._back(moves, len(moves))


def _utf8_table() -> list[tuple[int, ...]]:
    """Next state of the well-formed byte sequences by state and byte; -1 where none is.

    States: 0 between characters, 1 to 3 that many continuation bytes due, 4 to 7 after the
    lead bytes E0, ED, F0, F4, whose second byte has a narrower range.
    """
    # fixed values: state, first byte, last byte, next state
    ranges = [
        (0, 0x00, 0x7F, 0), (0, 0xC2, 0xDF, 1), (0, 0xE0, 0xE0, 4), (0, 0xE1, 0xEC, 2), (0, 0xED, 0xED, 5),
        (0, 0xEE, 0xEF, 2), (0, 0xF0, 0xF0, 6), (0, 0xF1, 0xF3, 3), (0, 0xF4, 0xF4, 7), (1, 0x80, 0xBF, 0),
        (2, 0x80, 0xBF, 1), (3, 0x80, 0xBF, 2), (4, 0xA0, 0xBF, 1), (5, 0x80, 0x9F, 1), (6, 0x90, 0xBF, 2),
        (7, 0x80, 0x8F, 2),
    ]
    table = [[-1] * 256 for _ in range(8)]
    for state, first, last, after in ranges:
        for byte in range(first, last + 1):
            table[state][byte] = after
    return [tuple(row) for row in table]


_UTF8 = _utf8_table()


class StreamDecoder:
    """Text of ids as they come; a character is given out when its last byte is there.

    ``known`` remembers what tokens do from the state between two characters.
    """

    def __init__(self, bytes_of: dict[int, bytes], known: dict[int, tuple[str, int, bytes]] | None = None):
        self.bytes_of, self.known = bytes_of, {} if known is None else known
        self.state, self.pending = 0, b""

    def feed(self, ids: Iterable[int]) -> Iterator[str]:
        known = self.known
        for i in ids:
            if self.state:
                text = self._through(self.bytes_of[i])
            elif i in known:
                text, self.state, self.pending = known[i]
            else:
                text = self._through(self.bytes_of[i])
                known[i] = text, self.state, self.pending
            yield text

    def _through(self, token: bytes) -> str:
        out, state, pending = [], self.state, bytearray(self.pending)
        for byte in token:
            after = _UTF8[state][byte]
            if after < 0 and state:
                # a character broken off gives one replacement, and the byte starts anew
                out.append("\ufffd")
                pending.clear()
                after = _UTF8[0][byte]
            if after < 0:
                out.append("\ufffd")
                state = 0
                continue
            pending.append(byte)
            state = after
            if not after:
                out.append(pending.decode())
                pending.clear()
        self.state, self.pending = state, bytes(pending)
        return "".join(out)

    def finish(self) -> str:
        """What is left of a character that the ids broke off."""
        left, self.state, self.pending = ("\ufffd" if self.state else ""), 0, b""
        return left


class Codec:
    """Pieces of a pattern through the transducer, with a bounded memory of short pieces."""

    def __init__(self, ranks: str, pattern: str):
        with open(ranks, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.transducer = Transducer({base64.b64decode(token): int(rank) for token, rank in pairs})
        self.pattern = regex.compile(pattern)
        # pieces met lately, and those met before them
        self.known: dict[str, tuple[bytes, str]] = {}
        self.older: dict[str, tuple[bytes, str]] = {}
        self.texts: dict[int, tuple[str, int, bytes]] = {}

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        decoder = StreamDecoder(self.transducer.bytes_of, self.texts)
        return "".join(decoder.feed(ids)) + decoder.finish()

    def piece(self, text: str) -> tuple[bytes, str]:
        """Packed ids of a piece, and the text that these ids decode to."""
        found = self.known.get(text) or self.older.get(text)
        if found is None:
            ids = self.transducer.encode(text.encode())
            found = b"".join(map(self.transducer.packed.__getitem__, ids)), self.decode(ids)
        if len(text) <= LONGEST:
            if len(self.known) >= MEMORY:
                self.known, self.older = {}, self.known
            self.known[text] = found
        return found

    def encode(self, text: str) -> tuple[bytes, str]:
        """Packed ids of a text, and the decoded text."""
        known, piece = self.known.get, self.piece
        found = [known(p) or piece(p) for p in self.pattern.findall(text)]
        if not found:
            return b"", ""
        packed, texts = zip(*found)
        return b"".join(packed), "".join(texts)


_codecs: dict[tuple[str, str], Codec] = {}


def codec(ranks: str, pattern: str) -> Codec:
    """One codec for each rank file, pattern and Python worker."""
    key = ranks, pattern
    if key not in _codecs:
        _codecs[key] = Codec(ranks, pattern)
    return _codecs[key]


def encode(docs: DataFrame, ranks: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with ``ids`` (packed little-endian 32-bit) and the ``decoded`` text.

    Rows are independent: nothing is shuffled and a lost task is simply run again. A null
    text counts as empty and has no ids. Every row is kept, repeated and null ids included;
    columns not in ``keep`` are not read. Strings of special tokens are ordinary text.
    """

    def make(texts: list[str | None]) -> list[list]:
        c = codec(ranks, pattern)
        pairs = [c.encode(t or "") for t in texts]
        return [[p[0] for p in pairs], [p[1] for p in pairs]]

    return map_texts(docs, keep, {"ids": "binary", "decoded": "string"}, make)


def digests(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Per document the number of ids and the digests of ids and decoded bytes."""
    return encode(docs, ranks, pattern).select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
