"""SentencePiece BPE encoding by a table of last tokens, and decoding.

Every prefix of a text has one encoding, hence one last token. The table stores it for
each prefix: an automaton over the pieces lists the tokens that end there, and the right
one is the token that follows the last token of the remaining prefix without a merge
across the border. Ids are then recovered from the end backwards.

No piece joins a mark of space to an earlier character, so a text falls into segments
that start with the mark; segments repeat and are kept in a bounded memory.
"""

from __future__ import annotations

import heapq
import math
import re
import struct
from itertools import groupby

import ahocorasick
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.workers import map_texts

SPACE = "▁"
_SEGMENT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
#: segments kept, and the longest that is kept
MEMORY, LONGEST = 500_000, 48


class Codec:
    """Encoder and decoder for one model file, as the library does it without sampling."""

    def __init__(self, model: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.bos, self.eos, self.unknown = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        self.bytes: dict[int, int] = {}
        self.rank: dict[str, tuple[float, int]] = {}
        for i, piece in enumerate(self.pieces):
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.rank[piece] = (-sp.get_score(i), i)
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.packed = {p: struct.pack("<I", i) for p, (_, i) in self.rank.items()}
        self.letters = {p for p in self.rank if len(p) == 1}
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in self.rank)
        self.automaton = ahocorasick.Automaton()
        for piece in self.rank:
            self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.halves: dict[str, tuple[str, str] | None] = {}
        self.known: dict[str, tuple[bytes, str]] = {}

    def merged(self, text: str, done: list[tuple[str, str]] | None = None) -> list[str]:
        """The merges themselves: best score first, then leftmost; ``done`` gets each pair."""
        part = list(text)
        left, right = list(range(-1, len(part) - 1)), list(range(1, len(part) + 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(part):
                both = part[i] + part[j]
                if both in self.rank:
                    heapq.heappush(heap, (self.rank[both][0], i, j, both))

        for i in range(len(part) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if not part[i] or not part[j] or part[i] + part[j] != both or right[i] != j:
                continue
            if done is not None:
                done.append((part[i], part[j]))
            part[i], part[j] = both, ""
            right[i] = right[j]
            if right[i] < len(part):
                left[right[i]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [p for p in part if p]

    def _halves(self, piece: str) -> tuple[str, str] | None:
        """The two tokens whose merge makes a piece; none if its characters never become it."""
        if piece not in self.halves:
            last: list[tuple[str, str]] = []
            whole = self.merged(piece, last) == [piece]
            self.halves[piece] = last[-1] if whole and last else None
        return self.halves[piece]

    def _apart(self, a: str, b: str) -> bool:
        """Undo the merges of both tokens, the latest first, and look for an earlier one across.

        The tokens next to the border at any time are a tail of ``a`` and a head of ``b``. They
        would join across it if that merge came before the one that took either of them inward;
        of equal merges the leftmost comes first, so a tie goes across only against ``b``.
        """
        until = math.inf
        while True:
            across = self.rank.get(a + b)
            if across is not None and across[0] < until:
                return False
            made_a = self.rank[a][0] if len(a) > 1 else -1
            made_b = self.rank[b][0] if len(b) > 1 else -1
            if made_a < 0 and made_b < 0:
                return True
            if made_a > made_b:
                until, a = made_a, self._halves(a)[1]
            else:
                until, b = made_b + 0.5, self._halves(b)[0]

    def _follows(self, a: str, b: str) -> bool:
        """True if ``b`` is a token that can stand after ``a`` (or first, if that is empty)."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) > 2 * MEMORY:
                self.pairs.clear()
            possible = len(b) == 1 or self._halves(b) is not None
            found = self.pairs[(a, b)] = possible and (not a or self._apart(a, b))
        return found

    def tokens(self, text: str) -> list[str]:
        """Tokens of a segment through the table; an unknown character stands alone."""
        if text.startswith(SPACE * 2):
            # pieces of several marks have equal scores, so a last token need not be unique
            return self.merged(text)
        if not self.letters.issuperset(text):
            out: list[str] = []
            for known, run in groupby(text, self.letters.__contains__):
                # an unknown character never merges, so what follows it starts afresh
                out.extend(self.table("".join(run)) if known else run)
            return out
        return self.table(text)

    def table(self, text: str) -> list[str]:
        """The last token of each prefix, and the tokens read off from the end."""
        last: list[str | None] = [None] * (len(text) + 1)
        last[0] = ""
        pairs, follows = self.pairs, self._follows
        # matches come by their end, the longest of one end first
        for end, piece in self.automaton.iter(text):
            if last[end + 1] is None:
                before = last[end + 1 - len(piece)]
                if before is not None:
                    fits = pairs.get((before, piece))
                    if fits is None:
                        fits = follows(before, piece)
                    if fits:
                        last[end + 1] = piece
        out, i = [], len(text)
        while i:
            token = last[i]
            if token is None:
                return self.merged(text)
            out.append(token)
            i -= len(token)
        out.reverse()
        return out

    def ids(self, tokens: list[str]) -> list[int]:
        out: list[int] = []
        for token in tokens:
            if token in self.rank:
                out.append(self.rank[token][1])
            elif self.bytes:
                out.extend(self.bytes[b] for b in token.encode())
            else:
                out.append(self.unknown)
        return out

    def segment(self, text: str) -> tuple[bytes, str]:
        """Packed ids of a segment and what they decode to."""
        found = self.known.get(text)
        if found is None:
            if self.letters.issuperset(text):
                # no unknown character, hence no bytes: the tokens spell the segment
                found = b"".join(map(self.packed.__getitem__, self.tokens(text))), text.replace(SPACE, " ")
            else:
                ids = self.ids(self.tokens(text))
                found = struct.pack(f"<{len(ids)}I", *ids), self.pieces_text(ids)
            if len(text) <= LONGEST:
                if len(self.known) >= MEMORY:
                    self.known.clear()
                self.known[text] = found
        return found

    def pieces_text(self, ids: list[int]) -> str:
        out, pending = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                pending.append(self.byte_of[i])
                continue
            if pending:
                out.append(pending.decode(errors="replace"))
                pending.clear()
            out.append("" if i in (self.bos, self.eos) else self.pieces[i].replace(SPACE, " "))
        out.append(pending.decode(errors="replace"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """Text of ids; the space that encoding put in front is taken away."""
        return self.pieces_text(ids).removeprefix(" ")

    def encode(self, text: str) -> tuple[bytes, str]:
        """Packed ids with begin and end, and the decoded text."""
        begin, end = struct.pack("<I", self.bos), struct.pack("<I", self.eos)
        if not text:
            return begin + end, ""
        marked = SPACE + text.replace(" ", SPACE)
        parts = _SEGMENT.findall(marked) if self.cuts else [marked]
        known, segment = self.known, self.segment
        found = [known.get(p) or segment(p) for p in parts]
        packed, texts = zip(*found)
        return b"".join((begin, *packed, end)), "".join(texts).removeprefix(" ")


_codecs: dict[str, Codec] = {}


def codec(model: str) -> Codec:
    """One codec for each model file and Python worker."""
    if model not in _codecs:
        _codecs[model] = Codec(model)
    return _codecs[model]


def encode(docs: DataFrame, model: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with ``ids`` (packed little-endian 32-bit) and the ``decoded`` text.

    Rows are independent: nothing is shuffled and a lost task is simply run again. A null
    text counts as empty: begin and end ids, decoded to the empty text. Every row is kept,
    repeated ids and null ids included; columns not in ``keep`` are not read.
    """

    def make(texts: list[str | None]) -> list[list]:
        c = codec(model)
        pairs = [c.encode(t or "") for t in texts]
        return [[p[0] for p in pairs], [p[1] for p in pairs]]

    return map_texts(docs, keep, {"ids": "binary", "decoded": "string"}, make)


def digests(docs: DataFrame, model: str) -> DataFrame:
    """Per document the number of ids and the digests of ids and decoded text."""
    return encode(docs, model).select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )

