"""Byte-pair pieces of whole texts by backtracking, and texts from piece ids.

A piece sequence is what merging gives exactly when every two neighbours are compatible:
merging their joined characters again ends in these two pieces. (Merges go by score, then
from the left; until a merge crosses a border, those on its two sides do not see it, so
what the whole text does at a border is what the two pieces beside it do.) The encoder
therefore takes the longest piece at each place (Aho-Corasick), checks it against the piece
before, falls back to shorter pieces, and steps back where none fits; a bitfield keeps the
places from which nothing fits, so each is left at most once. Checks are remembered, as
are the ids of the short units of a text.

A unit is a run of blanks with the word behind it. Where no piece of the vocabulary
goes on from a letter into a blank, units are encoded apart; else the text is one unit.
Documents stay where they are read: no shuffle, whatever the source or the size of a text.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from strikeline.llm.common import ref, text_of

BLANK = "▁"
MEMO, LONGEST = 400_000, 48  # units of a generation and pairs remembered by a worker; the longest of these units in characters
NEVER = float("-inf")
IDS = T.ArrayType(T.IntegerType(), False)
UNITS = re.compile(" *+[^ ]++| ++")


class Pieces:
    """The pieces of a sentencepiece byte-pair vocabulary, with checks of what merging them gives."""

    def __init__(self, model: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self.names = [sp.id_to_piece(i) for i in range(n)]
        bytes_, controls, unknown = ({i for i in range(n) if is_(i)} for is_ in (sp.is_byte, sp.is_control, sp.is_unknown))
        self.ids = {p: i for i, p in enumerate(self.names) if i not in bytes_ | controls | unknown and not sp.is_unused(i)}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.byte_of = {i: int(self.names[i][3:5], 16) for i in bytes_}
        self.byte_ids = {b: i for i, b in self.byte_of.items()}
        if len(self.byte_ids) != 256 or sp.decode(sp.encode("  a")) != "  a" or sp.encode("ﬁ") == sp.encode("fi") or any(c not in self.ids for p in self.ids for c in p):
            raise ValueError("this vocabulary changes texts, has no byte pieces, or pieces of characters that are none")
        self.raw = [bytes([self.byte_of[i]]) if i in bytes_ else " ⁇ ".encode() if i in unknown else b"" if i in controls else p.replace(BLANK, " ").encode() for i, p in enumerate(self.names)]
        self.controls, self.whole = frozenset(controls), bytes_ | unknown
        self.one_unit = any(BLANK in p.lstrip(BLANK) for p in self.ids)
        self.sizes = [len(p) for p in self.names]
        self.matches = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.matches.add_word(p, i)
        self.matches.make_automaton()
        self.stories: dict[int, tuple[list[float], list[str], list[str]] | None] = {}
        self.shorter: dict[int, int] = {}
        self.fits: dict[int, bool] = {}
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def story(self, piece: int) -> tuple[list[float], list[str], list[str]] | None:
        """How a piece comes about: the scores of its merges in their order (best first, leftmost of equals), and its
        first and its last part before each of them and at the end. Nothing if merging ends in other pieces."""
        if piece in self.stories:
            return self.stories[piece]
        parts, score = list(self.names[piece]), self.score
        steps, firsts, lasts = [], [parts[0]], [parts[-1]]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            steps.append(best)
            firsts.append(parts[0])
            lasts.append(parts[-1])
        got = self.stories[piece] = None if len(parts) > 1 else ([*steps, NEVER], firsts, lasts)
        return got

    def compatible(self, before: int, piece: int) -> bool:
        """Does merging keep the border between two pieces (none before: the start of a text)? The merges of both are
        repeated in their common order; a merge across the border that comes first breaks it."""
        right = self.story(piece)
        if right is None or before < 0:
            return right is not None
        left = self.story(before)
        done, at, score = 0, 0, self.score.get
        while True:
            own, next_ = left[0][done], right[0][at]
            across = score(left[2][done] + right[1][at])
            if across is not None and across > own and across >= next_:
                return False
            if own == next_ == NEVER:
                return True
            if own >= next_:
                done += 1
            else:
                at += 1

    def _shorter(self, piece: int) -> int:
        """The longest piece that a piece begins with; -1 for a single character."""
        name = self.names[piece]
        got = next((self.ids[name[:k]] for k in range(len(name) - 1, 0, -1) if name[:k] in self.ids), -1)
        self.shorter[piece] = got
        return got

    def split(self, unit: str) -> list[int]:
        """The piece ids of a unit; a character without a piece is the negative of its code point less two."""
        n = len(unit)
        longest = [-1] * n
        fits, sizes, shorter, many = self.fits, self.sizes, self.shorter, len(self.names)
        for end, i in self.matches.iter(unit):
            longest[end - sizes[i] + 1] = i
        failed: bytearray | None = None  # made where the first place fails
        out, pos, before = [], 0, -1
        piece = longest[0] if n else -1
        while pos < n:
            if piece == -1 and longest[pos] == -1:  # merges with nothing
                out.append(-2 - ord(unit[pos]))
                pos += 1
                before, piece = -1, longest[pos] if pos < n else -1
                continue
            while piece >= 0:
                end = pos + sizes[piece]
                if failed is None or not failed[end >> 3] >> (end & 7) & 1:
                    pair = (before + 1) * many + piece
                    ok = fits.get(pair)
                    if ok is None:
                        if len(fits) >= MEMO:
                            fits.clear()
                        ok = fits[pair] = self.compatible(before, piece)
                    if ok:
                        break
                got = shorter.get(piece)
                piece = self._shorter(piece) if got is None else got
            if piece >= 0:
                out.append(piece)
                before, pos = piece, end
                piece = longest[pos] if pos < n else -1
            else:  # nothing fits from here behind the piece before: take that back
                if failed is None:
                    failed = bytearray((n >> 3) + 1)
                failed[pos >> 3] |= 1 << (pos & 7)
                piece = out.pop()
                pos -= sizes[piece]
                before = out[-1] if out and out[-1] >= 0 else -1
        return out

    def unit_ids(self, unit: str) -> bytes:
        """The ids of a unit as 32-bit integers in a row. Units seen lately are remembered, in two generations."""
        got = self.memo.get(unit) or self.older.get(unit)
        if got is None:
            ids = self.split(unit.replace(" ", BLANK))
            if min(ids) < 0:
                ids = [x for i in ids for x in ([i] if i >= 0 else [self.byte_ids[b] for b in chr(-2 - i).encode("utf-8", "surrogatepass")])]
            got = array("i", ids).tobytes()
        if len(unit) <= LONGEST:
            if len(self.memo) >= MEMO:
                self.older, self.memo = self.memo, {}
            self.memo[unit] = got
        return got

    def encode(self, text: str) -> bytes:
        """The ids of a text as 32-bit integers in a row."""
        if not text:
            return b""
        whole = " " + text.replace(BLANK, " ")
        units = [whole] if self.one_unit else UNITS.findall(whole)
        out = list(map(self.memo.get, units))
        if None in out:
            out = [self.unit_ids(u) if got is None else got for u, got in zip(units, out)]
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: the blank before the first piece goes, bytes that are no character become U+FFFD."""
        first = next((k for k, i in enumerate(ids) if i not in self.controls), len(ids))
        parts = list(map(self.raw.__getitem__, ids))
        if first < len(ids) and ids[first] not in self.whole and parts[first].startswith(b" "):
            parts[first] = parts[first][1:]
        raw = b"".join(parts)
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return "".join(_characters(raw))


def _characters(raw: bytes) -> Iterator[str]:
    """Characters of bytes; each byte that begins none is U+FFFD."""
    pos = 0
    while pos < len(raw):
        b = raw[pos]
        n = 1 if b < 0x80 else 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 0
        try:
            yield raw[pos : pos + n].decode() if n else "�"
        except UnicodeDecodeError:
            n = 0
            yield "�"
        pos += max(n, 1)


@lru_cache(maxsize=2)
def pieces_of(model: str) -> Pieces:
    """The vocabulary of a worker, read once."""
    return Pieces(model)


def encode_texts(docs: DataFrame, model: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """Every row with all its columns, and the piece ids of its whole text in ``out``.

    Ids are those of the library without begin and end ids. Null and empty texts have none
    (an empty list). Repeated rows are all kept. A column named like ``out`` in any case is
    replaced. Without rows the result is empty.
    """
    schema = T.StructType([f for f in docs.schema.fields if f.name.lower() != out.lower()] + [T.StructField(out, IDS)])
    names = schema.names[:-1]
    held = docs.select(*[ref(c) for c in names], text_of(text_col).alias(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces_of(model)
        for b in batches:
            got = [p.encode(t) for t in b.column(len(names)).to_pylist()]
            at = np.zeros(len(got) + 1, np.int32)
            np.cumsum([len(x) >> 2 for x in got], out=at[1:])
            values = pa.Array.from_buffers(pa.int32(), int(at[-1]), [None, pa.py_buffer(b"".join(got))])
            ids = pa.ListArray.from_arrays(pa.array(at), values).cast(pa.list_(pa.field("element", pa.int32(), False)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], ids], names=[*names, out])

    return held.mapInArrow(run, schema)


def decode_ids(df: DataFrame, model: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Every row with all its columns, and the text of its ids in ``out``; null ids give null.

    Begin and end ids give nothing, the id of unknown pieces its mark. An id outside the
    vocabulary is an error. A column named like ``out`` is replaced.
    """
    schema = T.StructType([f for f in df.schema.fields if f.name.lower() != out.lower()] + [T.StructField(out, T.StringType())])
    names = schema.names[:-1]
    at = names.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces_of(model)
        for b in batches:
            texts = [None if x is None else p.decode(x) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*names, out])

    return df.select(*[ref(c) for c in names]).mapInArrow(run, schema)
