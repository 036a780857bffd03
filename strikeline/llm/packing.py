"""Hierarchical packing of documents into several context sizes.

Each document becomes its token ids plus one end id. Whole windows of the longest
context are cut off at once; what remains is routed to the shortest context that
holds it. Every tier is packed, longest piece first: the gap behind a piece is
filled with the largest pieces of the shorter tiers that fit, and closed by
cutting one more. A window that is exactly full needs no padding whatever its
tier; only the last window of a partition can be short, and is padded to the
longest context. Windows of one context size are dealt into step groups of the same
number of tokens.

Packing runs where the text is read, with a bounded pool per task: no shuffle, no
row of one document waits for another partition, and no group can become hot.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from strikeline.llm.common import ref, text_of

TIERS = (1024, 512, 256, 128)


@lru_cache(maxsize=2)
def byte_pair(path: str):  # noqa: ANN201
    """A function from text to ids (uint32 array) for a byte-level vocabulary file in JSON.

    Where merge order and id order agree, as they do for the usual files, the merges
    need no table of their own and the ranks alone decide; else the tokenizers
    library encodes. Strings of special tokens count as those tokens, as in that
    library's default.
    """
    spec = json.load(open(path, encoding="utf-8"))
    vocab, pre = spec["model"]["vocab"], spec.get("pre_tokenizer") or {}
    special = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
    plain = {k: v for k, v in vocab.items() if k not in special}
    merges = [m if isinstance(m, str) else " ".join(m) for m in spec["model"]["merges"]]
    ids = [vocab.get(m.replace(" ", "", 1)) for m in merges]
    simple = (
        pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        and None not in ids and all(a < b for a, b in zip(ids, ids[1:])) and sorted(plain.values()) == list(range(len(plain)))
        and not any(a.get("lstrip") or a.get("rstrip") or a.get("single_word") or a.get("normalized") for a in spec.get("added_tokens", []))
    )
    if not simple:
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(path)
        return lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, dtype="<u4")
    import tiktoken

    back = {c: b for b, c in _byte_letters().items()}
    ranks = {bytes(back[c] for c in k): v for k, v in plain.items()}
    # fixed values: the pattern that splits text before merging in this family of vocabularies
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    coder = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    slow: list = []  # the library itself, loaded once a text needs it

    def encode(text: str) -> np.ndarray:
        try:
            return np.asarray(coder.encode_to_numpy(text, allowed_special="all"), dtype="<u4")
        except ValueError:  # a run of white space too long for this splitter; the ids are the same
            if not slow:
                from tokenizers import Tokenizer

                slow.append(Tokenizer.from_file(path))
            return np.array(slow[0].encode(text, add_special_tokens=False).ids, dtype="<u4")

    return encode


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in such files: itself if printable Latin-1, else one from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Packer:
    """Packs pieces (key, start, length, total) into windows; emits rows of piece and place."""

    def __init__(self, tiers: Sequence[int], first: int, step_tokens: int) -> None:
        self.tiers, self.sequence, self.step_tokens = sorted(tiers), first, step_tokens
        self.first, self.windows = first, {}
        self.by_length: list[list] = [[] for _ in range(self.tiers[-1] + 1)]
        self.lengths, self.waiting, self.rows = 0, 0, []

    def add(self, key, total: int, rest: Callable[[int], tuple] | None = None) -> None:  # noqa: ANN001
        """Deal out one document: whole windows now, what remains into the pool, under the key that ``rest`` gives for its start."""
        longest, start = self.tiers[-1], 0
        while total - start >= longest:
            self._emit([(key, start, longest, total)], longest)
            start += longest
        if total > start:  # the pool keeps the rest of the ids, not those of the whole document
            self._put((rest(start) if rest and start else key, start, total - start, total))

    def _put(self, piece: tuple) -> None:
        if piece[2] in self.tiers:
            self._emit([piece], piece[2])
            return
        self.by_length[piece[2]].append(piece)
        self.lengths |= 1 << piece[2]
        self.waiting += 1

    def _take(self, length: int) -> tuple:
        piece = self.by_length[length].pop()
        if not self.by_length[length]:
            self.lengths &= ~(1 << length)
        self.waiting -= 1
        return piece

    def flush(self, last: bool) -> None:
        """Pack the pool. Pieces that fill no window stay in it, unless this is the end."""
        while self.lengths:
            piece = self._take(self.lengths.bit_length() - 1)
            size = next(t for t in self.tiers if t >= piece[2])
            members, gap = [piece], size - piece[2]
            while gap and (fits := self.lengths & ((1 << (gap + 1)) - 1)):
                members.append(self._take(fits.bit_length() - 1))
                gap -= members[-1][2]
            if gap and self.lengths:
                key, start, length, total = self._take((self.lengths & -self.lengths).bit_length() - 1)
                members.append((key, start, gap, total))
                gap = 0
                self._put((key, start + members[-1][2], length - members[-1][2], total))
            if not gap:
                self._emit(members, size)
            elif last:
                self._emit(members, self.tiers[-1])
            else:
                for m in members:
                    self._put(m)
                return

    def _emit(self, members: list[tuple], size: int) -> None:
        nth = self.windows.get(size, 0)
        self.windows[size] = nth + 1
        group, offset = self.first + nth // max(1, self.step_tokens // size), 0
        for key, start, length, total in members:
            self.rows.append((key, start, length, total, self.sequence, offset, size, group))
            offset += length
        self.sequence += 1


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", tiers: Sequence[int] = TIERS, end_id: int = 0, step_tokens: int = 16384, pool: int = 4096) -> DataFrame:
    """Pack all documents; one row per piece, with its token ids.

    Columns: ``doc_id, start, length, doc_tokens, sequence_id, offset, context,
    step_group, ids``. ``ids`` holds little-endian unsigned 32-bit ids. A step group
    is (context, step_group): windows of that size with ``step_tokens`` tokens in all
    but the last group of each partition. ``tiers`` are powers of two.

    Null or empty text is the end id alone. A null document id is kept. Repeated rows
    are packed each. Other columns, whatever their names, are not read. Without rows
    the result is empty. Sequence numbers are unique, not gapless, and depend on how
    the input is split.
    """
    if any(t < 1 or t & (t - 1) for t in tiers):
        raise ValueError("context sizes must be powers of two")
    kind = docs.schema[id_col].dataType
    schema = T.StructType([
        T.StructField("doc_id", kind), *[T.StructField(n, T.LongType()) for n in ("start", "length", "doc_tokens", "sequence_id", "offset")],
        T.StructField("context", T.IntegerType()), T.StructField("step_group", T.LongType()), T.StructField("ids", T.BinaryType()),
    ])
    tiers, held = tuple(tiers), 1 << 22

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_pair(vocabulary)
        packer = Packer(tiers, TaskContext.get().partitionId() << 36, step_tokens)
        tail = np.array([end_id], dtype="<u4")
        size, arrow = 0, None
        for b in batches:
            arrow = b.schema.field(0).type
            for doc, text in zip(b.column(0), b.column(1).to_pylist()):
                ids = np.concatenate([encode(text), tail])
                data = ids.tobytes()
                packer.add((doc, data, 0), len(ids), lambda start, doc=doc, data=data: (doc, data[4 * start :], start))
                size += len(ids)
                if packer.waiting >= pool:
                    packer.flush(False)
                if size >= held:
                    yield from out(packer, arrow)
                    size = 0
        if arrow is not None:
            packer.flush(True)
            yield from out(packer, arrow)

    def out(packer: Packer, arrow: pa.DataType) -> Iterator[pa.RecordBatch]:
        rows, packer.rows = packer.rows, []
        for i in range(0, len(rows), 8192):
            part = rows[i : i + 8192]
            cols = list(zip(*part))
            keys = pa.array([k[0].as_py() for k in cols[0]], arrow)
            ids = pa.array([k[1][4 * (s - k[2]) : 4 * (s - k[2] + n)] for k, s, n in zip(cols[0], cols[1], cols[2])], pa.binary())
            longs = [pa.array(c, pa.int64()) for c in cols[1:6]]
            yield pa.RecordBatch.from_arrays([keys, *longs, pa.array(cols[6], pa.int32()), pa.array(cols[7], pa.int64()), ids], names=schema.names)

    return docs.select(ref(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, schema)
