"""Benchmark passages in documents, by shared q-grams and banded alignment.

An item of length L stands in a document with k edits only if one stretch of it shares at
least L + 1 - q - k * q of the item's q-grams, on diagonals (document position minus item
position) that differ by at most k. Documents are scanned once: positions whose q-gram some
item has give diagonals, counted in bands twice as wide as they are apart, so that any k + 1
neighbouring diagonals lie in one band. Bands that reach the count are verified by a banded
alignment of the whole item; the others cannot hold it within its edit budget.

Texts are compared in lower case with white space reduced to single spaces. Items are a
stated query set: they are taken in blocks of bounded size, each block against all documents.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strikeline.llm.common import fresh, map_rows, ref, text_of

STRETCH = 1 << 20  # positions of a document that are hashed at a time
MARKS = 22  # bits of the first, coarse look-up
BASE = np.uint64(0x9E3779B97F4A7C15)


def plain(text: str) -> str:
    return " ".join(text.lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def gram_hashes(x: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of each run of ``q`` codes, by doubling the length."""
    if len(x) < q:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out, length, power, done, single, factor = None, 0, x + np.uint64(1), 1, x, BASE
        for bit in bin(q)[:1:-1]:
            if bit == "1":
                if out is None:
                    out, length = power, done
                else:
                    n = len(x) - length - done + 1
                    out, length = out[:n] * factor + power[length : length + n], length + done
            n = len(x) - 2 * done + 1
            if n > 0:
                power = power[:n] * factor + power[done : done + n]
            done, factor = 2 * done, factor * factor
        return out ^ (out >> np.uint64(31))


class Items:
    """A block of items with the index of their q-grams."""

    def __init__(self, ids: Sequence, texts: Sequence[str | None], q: int, rate: float) -> None:
        kept = [(i, p) for i, t in zip(ids, texts) if (p := plain(t or ""))]
        self.ids, self.texts, self.q = [i for i, _ in kept], [p for _, p in kept], q
        self.short = [k for k, p in enumerate(self.texts) if len(p) < q]
        length = np.array([len(p) for p in self.texts], np.int64)
        self.budget = np.maximum(0, np.minimum((rate * length).astype(np.int64), (length - q) // q))
        self.least = np.maximum(1, length + 1 - q - self.budget * q)
        self.width = self.budget + 1
        hashes = [gram_hashes(codes(p), q) for p in self.texts]
        count = [len(h) for h in hashes]
        every = np.concatenate([np.zeros(0, np.uint64), *hashes])
        owner, place = np.repeat(np.arange(len(kept)), count), np.concatenate([np.zeros(0, np.int64), *[np.arange(c) for c in count]])
        by = np.argsort(every, kind="stable")
        self.grams, first = np.unique(every[by], return_index=True)
        self.starts, self.owner, self.place = np.r_[first, len(by)], owner[by], place[by]
        self.marks = np.zeros(1 << MARKS, bool)
        self.marks[(self.grams >> np.uint64(64 - MARKS)).astype(np.int64)] = True

    def hits(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Item numbers and diagonals of all shared q-grams."""
        who, diagonal = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s in range(0, max(1, len(text)), STRETCH):
            h = gram_hashes(codes(text[s : s + STRETCH + self.q - 1]), self.q)
            at = np.flatnonzero(self.marks[(h >> np.uint64(64 - MARKS)).astype(np.int64)])
            if not len(at) or not len(self.grams):
                continue
            k = np.minimum(np.searchsorted(self.grams, h[at]), len(self.grams) - 1)
            same = self.grams[k] == h[at]
            at, k = at[same], k[same]
            n = self.starts[k + 1] - self.starts[k]
            post = np.repeat(self.starts[k], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            who.append(self.owner[post])
            diagonal.append(np.repeat(at + s, n) - self.place[post])
        return np.concatenate(who), np.concatenate(diagonal)

    def search(self, text: str) -> list[tuple[int, int, int, int]]:
        """Item number, edits, start and end of every place where an item stands within its budget.

        Of places of one item that overlap, the one with the fewest edits (then the first) is given.
        """
        found = []
        for k in self.short:
            at = text.find(self.texts[k])
            while at >= 0:
                found.append((k, 0, at, at + len(self.texts[k])))
                at = text.find(self.texts[k], at + 1)
        who, diagonal = self.hits(text)
        if len(who) >= (self.least.min() if len(self.least) else 1):
            band = diagonal // self.width[who]
            key = np.concatenate([who, who]), np.concatenate([band, band - 1])
            low = int(key[1].min())
            span = int(key[1].max()) - low + 1
            both, n = np.unique(key[0] * span + (key[1] - low), return_counts=True)
            k = both // span
            for i, b in zip(k[n >= self.least[k]].tolist(), (both % span + low)[n >= self.least[k]].tolist()):
                budget, width = int(self.budget[i]), int(self.width[i])
                lo = max(0, b * width - budget)
                hi = (b + 2) * width + len(self.texts[i]) + budget
                got = align(self.texts[i], text[lo:hi], budget)
                if got:
                    found.append((i, got[0], lo + got[1], lo + got[2]))
        out: list[tuple[int, int, int, int]] = []
        taken: dict[int, list[tuple[int, int]]] = {}  # by item, the places given, which do not overlap, in order
        for f in sorted(set(found)):  # fewest edits first
            mine = taken.setdefault(f[0], [])
            at = bisect_left(mine, f[2:])
            if (not at or mine[at - 1][1] <= f[2]) and (at == len(mine) or f[3] <= mine[at][0]):
                mine.insert(at, f[2:])
                out.append(f)
        return out


def align(item: str, region: str, budget: int) -> tuple[int, int, int] | None:
    """Edits, start and end of the best place of the whole item in the region, or None above the budget."""
    at = region.find(item)
    if at >= 0:
        return 0, at, at + len(item)
    if not budget or len(region) < len(item) - budget:
        return None
    edits, end = sweep(codes(item), codes(region), budget)
    if edits > budget:
        return None
    edits, length = sweep(codes(item)[::-1], codes(region[:end])[::-1], budget, True)
    return edits, end - length, end


def sweep(item: np.ndarray, region: np.ndarray, budget: int, fixed: bool = False) -> tuple[int, int]:
    """Least edits of aligning the whole item, and where it ends: a row of costs per item letter, over the
    diagonals that a place within the budget can use. ``fixed``: the place starts with the region."""
    lead = 0 if fixed else max(0, len(region) - len(item) + budget)
    left, width = budget, budget + lead + 1 + budget  # diagonals -budget .. lead + budget
    big = len(item) + len(region) + 1
    d = np.arange(width) - left
    cost = np.where((d >= 0) & (d <= len(region)), d if fixed else 0, big)
    for r in range(len(item)):
        j = d + r  # region letters used before this one
        inside = (j >= 0) & (j < len(region))
        same = np.zeros(width, bool)
        same[inside] = region[j[inside]] == item[r]
        step = np.where(inside, cost + ~same, big)
        drop = np.r_[cost[1:], big] + 1  # the item letter is missing in the region
        nxt = np.minimum(step, drop)
        nxt[(j + 1 < 0) | (j + 1 > len(region))] = big
        cost = np.minimum(nxt, np.minimum.accumulate(nxt - d) + d)  # letters that only the region has
        cost[(j + 1 < 0) | (j + 1 > len(region))] = big
        if cost.min() > budget:
            return big, 0
    k = int(np.argmin(cost))
    return int(cost[k]), int(k - left + len(item))


def spans(text: str, places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Places in the plain form as places in the text, widened to whole words."""
    out_at, own = [], []
    here = at = 0
    for word in text.split():
        at = text.index(word, at)
        out_at.append(here)
        own.append((at, at + len(word)))
        at += len(word)
        here += len(word.lower()) + 1
    first = np.searchsorted(out_at, [p for p, _ in places], "right") - 1
    last = np.searchsorted(out_at, [max(p, e - 1) for p, e in places], "right") - 1
    return [(own[a][0], own[b][1]) for a, b in zip(first.tolist(), last.tolist())]


def blocks_of(items: DataFrame, id_col: str, text_col: str, q: int, rate: float, block_chars: int) -> list[Items]:
    """The items as blocks of about ``block_chars`` characters, so that what a task holds is bounded."""
    rows = items.select(ref(id_col).alias("i"), text_of(text_col).alias("t"))
    chars = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, -(-chars // block_chars))
    out = []
    for b in range(n):
        got = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).orderBy("i", "t").collect()  # a block
        if got:
            out.append(Items([r.i for r in got], [r.t for r in got], q, rate))
    return out


def find_passages(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", q: int = 10, rate: float = 0.08, block_chars: int = 4_000_000) -> DataFrame:
    """``doc_id, item_id, edits, start, end``: one row per place of an item in a document.

    An item's budget is ``rate`` of its length in edits, less for items so short that no shared q-gram
    would be left; items under ``q`` letters must stand exactly. Places are positions in the text, widened to whole
    words. Null or empty items match nothing; null or empty documents hold nothing. Repeated rows on
    either side give a row each; null ids are kept. Extra columns are not read.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("item_id", items.schema[item_col].dataType), *[T.StructField(n, T.LongType()) for n in ("edits", "start", "end")]])
    found = docs.sparkSession.createDataFrame([], schema)
    rows = docs.select(ref(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    parts = []
    for block in blocks_of(items, item_col, item_text_col, q, rate, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            block = shared.value
            for b in batches:
                at, out = [], []
                for i, text in enumerate(b.column(1).to_pylist()):
                    got = block.search(plain(text))
                    if got:
                        at += [i] * len(got)
                        out += [(block.ids[k], e, *s) for (k, e, _, _), s in zip(got, spans(text, [(f[2], f[3]) for f in got]))]
                if out:
                    cols = list(zip(*out))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), pa.array(cols[0]), *[pa.array(c, pa.int64()) for c in cols[1:]]], names=schema.names)

        parts.append(rows.mapInArrow(run, schema))
    for p in parts:
        found = p if p is parts[0] else found.unionByName(p)
    return found


def drop_leaked(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", q: int = 10, rate: float = 0.08, block_chars: int = 4_000_000) -> DataFrame:
    """The documents that hold no item, in their own columns."""
    (leaked,) = fresh(docs, "leaked")
    for block in blocks_of(items, item_col, item_text_col, q, rate, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(texts: list[str | None], shared=shared) -> dict[str, list]:  # noqa: ANN001
            return {leaked: pa.array([bool(shared.value.search(plain(t or ""))) for t in texts], pa.bool_())}

        docs = map_rows(docs, run, [T.StructField(leaked, T.BooleanType())], text_col).where(~ref(leaked)).drop(leaked)
    return docs
