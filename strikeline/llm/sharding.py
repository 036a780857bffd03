"""Contiguous shards of nearly equal size whose largest is as small as can be.

Documents with equal texts are one atomic group; groups stand in the order of their
smallest id. A capacity is feasible if filling shards from the left, each as far as
the capacity goes, needs no more shards than there are. The smallest feasible
capacity is found by bisection.

The sequence of groups may be far longer than a driver can hold, but the places of
the cuts are few. So the bisection works on blocks of the sequence (ranges of the
order key with their sums). A block is opened into smaller ones only if, for some
capacity still possible, a cut could fall into it; a closed one can be treated as a
single item without changing any answer. The driver holds a bounded number of
blocks at each level.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strikeline.llm.common import ref, text_of
from strikeline.plans.tables import settle


@dataclass(frozen=True)
class Block:
    """Groups with ``first <= key <= last``: how many, their bytes, and the largest."""

    first: int
    last: int
    groups: int
    size: int
    largest: int


def cuts_at(capacity: int, ends: list[int], shards: int) -> list[int] | None:
    """Numbers of items in front of each cut when every shard is filled up to the capacity; None if they don't suffice.

    ``ends``: running sums of the items.
    """
    at, out, total = 0, [], ends[-1] if ends else 0
    for _ in range(shards):
        filled = ends[at - 1] if at else 0
        if filled == total:
            break
        nxt = bisect_right(ends, filled + capacity)
        if nxt == at:
            return None
        at = nxt
        out.append(at)
    return out if not ends or at == len(ends) else None


def smallest_capacity(ends: list[int], shards: int, least: int) -> int:
    """The smallest feasible capacity of at least ``least``, by bisection."""
    low, high = least, max(least, ends[-1] if ends else 0)
    while low < high:
        mid = (low + high) // 2
        if cuts_at(mid, ends, shards) is None:
            low = mid + 1
        else:
            high = mid
    return low


def open_blocks(blocks: list[Block], shards: int, low: int, high: int) -> list[int]:
    """Numbers of the blocks that a cut could fall into for some capacity from ``low`` to ``high``."""
    ends = list(accumulate(b.size for b in blocks))
    total, least, most, found = ends[-1], 0, 0, set()
    for _ in range(shards - 1):
        most = min(total, most + high)
        at = min(bisect_left(ends, min(total, least + low)), len(blocks) - 1)
        before = ends[at] - blocks[at].size
        least = max(before, min(total, least + low) - blocks[at].largest)
        first, last = bisect_right(ends, least), min(bisect_left(ends, most), len(blocks) - 1)
        found.update(i for i in range(first, last + 1) if blocks[i].groups > 1)
        if least >= total:
            break
    return sorted(found)


def even_cuts(ends: list[int], shards: int, capacity: int) -> list[int]:
    """Cuts within the capacity, each as near as possible to an even share of what is left.

    Filling every shard to the capacity leaves the last ones short or empty where one group
    is far larger than an even share; this moves cuts to the left without passing the capacity.
    """
    n, total = len(ends), ends[-1] if ends else 0
    starts, at = [n], n  # fewest items in front of each cut, from the right
    for _ in range(shards):
        need = (ends[at - 1] if at else 0) - capacity
        at = 0 if need <= 0 else bisect_left(ends, need) + 1
        starts.append(at)
    out, at = [], 0
    for k in range(shards, 1, -1):
        filled = ends[at - 1] if at else 0
        target = filled + (total - filled) / k
        lo, hi = max(at, starts[k - 1]), bisect_right(ends, filled + capacity)
        near = bisect_left(ends, target)
        if near < n and ends[near] - target <= target - (ends[near - 1] if near else 0):
            near += 1
        at = min(max(near, lo), hi)
        out.append(at)
    return [*out, n]


def find_cuts(groups: DataFrame, shards: int, fanout: int = 4096, most: int = 50_000) -> list[int]:
    """Order keys at which shards 1, 2, ... begin, for ``groups(key long, size long)`` with distinct keys."""
    span = groups.agg(F.min("key"), F.max("key"), F.sum("size"), F.max("size")).first()
    if span[0] is None:
        return []
    low_key, shift = span[0], max(0, (span[1] - span[0]).bit_length() - fanout.bit_length() + 1)
    offset = F.col("key").cast("decimal(20,0)") - F.lit(low_key).cast("decimal(20,0)")

    def cell(s: int) -> F.Column:
        return F.floor(offset / F.lit(2**s).cast("decimal(20,0)")).cast("decimal(20,0)")

    def load(s: int | None, within: DataFrame) -> list[Block]:
        by = F.col("key") if s is None else cell(s)
        rows = within.groupBy(by.alias("b")).agg(F.min("key"), F.max("key"), F.count(F.lit(1)), F.sum("size"), F.max("size"))
        return sorted((Block(r[1], r[2], r[3], r[4], r[5]) for r in rows.collect()), key=lambda b: b.first)  # at most fanout ranges, or most groups

    blocks = load(shift, groups)
    while True:
        low = max(-(-span[2] // shards), span[3])
        high = smallest_capacity(list(accumulate(b.size for b in blocks)), shards, low)
        opened = open_blocks(blocks, shards, low, high)
        if not opened:
            break
        count = sum(blocks[i].groups for i in opened)
        ids = sorted({int((blocks[i].first - low_key) >> shift) for i in opened})
        inside = groups.where(cell(shift).isin(ids))
        direct = count <= most or shift == 0
        step = max(1, (fanout // len(ids)).bit_length() - 1)
        shift = max(0, shift - step)
        finer = load(None if direct else shift, inside)
        keep = set(range(len(blocks))) - set(opened)
        reopened = {(blocks[i].first, blocks[i].last) for i in opened}
        spans = sorted(reopened)
        firsts = [s for s, _ in spans]
        inner = [b for b in finer if (i := bisect_right(firsts, b.first) - 1) >= 0 and b.last <= spans[i][1]]
        blocks = sorted([blocks[i] for i in keep] + inner, key=lambda b: b.first)
        if direct:
            high = smallest_capacity(list(accumulate(b.size for b in blocks)), shards, low)
            break
    cuts = even_cuts(list(accumulate(b.size for b in blocks)), shards, high)
    return [blocks[c].first if c < len(blocks) else None for c in cuts[:-1]]


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", slot_rows: int = 50_000) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot``: one row per document.

    ``size`` is the text's bytes in UTF-8 plus 1. Null text counts as empty: size 1, checksum 0,
    one group with empty texts. Null ids order first. Repeated rows are one group and get a slot
    each. Other columns are not read. Without rows the result is empty. Shards can be empty where
    there are fewer groups than shards.
    """
    kind = docs.schema[id_col].dataType
    text = F.encode(text_of(text_col), "UTF-8")
    rows = docs.select(ref(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("digest"))
    rows = settle(rows, "sized")
    own = F.min("doc_id").cast("long") if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) else F.xxhash64(F.min("doc_id").cast("string"))
    texts = settle(rows.groupBy("digest").agg(F.coalesce(own, F.lit(-(2**63))).alias("key"), F.sum("size").alias("size")), "groups")
    cuts = [c for c in find_cuts(settle(texts.groupBy("key").agg(F.sum("size").alias("size")), "ordered"), shards)]
    number = F.lit(0)
    for c in cuts:
        if c is not None:
            number = number + (F.col("key") >= F.lit(c)).cast("int")
    placed = rows.join(texts.select("digest", number.cast("int").alias("shard")), "digest").drop("digest")
    bins = max(1, -(-rows.count() // slot_rows))
    placed = settle(placed.withColumn("bin", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(bins))), "placed")
    before = placed.groupBy("shard", "bin").agg(F.count(F.lit(1)).alias("n"))
    before = before.withColumn("base", F.sum("n").over(W.partitionBy("shard").orderBy("bin")) - F.col("n")).drop("n")  # one row per slot_rows rows
    nth = F.row_number().over(W.partitionBy("shard", "bin").orderBy("doc_id", "text_crc32", "size"))
    slots = placed.withColumn("nth", nth).join(before, ["shard", "bin"])
    return slots.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("nth") - 1).cast("long").alias("slot"))
