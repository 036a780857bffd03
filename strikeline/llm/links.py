"""Buckets of candidates and components of links.

Rows meet in buckets. A bucket with more than ``most`` rows is cut into chunks and
dealt to cells, one per pair of chunks: every two of its rows meet in a cell, and no
cell holds more than two chunks. A task sees its cells sorted, one after another.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikeline.plans.tables import settle

PAIRS = 4_000_000  # of a cell that are listed at a time
AT_ONCE = 64  # rows of a cell up to which every pair is checked in one sweep over all cells


def cells(rows: DataFrame, key: str, member: str, most: int, counted: DataFrame | None = None) -> DataFrame:
    """Add ``cell``: 0 for a bucket of ordinary size, else the numbers of the cells a row stands in.

    ``counted``: ``key, _n`` where the sizes of buckets are known or estimated in another way; they
    decide how the rows are dealt, not which of them meet.
    """
    counted = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")) if counted is None else counted
    large = settle(counted.where(F.col("_n") > most), "large")
    if large.isEmpty():
        return rows.withColumn("cell", F.lit(0).cast("long"))
    parts = F.coalesce(F.ceil(F.col("_n") / most), F.lit(1)).cast("long")
    own = F.pmod(F.xxhash64(F.lit("chunk"), member), F.col("_parts"))
    out = rows.join(large, key, "left").withColumn("_parts", parts).withColumn("_own", own)
    spread = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1), lambda s: F.least(s, "_own") * F.col("_parts") + F.greatest(s, "_own"))
    return out.withColumn("cell", F.explode(spread)).drop("_n", "_parts", "_own")


def per_cell(rows: DataFrame, key: str, fn: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """Bring the rows of each (key, cell) together and give ``fn`` whole cells, sorted, with the starts of each."""
    names = rows.columns
    at, cell = names.index(key), names.index("cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.RecordBatch | None = None
        for b in batches:
            if rest is not None:
                b = pa.Table.from_batches([rest, b]).combine_chunks().to_batches()[0]
            starts = bounds(b)
            if len(starts) == 1:
                rest = b
                continue
            last = int(starts[-1])
            rest = b.slice(last)
            yield fn(b.slice(0, last), starts[:-1])
        if rest is not None and rest.num_rows:
            yield fn(rest, bounds(rest))

    def bounds(b: pa.RecordBatch) -> np.ndarray:
        k, c = b.column(at).to_numpy(), b.column(cell).to_numpy()
        return np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])])

    return rows.repartition(key, "cell").sortWithinPartitions(key, "cell").mapInArrow(run, schema)


def close_pairs(starts: np.ndarray, values: np.ndarray, own: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows within cells whose values differ in at most ``distance`` bits, one of them standing in the
    bucket itself (``own``). From a cell with more than ``PAIRS`` of them, enough to connect what they connect;
    the third array marks these."""
    n = len(values)
    ends = np.r_[starts[1:], n]
    sizes = ends - starts
    left, right, joined = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    last = np.repeat(np.where(sizes <= AT_ONCE, ends, starts), sizes)  # rows of large cells get no partner here
    rows = np.arange(n)
    for lag in range(1, AT_ONCE):
        rows = rows[rows + lag < last[rows]]
        if not len(rows):
            break
        found = rows[(own[rows] | own[rows + lag]) & (np.bitwise_count(values[rows] ^ values[rows + lag]) <= distance)]
        left.append(found)
        right.append(found + lag)
        joined.append(np.zeros(len(found), bool))
    for s, e in zip(starts[sizes > AT_ONCE].tolist(), ends[sizes > AT_ONCE].tolist()):
        all_rows, home, total, got, all_listed = values[s:e], np.flatnonzero(own[s:e]), 0, [], True
        for k in range(0, len(home), 256):
            part = home[k : k + 256]
            i, j = np.nonzero(np.bitwise_count(all_rows[part, None] ^ all_rows[None, :]) <= distance)
            i = part[i]
            fresh = ((i < j) | ~own[s:e][j]) & (i != j)
            got.append((i[fresh], j[fresh]))
            total += int(fresh.sum())
            if total > PAIRS:
                got, all_listed = [_connect(all_rows, distance)], False
                break
        for i, j in got:
            left.append(i + s)
            right.append(j + s)
            joined.append(np.full(len(i), not all_listed))
    return np.concatenate(left), np.concatenate(right), np.concatenate(joined)


def _connect(values: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect whatever is connected by close pairs, found without listing all of them."""
    left, right, waiting = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.arange(len(values))
    while len(waiting) > 1:
        queue, waiting = [int(waiting[0])], waiting[1:]
        while queue and len(waiting):
            pivot = queue.pop()
            ok = np.bitwise_count(values[waiting] ^ values[pivot]) <= distance
            found = waiting[ok]
            left.append(np.full(len(found), pivot))
            right.append(found)
            queue += found.tolist()
            waiting = waiting[~ok]
    return np.concatenate(left), np.concatenate(right)


def thin(left: np.ndarray, right: np.ndarray, joined: np.ndarray, values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same pairs; but from cells with more than two a row, each row's nearest, and a spanning forest. The third
    array marks pairs of cells of which pairs are missing, here or before (``joined``)."""
    cell = np.searchsorted(starts, left, "right") - 1
    sizes = np.diff(np.r_[starts, len(values)])
    counts = np.bincount(cell, minlength=len(starts))
    heavy = counts > 2 * sizes
    keep = ~heavy[cell]
    out, missing = [(left[keep], right[keep])], [joined[keep]]
    for c in np.flatnonzero(heavy).tolist():
        mine = cell == c
        a, b = np.concatenate([left[mine], right[mine]]), np.concatenate([right[mine], left[mine]])
        by = np.lexsort((np.bitwise_count(values[a] ^ values[b]), a))
        a, b = a[by], b[by]
        nodes, first = np.unique(a, return_index=True)
        out.append((nodes, b[first]))
        stop = np.r_[first[1:], len(a)]
        at = {int(x): k for k, x in enumerate(nodes)}
        seen = np.zeros(len(values), bool)
        for root in nodes.tolist():
            if seen[root]:
                continue
            seen[root], queue = True, [root]
            while queue:
                x = queue.pop()
                near = b[first[at[x]] : stop[at[x]]]
                near = np.unique(near[~seen[near]])
                seen[near] = True
                out.append((np.full(len(near), x), near))
                queue += near.tolist()
    missing += [np.ones(len(x), bool) for x, _ in out[1:]]
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out]), np.concatenate(missing)


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, root``: for every node that has a link, the smallest node it is connected with.

    Alternates between tying each node's larger neighbours to its smallest one and tying
    its smaller neighbours together, until nothing changes: few rounds, whatever the
    shape. Every round is a written table, so no lineage grows and no task repeats more
    than one round. Smallest neighbours are found with a partial aggregate.
    """
    x, y = F.col(a), F.col(b)
    edges = settle(links.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "links")
    before = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == before:
            break
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = settle(large.where(F.col("u") != F.col("v")), "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.withColumnRenamed("m", "v"))
        edges = settle(small.where(F.col("u") != F.col("v")).distinct(), "small-star")
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
