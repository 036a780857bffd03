"""Percentile ranks within long trailing frames.

Counting, for every row, the values of its last K rows that lie below its own is offline dominance counting.
Rows are numbered across the whole key, dealt into chunks with the K - 1 rows before them, and each
chunk answers all its rows at once from a wavelet matrix: values become ranks, one bit plane per
binary digit holds prefix counts of zeros, and a frame is narrowed plane by plane. That
costs log(chunk) array steps per chunk, whatever K is; no list of K values is built per row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strikeline.operators.slicing import SLICE, row_index


def counts_in_frames(values: np.ndarray, start: np.ndarray, stop: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each asked position: values of ``[start, stop)`` below the one there, and equal to it (NaN is the largest, and one value)."""
    ranks = np.unique(values, return_inverse=True)[1].reshape(-1)
    bits = max(1, int(ranks.max(initial=0)).bit_length())
    want, lo, hi, below, plane = ranks[asked], start.copy(), stop.copy(), np.zeros(len(asked), np.int64), ranks
    for bit in reversed(range(bits)):
        ones = (plane >> bit) & 1
        zeros = np.r_[0, np.cumsum(1 - ones)]
        up = ((want >> bit) & 1).astype(bool)
        lo0, hi0 = zeros[lo], zeros[hi]
        below += np.where(up, hi0 - lo0, 0)
        lo, hi = np.where(up, zeros[-1] + lo - lo0, lo0), np.where(up, zeros[-1] + hi - hi0, hi0)
        plane = np.concatenate([plane[ones == 0], plane[ones == 1]])
    return below, hi - lo


def rank_over_ticks(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, rows: int, min_periods: int, rank: str | None = "pct_rank", share: str | None = "share_le",
    slice_col: str = SLICE, scale: float = 1.0, chunk_rows: int = 100_000,
) -> DataFrame:
    """Average-rank percentile of each value within its last ``rows`` rows, and the share of these at or below it.

    The values of ``windows.pct_rank_of_last`` and ``windows.share_at_or_below``, for frames and keys of any
    size. NULL values are not counted and get NULL; so do rows with fewer than ``min_periods`` values in their frame.
    Other rows and columns stay. A chunk holds ``chunk_rows`` rows of one key, or ``rows`` if that is more, and a frame
    before them, so memory is set by the frame asked for. ``order`` must be unique per key.
    """
    chunk_rows = max(chunk_rows, rows)
    x = row_index(df, keys, order, slice_col)
    own = F.floor(F.col("_rn") / chunk_rows).cast("long")
    halo = (F.col("_rn") % chunk_rows) >= (chunk_rows - (rows - 1))
    spread = x.withColumn("_own", own).withColumn("_chunk", F.explode(F.when(halo, F.array(own, own + 1)).otherwise(F.array(own))))
    spread = spread.withColumn("_value", F.col(value).cast("double")).withColumn("_key", F.struct(*[F.col(k) for k in keys]) if keys else F.lit(0))
    added = [n for n in (rank, share) if n]
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in added]])
    names = df.columns

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("_rn")
        at, own_chunk, mine = (group.column(c).to_numpy() for c in ("_rn", "_own", "_chunk"))
        held = group.column("_value")
        there = ~np.asarray(held.combine_chunks().is_null())
        v = held.to_numpy()[there].astype(float)
        before = np.r_[0, np.cumsum(there)]
        asked_rows = np.flatnonzero(there & (own_chunk == mine))
        first = np.searchsorted(at, at[asked_rows] - (rows - 1))
        start, stop = before[first], before[asked_rows + 1]
        below, equal = counts_in_frames(v, start, stop, before[asked_rows])
        seen = stop - start
        enough = seen >= max(1, min_periods)
        found = {"rank": (below + (equal + 1) / 2.0) / seen * scale, "share": (below + equal) / seen}
        keep = np.flatnonzero(own_chunk == mine)
        place = np.searchsorted(keep, asked_rows)
        out = group.select(names).take(pa.array(keep))
        for name, kind in ((rank, "rank"), (share, "share")):
            if name:
                full, none = np.zeros(len(keep)), np.ones(len(keep), bool)
                full[place], none[place] = found[kind], ~enough
                out = out.append_column(name, pa.array(full, mask=none))
        return out

    return spread.groupBy("_key", "_chunk").applyInArrow(run, schema)
