"""Non-overlapping picks over groups of any size.

Holding one position at a time, a group's rows form links: from a row that is taken to the first row
that starts at or after its end (or the next one, where it leaves the position free). The picks are
the chain from the first row. Its length does not matter here: every slice of a group follows its own links
once, from back to front, and knows for each row where a chain that enters there leaves the slice; rows that are
entered from other slices are joined by these jumps, jumps are doubled, and the entered rows
that the first row reaches are found in logarithmically many joins; then each slice walks from the row it is entered at.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strikeline.operators.asof import asof_join
from strikeline.operators.slicing import null_safe_join
from strikeline.plans.tables import settle


def links_of(start: np.ndarray, end: np.ndarray, free: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """For rows in order: the next row of a chain through each; ``len`` where it leaves the slice, -1 where it ends.

    ``free``: the row leaves the position free. ``end`` may be the lowest value for none: then any next row is free.
    """
    n = len(start)
    after = np.arange(1, n + 1)
    to = np.where(free, after, np.maximum(after, np.searchsorted(start, end, side="left")))
    return np.where(stop & ~free, -1, to)


def non_overlapping_sliced(
    slots: DataFrame, group: Sequence[str], start: str, end: str, take: Sequence[str], slice_seconds: int,
    stop_after: Column | None = None, passive: Column | None = None, passive_locks: bool = False,
) -> DataFrame:
    """The picks of ``selection.non_overlapping``, for groups of any number of rows.

    ``start`` and ``end`` are timestamps; rows go by start, then end, then the columns of ``take``. A picked row for
    which ``stop_after`` holds ends its group; ``passive`` rows are recorded but leave the position
    free, or hold it as well if ``passive_locks``. A NULL end frees the position at once; rows without a start
    are left out. Slices of ``slice_seconds`` are the unit of work.
    """
    no = F.lit(False)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    names = list(dict.fromkeys([*group, *take]))
    rows = slots.where(F.col(start).isNotNull()).select(
        F.struct(*[F.col(c) for c in group]).alias("_g"), F.struct(*[F.col(c) for c in names]).alias("_row"), F.struct(*[F.col(c) for c in take]).alias("_tie"), micros(start).alias("_s"), micros(end).alias("_e"),
        F.coalesce(stop_after if stop_after is not None else no, no).alias("_stop"), F.coalesce(passive if passive is not None else no, no).alias("_idle"))
    width, in_slice = slice_seconds * 1_000_000, W.partitionBy("_g", "_slice").orderBy("_s", "_e", "_stop", "_idle", "_tie")
    rows = settle(rows.withColumn("_slice", F.floor(F.col("_s") / width).cast("long")).withColumn("_id", F.monotonically_increasing_id()).withColumn("_r", F.row_number().over(in_slice)), "slots")

    exits = settle(_exits(rows, passive_locks, width), "exits")
    # where a chain goes on: the first row at or after the time at which it leaves a slice
    stamp = lambda c: F.timestamp_micros(F.col(c))
    firsts = rows.groupBy("_g", "_slice").agg(F.min(F.struct("_s", "_e", "_stop", "_idle", "_tie", "_id")).alias("_m"), F.min("_s").alias("_s"))
    left = exits.where("_out IS NOT NULL").select("_g", "_out").distinct().withColumn("_t", stamp("_out"))
    starts = rows.select("_g", stamp("_s").alias("_t"), "_s")
    entered = settle(asof_join(left, starts, ["_g"], "_t", "_t", {"_to_s": "_s"}, "forward", slice_seconds=slice_seconds).where("_to_s IS NOT NULL").select("_g", "_out", "_to_s"), "entered")
    ranked = rows.join(entered.select("_g", F.col("_to_s").alias("_s")).distinct(), ["_g", "_s"], "left_semi")
    heads = ranked.groupBy("_g", "_s").agg(F.min(F.struct("_e", "_stop", "_idle", "_tie", "_id")).alias("_m")).select("_g", "_s", F.col("_m._id").alias("_to"))
    targets = entered.join(heads, (entered["_g"] == heads["_g"]) & (entered["_to_s"] == heads["_s"])).select(entered["_g"], "_out", "_to")
    roots = firsts.groupBy("_g").agg(F.min(F.struct("_m._s", "_m._e", "_m._stop", "_m._idle", "_m._tie", "_m._id")).alias("_m")).select(F.col("_m._id").alias("_id"))
    nodes = targets.select(F.col("_to").alias("_id")).unionByName(roots).distinct()
    hops = exits.join(nodes, "_id", "left_semi").where("_out IS NOT NULL").join(targets, ["_g", "_out"]).select("_id", "_to")
    reached = _reached(settle(hops, "hops"), settle(roots, "roots"), rows.groupBy("_g").agg(F.count_distinct("_slice").alias("n")).agg(F.max("n")).first()[0] or 0)
    entries = rows.join(reached, "_id", "left_semi").select("_g", "_slice", F.col("_id").alias("_entry"))
    taken = _walk(rows, entries, passive_locks)
    return rows.join(taken, "_id").select("_row.*", F.col("_idle").alias("passive"))


NONE = -(1 << 62)  # before every time: the end of a row that frees the position at once


def _by_slice(rows: DataFrame):  # noqa: ANN202
    """Slices of groups, one at a time: grouping keeps a slice whole whatever is re-planned at run time."""
    return rows.select("_g", "_slice", "_r", "_id", "_s", F.coalesce("_e", F.lit(NONE)).alias("_e"), "_stop", "_idle", *[c for c in rows.columns if c == "_entry"]).groupBy("_g", "_slice")


def _columns(group: pa.Table, locks: bool) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Columns of a slice in order, whether rows leave the position free, and their links."""
    group = group.sort_by("_r")
    x = {n: group.column(n).to_numpy() for n in group.column_names if n != "_g"}
    free = x["_idle"].astype(bool) & (not locks)
    return x, free, links_of(x["_s"], x["_e"], free, x["_stop"].astype(bool))


def _exits(rows: DataFrame, locks: bool, width: int) -> DataFrame:
    """``_id, _g, _out``: the time from which a chain through each row goes on behind its slice; NULL where it ends."""

    def run(group: pa.Table) -> pa.Table:
        x, free, links = _columns(group, locks)
        n, to = len(links), links.tolist()
        border = (int(x["_slice"][0]) + 1) * width
        out: list[int | None] = [None] * n
        held = np.where(free, border, np.maximum(x["_e"], border)).tolist()
        for i in range(n - 1, -1, -1):
            out[i] = None if to[i] < 0 else held[i] if to[i] >= n else out[to[i]]
        return pa.table({"_id": x["_id"], "_out": pa.array(out, pa.int64())})

    found = _by_slice(rows).applyInArrow(run, "_id long, _out long")
    return rows.select("_id", "_g").join(found, "_id")


def _reached(hops: DataFrame, roots: DataFrame, slices: int) -> DataFrame:
    """Rows that chains from the roots enter, by doubled jumps: after the k-th table, jumps of 2^k slices."""
    tables, step = [hops], 1
    while step < slices:
        far = tables[-1]
        tables.append(settle(far.join(far.select(F.col("_id").alias("_to"), F.col("_to").alias("_next")), "_to").select("_id", F.col("_next").alias("_to")), "jumps"))
        step *= 2
    reached = roots
    for table in reversed(tables):
        reached = settle(reached.unionByName(reached.join(table, "_id").select(F.col("_to").alias("_id"))).distinct(), "reached")
    return reached


def _walk(rows: DataFrame, entries: DataFrame, locks: bool) -> DataFrame:
    """``_id`` of the rows that a chain takes in each entered slice."""

    def run(group: pa.Table) -> pa.Table:
        x, _, links = _columns(group, locks)
        at, taken = int(np.flatnonzero(x["_id"] == x["_entry"])[0]), []
        while 0 <= at < len(links):
            taken.append(at)
            at = int(links[at])
        return pa.table({"_id": x["_id"][taken]})

    return _by_slice(rows.join(entries, ["_g", "_slice"])).applyInArrow(run, T.StructType([T.StructField("_id", T.LongType())]))
