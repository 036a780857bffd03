"""First-touch races over time paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strikeline.functions.scalar import epoch_seconds


def first_touch(
    entries: DataFrame, path: DataFrame, on: Sequence[str], key: Sequence[str], entry_time: str, end_time: str,
    path_time: str, value: str, levels: Sequence[tuple[str, str, str]], slice_seconds: int, dense: bool = False,
) -> DataFrame:
    """When does a path first reach each of an entry's own levels?

    ``levels`` holds (name, ">=" or "<=", level column). Only path points strictly
    after the entry and at or before its end count. The path is summarised per
    (key, time slice) first: an entry looks at slice extremes, and rows are
    matched only in its border slices and in the first slice that reaches a
    level. Keys are split along time, so one hot key spreads over many tasks.
    ``key`` must be unique per entry.

    On a bar grid a slice holds few rows and a plain join matches them. For raw
    ticks set ``dense``: each (key, slice) is then searched in sorted arrays, so the
    cost per slice grows with its rows times a logarithm, never with pairs.

    Path times are unique per key on a bar grid; of ticks with equal times the smaller value comes first.

    Returns ``key`` plus ``<name>_t``, ``<name>_v`` per level and ``last_t``,
    ``last_v``, the final point in range. Entries without any point drop out.
    """
    if {op for _, op, _ in levels} - {">=", "<="}:
        raise ValueError("levels use >= or <=")

    def slot(c: Column | str) -> Column:
        return F.floor(epoch_seconds(c) / slice_seconds).cast("long")

    points = path.where(F.col(value).isNotNull()).select(
        *on, F.col(path_time).alias("_t"), F.col(value).alias("_v"), slot(path_time).alias("_s")
    )
    extremes = points.groupBy(*on, "_s").agg(
        F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.min("_t").alias("_t0"), F.max("_t").alias("_t1")
    )
    lv = {name: F.col(c) for name, _, c in levels}
    asks = entries.select(
        *dict.fromkeys([*on, *key]), F.col(entry_time).alias("_a"), F.col(end_time).alias("_z"),
        *[lv[n].alias(f"_lv_{n}") for n, _, _ in levels],
    ).where(F.col("_z") > F.col("_a"))
    seen = asks.withColumn("_s", F.explode(F.sequence(slot("_a"), slot("_z")))).join(extremes, [*on, "_s"], "inner")
    border = (F.col("_s") == slot("_a")) | (F.col("_s") == slot("_z"))

    def reached(name: str, op: str) -> Column:
        return F.col("_hi") >= F.col(f"_lv_{name}") if op == ">=" else F.col("_lo") <= F.col(f"_lv_{name}")

    # a border slice is opened only if its extremes reach some level; the last slice with a point in range always is
    some = F.lit(False)
    for n, op, _ in levels:
        some = some | reached(n, op)
    in_range = (F.col("_t0") <= F.col("_z")) & (F.col("_t1") > F.col("_a"))
    carry = ["_a", "_z", *[f"_lv_{n}" for n, _, _ in levels]]
    group = list(dict.fromkeys([*on, *key]))
    picks = seen.groupBy(*group).agg(
        *[F.first(c).alias(c) for c in carry],
        F.min(F.when(border & some, F.col("_s"))).alias("_b0"),
        F.max(F.when(border & some, F.col("_s"))).alias("_b1"),
        F.max(F.when(in_range, F.col("_s"))).alias("_f"),
        *[F.min(F.when(~border & reached(n, op), F.col("_s"))).alias(f"_h_{n}") for n, op, _ in levels],
    )
    slots = F.array_distinct(F.array_compact(F.array("_b0", "_b1", "_f", *[f"_h_{n}" for n, _, _ in levels])))
    near = picks.withColumn("_s", F.explode(slots)).drop("_b0", "_b1", "_f", *[f"_h_{n}" for n, _, _ in levels])
    if dense:
        found = _search(near, points, on, key, levels)
        return found.groupBy(*key).agg(
            *[c for n, _, _ in levels for c in (F.min(f"{n}_t").alias(f"{n}_t"), F.min_by(f"{n}_v", f"{n}_t").alias(f"{n}_v"))],
            F.max("last_t").alias("last_t"), F.max_by("last_v", "last_t").alias("last_v"),
        ).where(F.col("last_t").isNotNull())
    rows = near.join(points, [*on, "_s"], "inner").where((F.col("_t") > F.col("_a")) & (F.col("_t") <= F.col("_z")))

    def at(name: str, op: str) -> Column:
        level = F.col(f"_lv_{name}")
        return F.when(F.col("_v") >= level if op == ">=" else F.col("_v") <= level, F.col("_t"))

    # times and values are fixed-width buffers, so this stays a hash aggregate
    return rows.groupBy(*key).agg(
        *[c for n, op, _ in levels for c in (F.min(at(n, op)).alias(f"{n}_t"), F.min_by("_v", at(n, op)).alias(f"{n}_v"))],
        F.max("_t").alias("last_t"), F.max_by("_v", "_t").alias("last_v"),
    )


def _search(near: DataFrame, points: DataFrame, on: Sequence[str], key: Sequence[str], levels: Sequence[tuple[str, str, str]]) -> DataFrame:
    """First reach of each level inside each (key, slice), by doubling over block extremes."""
    kinds = {f.name: f.dataType for f in near.schema.fields}
    time, number = points.schema["_t"].dataType, T.DoubleType()
    fields = [T.StructField(k, kinds[k]) for k in key]
    for n in [n for n, _, _ in levels] + ["last"]:
        fields += [T.StructField(f"{n}_t", time), T.StructField(f"{n}_v", number)]
    ops = [(n, op) for n, op, _ in levels]

    def run(asks, path):  # noqa: ANN001, ANN202
        import numpy as np
        import pandas as pd

        out = asks[list(key)].copy()
        path = path.sort_values(["_t", "_v"], kind="stable")
        t, v = path["_t"].to_numpy(), path["_v"].to_numpy(dtype=float)
        lo = np.searchsorted(t, asks["_a"].to_numpy(), side="right")
        hi = np.searchsorted(t, asks["_z"].to_numpy(), side="right")

        def put(name, pos, ok):  # noqa: ANN001
            safe = np.where(ok, pos, 0)
            blank = len(v) == 0
            out[f"{name}_t"] = pd.Series(pd.NaT if blank else t[safe], index=out.index).where(ok)
            out[f"{name}_v"] = np.nan if blank else np.where(ok, v[safe], np.nan)

        for sign in (1.0, -1.0):
            mine = [n for n, op in ops if (op == ">=") == (sign > 0)]
            if not mine or len(v) == 0:
                continue
            blocks = [sign * v]
            while len(blocks[-1]) > 1:
                half = 1 << (len(blocks) - 1)
                last = blocks[-1]
                blocks.append(np.maximum(last, np.concatenate([last[half:], np.full(min(half, len(last)), -np.inf)])))
                if half * 2 >= len(v):
                    break
            for n in mine:
                want, pos = sign * asks[f"_lv_{n}"].to_numpy(dtype=float), lo.copy()
                for k in reversed(range(len(blocks))):
                    inside = pos < len(v)
                    miss = inside & ~(blocks[k][np.where(inside, pos, 0)] >= want)
                    pos = np.where(miss, pos + (1 << k), pos)
                put(n, pos, pos < hi)
        for n, _ in ops:
            if f"{n}_t" not in out:
                put(n, lo, np.zeros(len(out), dtype=bool))
        put("last", hi - 1, hi > lo)
        return out[[f.name for f in fields]]

    by = [*on, "_s"]
    # both sides may stem from one table: fresh attributes keep the grouping keys unambiguous
    points = points.select(*[F.col(c).alias(c) for c in points.columns])
    near = near.select(*[F.col(c).alias(c) for c in near.columns])
    return near.groupBy(*by).cogroup(points.groupBy(*by)).applyInPandas(run, T.StructType(fields))


def race(credit: Column, stop: tuple[Column, Column], profit: tuple[Column, Column], last: tuple[Column, Column]) -> dict[str, Column]:
    """Outcome of a stop against a profit level, each given as (time, value).

    The stop wins ties. With no touch the last value decides; equal to the
    credit counts as a loss.
    """
    (st, sv), (pt, pv), (lt, lv) = stop, profit, last
    stopped = st.isNotNull() & (pt.isNull() | (st <= pt))
    took = ~stopped & pt.isNotNull()
    debit = F.when(stopped, sv).when(took, pv).otherwise(lv)
    return {
        "target": F.when(stopped, 0).when(took, 1).when(lv.isNotNull(), (lv < credit).cast("int")).cast("long"),
        "exit_reason": F.when(stopped, "sl").when(took, "tp").when(lv < credit, "close_win").when(lv.isNotNull(), "close_loss"),
        "exit_time": F.when(stopped, st).when(took, pt).otherwise(lt),
        "exit_debit": F.round(debit, 4),
        "pnl": F.round(credit - debit, 4),
    }


def ratchet_tiers(activate: float = 0.30, step: float = 0.05, offset: float = 0.05) -> list[tuple[float, float]]:
    """(activation, locked profit) pairs as shares of the credit."""
    tiers, a = [], activate
    while a <= 1.0 + 1e-9:
        tiers.append((round(a, 4), round(a - offset, 4)))
        a = round(a + step, 4)
    return tiers


def ratchet_exit(points: DataFrame, key: Sequence[str], time: str, debit: str, credit: str, tiers: list[tuple[float, float]] | None = None) -> DataFrame:
    """First point that gives back a locked profit.

    For each tier: activation is the first debit at or below its threshold; it
    breaks at the first later debit at or above its floor, unless a higher tier
    has replaced the floor by then. The active tier at a point is set by the
    running minimum debit, so one running window over a position's own minutes
    (bounded by its session) decides everything.
    """
    from pyspark.sql import Window as W

    tiers = tiers or ratchet_tiers()
    w = W.partitionBy(*key).orderBy(time).rowsBetween(W.unboundedPreceding, 0)
    low = F.min(debit).over(w)
    floor = F.lit(None).cast("double")
    for act, lock in tiers:
        hit = F.col("_low") <= F.round(F.col(credit) * F.lit(1.0 - act), 2)
        floor = F.when(hit, F.round(F.col(credit) * F.lit(1.0 - lock), 2)).otherwise(floor)
    marked = points.withColumn("_low", low).withColumn("ratchet_floor", floor)
    breach = F.col(debit) >= F.col("ratchet_floor")
    return marked.groupBy(*key).agg(
        F.min(F.when(breach, F.struct(F.col(time).alias("t"), F.col(debit).alias("v"), F.col("ratchet_floor").alias("f")))).alias("_x"),
        F.min("_low").alias("best_debit"),
    ).select(*key, F.col("_x.t").alias("lock_time"), F.col("_x.v").alias("lock_debit"), F.col("_x.f").alias("lock_floor"), "best_debit")
