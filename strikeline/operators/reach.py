"""First-touch races over long horizons by range extremes.

Slices of a path get extremes, and so do their pairs, fours, eights and so on. The slices between the
border slices of an entry are at most two such ranges of each size, so an entry reads 2 log n rows of
extremes however long its horizon is. The first range that reaches a level is then halved
until one slice is left. Only that slice and the two border slices are opened.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikeline.functions.scalar import epoch_seconds
from strikeline.operators.asof import asof_join
from strikeline.operators.slicing import time_width
from strikeline.plans.tables import settle

ROUNDS = 4  # halvings in one plan before it is written
SLICE_POINTS = 32  # points of the busiest slice of a path, as counted over slices of full width


def range_extremes(slices: DataFrame, on: Sequence[str], top: int) -> DataFrame:
    """``on, _l, _b, _lo, _hi``: extremes of 2^l slices from b 2^l on, for l up to ``top``; at most twice the rows of ``slices``."""
    level = slices.select(*on, F.lit(0).alias("_l"), F.col("_s").alias("_b"), "_lo", "_hi")
    out = level
    for k in range(1, top + 1):
        level = level.groupBy(*on, F.shiftright("_b", 1).alias("_b")).agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")).select(*on, F.lit(k).alias("_l"), "_b", "_lo", "_hi")
        out = out.unionByName(level)
    return out


def covering(first: Column, stop: Column, top: int) -> Column:
    """The ranges that cover slices ``[first, stop)``, at most two of each size, as structs of size and number."""
    parts = []
    for k in range(top + 1):
        p, q = -F.shiftright(-first, k), F.shiftright(stop, k)  # rounded up, and down
        for odd, at in ((p, p), (q, q - 1)):
            parts.append(F.when((p < q) & (odd.bitwiseAND(1) == 1), F.struct(F.lit(k).alias("_l"), at.alias("_b"))))
    return F.array_compact(F.array(*parts))


def first_touch_far(
    entries: DataFrame, path: DataFrame, on: Sequence[str], key: Sequence[str], entry_time: str, end_time: str,
    path_time: str, value: str, levels: Sequence[tuple[str, str, str]], slice_seconds: int, most: int = SLICE_POINTS,
) -> DataFrame:
    """``barrier.first_touch`` for horizons of any number of slices; same arguments, same result.

    One slice of points is opened per entry and level, and both border slices. Slices are ``slice_seconds`` wide, or narrower (to a second)
    where the busiest would hold more than ``most`` points, so that the points opened grow with the entries and not with their density. Path points of
    equal key and time: the one of the smaller value comes first, the larger is the last value. The number of sizes comes from the
    first and last slice of the path.
    """
    if {op for _, op, _ in levels} - {">=", "<="}:
        raise ValueError("levels use >= or <=")
    valued = path.where(F.col(value).isNotNull())
    width = time_width(valued, on, path_time, most, slice_seconds)
    slot = lambda c: F.floor(epoch_seconds(c) / width).cast("long")
    points = valued.select(*on, F.col(path_time).alias("_t"), F.col(value).alias("_v"), slot(path_time).alias("_s"))
    slices = settle(points.groupBy(*on, "_s").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi")), "extremes")
    asked = entries.where(F.col(end_time) > F.col(entry_time)).select(
        *dict.fromkeys([*on, *key]), F.col(entry_time).alias("_a"), F.col(end_time).alias("_z"), *[F.col(c).alias(f"_lv_{n}") for n, _, c in levels])
    asked = settle(asked, "asks")
    low, high = slices.agg(F.min("_s"), F.max("_s")).first()
    top = max(1, ((high or 0) - (low or 0) + 1).bit_length())
    nodes = settle(range_extremes(slices, on, top), "ranges")

    def reached(name: str, op: str) -> Column:
        return F.col("_hi") >= F.col(f"_lv_{name}") if op == ">=" else F.col("_lo") <= F.col(f"_lv_{name}")

    # nothing lies outside the slices of the path, so a horizon is cut to them
    first, stop = F.greatest(slot("_a") + 1, F.lit(low or 0)), F.least(slot("_z"), F.lit((high or 0) + 1))
    ranges = asked.select("*", F.explode(covering(first, stop, top)).alias("_r")).select("*", "_r._l", "_r._b").join(nodes, [*on, "_l", "_b"])
    start = F.call_function("shiftleft", F.col("_b"), F.col("_l"))
    hit = ranges.groupBy(*key).agg(*[F.min(F.when(reached(n, op), F.struct(start.alias("start"), F.col("_l").alias("l"), F.col("_b").alias("b")))).alias(f"_h_{n}") for n, op, _ in levels])
    hit = settle(asked.join(hit, list(key)), "hits")
    found = None
    for n, op, _ in levels:
        rows = hit.where(F.col(f"_h_{n}").isNotNull()).select(*dict.fromkeys([*on, *key]), F.lit(n).alias("_name"), F.lit(op).alias("_op"), F.col(f"_lv_{n}").cast("double").alias("_level"), F.col(f"_h_{n}.l").alias("_l"), F.col(f"_h_{n}.b").alias("_b"))
        found = rows if found is None else found.unionByName(rows)
    halves = nodes.select(*on, (F.col("_l") + 1).alias("_l"), F.shiftright("_b", 1).alias("_b"), "_lo", "_hi", (F.col("_b").bitwiseAND(1) == 0).alias("_left")).where("_left").drop("_left")
    for k in range(top):
        x = found.join(halves, [*on, "_l", "_b"], "left")
        left = F.coalesce(F.when(F.col("_op") == ">=", F.col("_hi") >= F.col("_level")).otherwise(F.col("_lo") <= F.col("_level")), F.lit(False))
        b = F.when(F.col("_l") == 0, F.col("_b")).otherwise(F.col("_b") * 2 + F.when(left, 0).otherwise(1))
        found = x.select(*dict.fromkeys([*on, *key]), "_name", "_op", "_level", F.greatest(F.col("_l") - 1, F.lit(0)).alias("_l"), b.alias("_b"))
        if k % ROUNDS == ROUNDS - 1:
            found = settle(found, "halves")
    inner = found.select(*key, F.col("_b").alias("_s"))
    near = asked.select(*key, F.explode(F.array_distinct(F.array(slot("_a"), slot("_z")))).alias("_s")).unionByName(inner).distinct()
    opened = asked.join(near, list(key)).join(points, [*on, "_s"]).where((F.col("_t") > F.col("_a")) & (F.col("_t") <= F.col("_z")))

    def at(name: str, op: str) -> Column:
        level = F.col(f"_lv_{name}")
        return F.when(F.col("_v") >= level if op == ">=" else F.col("_v") <= level, F.struct("_t", "_v"))

    touched = opened.groupBy(*key).agg(*[F.min(at(n, op)).alias(f"_m_{n}") for n, op, _ in levels])
    ends = asof_join(asked.select(*dict.fromkeys([*on, *key]), "_a", "_z"), points.select(*on, "_t", "_v"), on, "_z", "_t", {"last_t": "_t", "last_v": "_v"}, slice_seconds=slice_seconds)
    ends = ends.where(F.col("last_t") > F.col("_a")).select(*key, "last_t", "last_v")
    out = ends.join(touched, list(key), "left")
    return out.select(*key, *[c for n, _, _ in levels for c in (F.col(f"_m_{n}._t").alias(f"{n}_t"), F.col(f"_m_{n}._v").alias(f"{n}_v"))], "last_t", "last_v")
