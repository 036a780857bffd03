"""As-of joins that split hot keys along time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strikeline.functions.scalar import epoch_seconds


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_time: str,
    right_time: str,
    take: dict[str, str],
    direction: str = "backward",
    strict: bool = False,
    tolerance_seconds: int | None = None,
    slice_seconds: int = 86_400,
) -> DataFrame:
    """Attach to each left row the nearest earlier (or later) right row.

    ``take`` maps output names to right columns. Both sides are cut into time
    slices, so the ordered scan runs per (key, slice); the only thing that
    crosses a border is one carried row per slice. Right rows sharing a key and
    time collapse to the greatest payload, which makes the result repeatable.
    ``strict`` excludes equal times. A NULL key is a group of its own, as in ``groupBy`` and windows.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(direction)
    back = direction == "backward"
    on = list(on)
    outs = list(take)

    payload = F.struct(F.col(right_time).alias("_rt"), *[F.col(c).alias(o) for o, c in take.items()])
    points = (
        right.where(F.col(right_time).isNotNull())
        .select(*on, F.col(right_time).alias("_t"), payload.alias("_pay"))
        .groupBy(*on, "_t")
        .agg(F.max("_pay").alias("_pay"))
    )
    row = F.struct(*[F.col(c) for c in left.columns])
    asks = left.select(*on, F.col(left_time).alias("_t"), row.alias("_row"))

    def cut(df: DataFrame) -> DataFrame:
        return df.withColumn("_slice", F.floor(epoch_seconds("_t") / slice_seconds).cast("long"))

    points, asks = cut(points), cut(asks)
    pick = F.max_by if back else F.min_by
    ends = points.groupBy(*on, "_slice").agg(pick("_pay", "_t").alias("_end"))
    wanted = asks.select(*on, "_slice").distinct().withColumn("_end", F.lit(None).cast(ends.schema["_end"].dataType))
    per_slice = ends.unionByName(wanted).groupBy(*on, "_slice").agg(F.first("_end", ignorenulls=True).alias("_end"))
    slice_order = F.col("_slice") if back else F.col("_slice").desc()
    earlier = W.partitionBy(*on).orderBy(slice_order).rowsBetween(W.unboundedPreceding, -1)
    carried = per_slice.select(*on, "_slice", F.last("_end", ignorenulls=True).over(earlier).alias("_pay")).where(
        F.col("_pay").isNotNull()
    )

    # rank: carried rows open the slice, then right rows before (or, if strict, after) left rows of equal time
    null_row = F.lit(None).cast(asks.schema["_row"].dataType)
    null_pay = F.lit(None).cast(points.schema["_pay"].dataType)
    null_time = F.lit(None).cast(points.schema["_t"].dataType)
    left_rank, right_rank = (1, 2) if strict else (2, 1)
    stacked = (
        asks.select(*on, "_slice", "_t", F.lit(1).alias("_open"), F.lit(left_rank).alias("_rank"), "_row", null_pay.alias("_pay"))
        .unionByName(
            points.select(*on, "_slice", "_t", F.lit(1).alias("_open"), F.lit(right_rank).alias("_rank"), null_row.alias("_row"), "_pay")
        )
        .unionByName(
            carried.select(*on, "_slice", null_time.alias("_t"), F.lit(0).alias("_open"), F.lit(0).alias("_rank"), null_row.alias("_row"), "_pay")
        )
    )
    time_order: Column = F.col("_t") if back else F.col("_t").desc()
    scan = (
        W.partitionBy(*on, "_slice")
        .orderBy("_open", time_order, "_rank")
        .rowsBetween(W.unboundedPreceding, 0)
    )
    found = stacked.withColumn("_hit", F.last("_pay", ignorenulls=True).over(scan)).where(F.col("_row").isNotNull())
    if tolerance_seconds is not None:
        gap = F.abs(epoch_seconds("_t") - epoch_seconds("_hit._rt"))
        found = found.withColumn("_hit", F.when(gap <= tolerance_seconds, F.col("_hit")))
    return found.select("_row.*", *[F.col(f"_hit.{o}").alias(o) for o in outs])


def lookup_interval(df: DataFrame, time: str, spans: list[tuple[str, str, dict]], outs: Sequence[str]) -> DataFrame:
    """Validity-interval lookup against a fixed list of (start, end, values) spans.

    The spans are constants known when the plan is built, so they become one CASE
    expression and the data is never joined or shuffled.
    """
    t = F.col(time).cast("date")
    cols = []
    for o in outs:
        expr = None
        for start, end, values in spans:
            inside = (t >= F.lit(start).cast("date")) & (t < F.lit(end).cast("date"))
            hit = F.lit(values[o])
            expr = F.when(inside, hit) if expr is None else expr.when(inside, hit)
        cols.append(expr.alias(o))
    return df.select("*", *cols)
