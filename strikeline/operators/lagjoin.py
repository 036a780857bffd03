"""Leakage-safe joins of daily tables onto a master table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LAGS = {"same_day": 0, "t1": 1, "t2": 2}


def shift_to_effective_date(daily: DataFrame, master: DataFrame, lag: str | int, date: str = "date") -> DataFrame:
    """Move each daily row to the trading day it becomes known on.

    Steps are counted on the master's own distinct dates; source dates that are
    not on that calendar are dropped, as are rows shifted past its end.
    """
    steps = LAGS[lag] if isinstance(lag, str) else lag
    days = master.select(date).distinct()
    effective = days.select(date, F.lead(date, steps).over(W.orderBy(date)).alias("_eff")) if steps else days.withColumn("_eff", F.col(date))
    moved = daily.join(effective.where(F.col("_eff").isNotNull()), date, "inner")
    return moved.drop(date).withColumnRenamed("_eff", date)


def unique_on(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fail the job when a key repeats, instead of fanning rows out silently."""
    rest = [c for c in df.columns if c not in keys]
    grouped = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max(F.struct(*rest)).alias("_b"))
    first = keys[0]
    guard = F.when(F.col("_n") == 1, F.col(first)).otherwise(F.raise_error(F.lit(f"duplicate key in {','.join(keys)}")))
    return grouped.select(guard.alias(first), *keys[1:], "_b.*")


def join_daily(
    master: DataFrame, specs: Sequence[tuple[DataFrame, str | int]], date: str = "date", check_unique: bool = True
) -> DataFrame:
    """Left-join daily tables in order; a column already present is not replaced.

    No broadcast hint: the daily sides are small in practice, and the planner
    broadcasts them when their measured size allows it.
    """
    out = master
    for daily, lag in specs:
        have = set(out.columns)
        moved = shift_to_effective_date(daily, master, lag, date)
        fresh = [c for c in moved.columns if c != date and c not in have]
        if not fresh:
            continue
        side = moved.select(date, *fresh)
        out = out.join(unique_on(side, [date]) if check_unique else side, date, "left")
    return out
