"""Bar roll-ups and session features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strikeline.functions.scalar import bar_start, div, minute_of_day, pct_over


def ohlc(df: DataFrame, keys: Sequence[str | Column], ts: str, price: str, extra: Sequence[Column] = ()) -> DataFrame:
    """First, highest, lowest and last price by time order; combines before the shuffle."""
    return df.groupBy(*keys).agg(
        F.min_by(price, ts).alias("open"), F.max(price).alias("high"),
        F.min(price).alias("low"), F.max_by(price, ts).alias("close"), *extra,
    )


def tick_bars(df: DataFrame, keys: Sequence[str], ts: str, price: str, width: str = "1 minute", extra: Sequence[Column] = ()) -> DataFrame:
    return ohlc(df, [*keys, bar_start(ts, width).alias("bar")], ts, price, extra)


def roll_up(bars: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Bars of bars: OHLC of a coarser grain from finer bars."""
    return bars.groupBy(*keys).agg(
        F.min_by("open", ts).alias("open"), F.max("high").alias("high"),
        F.min("low").alias("low"), F.max_by("close", ts).alias("close"),
    )


def last_known(df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str]) -> DataFrame:
    """Last non-null value of each column per group."""
    return df.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(ts))).alias(c) for c in cols])


def first_known(df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str]) -> DataFrame:
    """First non-null value of each column per group."""
    return df.groupBy(*keys).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(ts))).alias(c) for c in cols])


def latest_row(df: DataFrame, keys: Sequence[str], date: str, asof: str) -> DataFrame:
    """Newest row on or before a date per key."""
    from strikeline.operators.dedup import keep_one

    return keep_one(df.where(F.col(date) <= F.lit(asof).cast("date")), keys, [date])


def opening_moves(bars: DataFrame, keys: Sequence[str], date: str, ts: str, open_minute: int = 570) -> DataFrame:
    """Opening gap and first 15/30/60 minute moves per session, from one aggregation.

    Bars are picked by clock time. The prior close is the previous session's last.
    """
    m = minute_of_day(ts)

    def upto(n: int, c: str) -> Column:
        return F.when(m < open_minute + n, F.col(c))

    day = bars.groupBy(*keys, date).agg(
        F.min_by("open", ts).alias("day_open"),
        F.max_by("close", ts).alias("session_close"),
        *[F.max_by("close", F.when(m < open_minute + n, F.col(ts))).alias(f"_c{n}") for n in (15, 30, 60)],
        F.max(upto(30, "high")).alias("_h30"), F.min(upto(30, "low")).alias("_l30"),
    )
    prev = F.lag("session_close").over(W.partitionBy(*keys).orderBy(date))
    x = day.withColumn("prev_close", prev)
    o = F.col("day_open")
    ret = {f"first_{n}m_return_pct": pct_over(f"_c{n}", o) for n in (15, 30, 60)}
    rng = F.when(o > 0, div(F.col("_h30") - F.col("_l30"), o) * 100.0)
    r30 = ret["first_30m_return_pct"]
    gap_dir, move_dir = F.signum(o - F.col("prev_close")), F.signum(F.col("_c30") - o)
    return x.select(
        *keys, date, "day_open", "session_close", "prev_close",
        pct_over(o, "prev_close").alias("gap_pct"),
        *[e.alias(n) for n, e in ret.items()],
        rng.alias("first_30m_range_pct"),
        F.signum(r30).cast("long").alias("first_30m_direction"),
        div(r30, rng).alias("open_drive_strength"),
        F.when((F.col("prev_close") > 0) & F.col("_c30").isNotNull(), ((gap_dir != 0) & (move_dir == -gap_dir)).cast("double")).alias("prev_close_gap_reversal"),
    )


def opening_moves_by_rows(bars: DataFrame, keys: Sequence[str], date: str, ts: str, volume: str, need: int = 30) -> DataFrame:
    """The same moves over the first 15/30/60 bars, only for sessions with enough bars."""
    w = W.partitionBy(*keys, date).orderBy(ts)
    n = bars.withColumn("_i", F.row_number().over(w))
    day = n.groupBy(*keys, date).agg(
        F.count(F.lit(1)).alias("bars"), F.min_by("open", ts).alias("day_open"),
        *[F.max(F.when(F.col("_i") == k, F.col("close"))).alias(f"_c{k}") for k in (15, 30, 60)],
        F.max(F.when(F.col("_i") <= 30, F.col("high"))).alias("_h30"),
        F.min(F.when(F.col("_i") <= 30, F.col("low"))).alias("_l30"),
        F.sum(F.when(F.col("_i") <= 30, F.col(volume))).alias("_v30"), F.sum(volume).alias("_v"),
    )
    ok = (F.col("bars") >= need) & (F.col("day_open") > 0)
    ret = {k: F.when(ok, pct_over(f"_c{k}", "day_open")) for k in (15, 30, 60)}
    rng = F.when(ok, div(F.col("_h30") - F.col("_l30"), "day_open") * 100.0)
    return day.select(
        *keys, date, "bars",
        *[e.alias(f"first_{k}m_return_pct") for k, e in ret.items()],
        rng.alias("first_30m_range_pct"),
        F.when(F.abs(ret[30]) < 0.001, 0).otherwise(F.signum(ret[30])).cast("long").alias("first_30m_direction"),
        F.when(ok & (F.col("_v") > 0), div("_v30", "_v")).alias("first_30m_vol_ratio"),
        F.when(ok, F.when(rng > 0.001, div(ret[30], rng)).otherwise(0.0)).alias("open_drive_strength"),
    )
