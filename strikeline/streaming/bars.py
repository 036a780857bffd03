"""Bars, sliding features and session state over event-time streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikeline.functions.scalar import minute_of_day


def minute_bars(stream: DataFrame, ts: str, keys: Sequence[str], value: str, width: str = "1 minute") -> DataFrame:
    """Closed bars only: a bar appears once the watermark passes its end.

    The bar of minute t can be acted on at its end, so that is the decision time.
    Minutes without ticks produce no row.
    """
    w = F.window(ts, width)
    bars = stream.groupBy(w.alias("_w"), *keys).agg(
        F.min_by(value, ts).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, ts).alias("close"), F.count(F.lit(1)).alias("n")
    )
    return bars.select(
        *keys, F.col("_w.start").cast("timestamp_ntz").alias("bar"), F.col("_w.end").cast("timestamp_ntz").alias("decision_datetime"), "open", "high", "low", "close", "n"
    )


def quote_bars(stream: DataFrame, ts: str, keys: Sequence[str], bid: str = "bid", ask: str = "ask") -> DataFrame:
    """Bid and ask bars of regular-session minutes with a closing mid."""
    m = minute_of_day(ts)
    open_hours = stream.where((m >= 570) & (m < 960))
    aggs = []
    for c, name in ((bid, "bid"), (ask, "ask")):
        aggs += [F.min_by(c, ts).alias(f"{name}_open"), F.max(c).alias(f"{name}_high"), F.min(c).alias(f"{name}_low"), F.max_by(c, ts).alias(f"{name}_close")]
    bars = open_hours.groupBy(F.window(ts, "1 minute").alias("_w"), *keys).agg(*aggs)
    return bars.select(
        *keys, F.col("_w.start").cast("timestamp_ntz").alias("minute"), *[f"{n}_{f}" for n in ("bid", "ask") for f in ("open", "high", "low", "close")],
        ((F.col("bid_close") + F.col("ask_close")) / 2.0).alias("mid_close"),
    )


def sliding(stream: DataFrame, ts: str, keys: Sequence[str], value: str, width: str, step: str) -> DataFrame:
    """Mean, spread and return over sliding event-time windows."""
    x = stream.groupBy(F.window(ts, width, step).alias("_w"), *keys).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min_by(value, ts).alias("_a"), F.max_by(value, ts).alias("_b"), F.count(F.lit(1)).alias("n")
    )
    return x.select(*keys, F.col("_w.end").cast("timestamp_ntz").alias("decision_datetime"), "mean", "std", (F.try_divide("_b", "_a") - 1.0).alias("ret"), "n")


def session_state(stream: DataFrame, ts: str, keys: Sequence[str], value: str, opening_end: int = 600) -> DataFrame:
    """Running session high, low, opening range and last value, keyed by day.

    A mergeable aggregate in update mode: partial states combine before the
    shuffle, so a busy symbol is not replayed row by row in one task.
    """
    early = minute_of_day(ts) < opening_end
    return stream.groupBy(*keys, F.to_date(ts).alias("date")).agg(
        F.max(value).alias("high"), F.min(value).alias("low"), F.max(F.when(early, F.col(value))).alias("orb_high"), F.min(F.when(early, F.col(value))).alias("orb_low"),
        F.max_by(value, ts).alias("last"), F.max(ts).cast("timestamp_ntz").alias("last_ts"), F.count(F.lit(1)).alias("n"),
    )


def enrich(stream: DataFrame, daily: DataFrame, on: Sequence[str]) -> DataFrame:
    """Stream-static join with daily features; the static side is broadcast only if small."""
    return stream.join(daily, list(on), "left")
