"""Minute decision state: one row per decision minute and strike."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikeline.functions.scalar import side_of
from strikeline.operators.chain import pivot_sides
from strikeline.operators.clean import drop_all_zero_rows, drop_weekends, in_session

QUOTES = ("bid", "ask", "mid")
GREEKS = ("delta", "gamma", "theta", "vega", "rho", "implied_vol", "iv_error")
OHLC = ("open", "high", "low", "close")


def load_index_bars(bars: DataFrame, prefix: str, ts: str = "datetime", keys: Sequence[str] = ()) -> DataFrame:
    """Weekday, non-empty index bars with prefixed columns, keyed by state minute."""
    have = set(bars.columns)
    cols = {c: (f"{prefix}_{c}" if f"{prefix}_{c}" in have else c) for c in OHLC}
    x = drop_all_zero_rows(drop_weekends(bars, ts), list(cols.values()))
    return x.select(*keys, F.col(ts).alias("state_datetime"), *[F.col(src).alias(f"{prefix}_{c}") for c, src in cols.items()])


def build_decision_state(chain: DataFrame, indices: dict[str, DataFrame], keys: Sequence[str] = (), ts: str = "timestamp") -> DataFrame:
    """Chain rows pivoted to one row per minute and strike, with index bars attached.

    A state observed for minute t is usable at t + 1 minute. The bar joins carry no
    hint: bars are one row per minute and the planner broadcasts them if small.
    """
    x = drop_weekends(chain, ts).where(in_session(ts, None, "16:00"))
    x = x.withColumn("right", side_of("right")).withColumn("state_datetime", F.col(ts))
    x = x.withColumnsRenamed({q: f"{q}_close" for q in QUOTES})
    cols = [*[f"{q}_close" for q in QUOTES], *GREEKS]
    state = pivot_sides(x, [*keys, "state_datetime", "strike"], "right", cols)
    for prefix in ("spx", "vix", "vix1d"):
        if prefix in indices:
            state = state.join(load_index_bars(indices[prefix], prefix, keys=keys), [*keys, "state_datetime"], "left")
        else:
            state = state.select("*", *[F.lit(None).cast("double").alias(f"{prefix}_{c}") for c in OHLC])
    decision = F.col("state_datetime") + F.expr("INTERVAL 1 MINUTE")
    side = [f"{s}_{c}" for s in ("call", "put") for c in cols[:3]] + [f"{s}_{g}" for s in ("call", "put") for g in GREEKS]
    bars = [f"{p}_{c}" for p in ("spx", "vix", "vix1d") for c in OHLC]
    return state.select(
        *keys, decision.cast("date").alias("date"), decision.alias("decision_datetime"), "state_datetime",
        F.col("strike").cast("double").alias("strike"), *[F.col(c).cast("double").alias(c) for c in [*side, *bars]],
    )
