"""Daily feature tables composed from the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikeline.functions.bsm import implied_vol
from strikeline.functions.scalar import div_pos, minute_of_day, side_of
from strikeline.operators import indicators as ind
from strikeline.operators.bars import last_known, roll_up
from strikeline.operators.chain import atm_straddle, iv_surface, long_sides, open_interest_daily


def tenor_iv(ts: DataFrame, keys: Sequence[str], targets: dict[str, int], spread: int = 3, rate: float = 0.05) -> DataFrame:
    """ATM volatility per tenor bucket: nearest moneyness per side, inverted, averaged.

    One pick per key, tenor and side comes from an aggregate; the root search then
    runs on those few rows as one column expression.
    """
    side = side_of("right")
    picks: list[Column] = []
    for name, dte in targets.items():
        near = F.col("dte").between(dte - spread, dte + spread) & F.col("moneyness").isNotNull()
        for s in ("call", "put"):
            row = F.struct(F.abs("moneyness").alias("m"), F.col("dte"), F.col("strike"), F.col("mid"))
            picks.append(F.min(F.when(near & (side == s), row)).alias(f"{name}|{s}"))
    one = ts.groupBy(*keys).agg(F.max("spx_close").alias("_spot"), *picks)
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(s).alias("side"), F.col(f"`{n}|{s}`").alias("p")) for n in targets for s in ("call", "put")]))
    x = one.select(*keys, "_spot", rows.alias("_r")).where(F.col("_r.p").isNotNull())
    years = F.greatest(F.col("_r.p.dte") / 365.0, F.lit(1.0 / (365.0 * 24.0)))
    iv = implied_vol(F.col("_r.p.mid"), F.col("_spot"), F.col("_r.p.strike"), years, F.lit(rate), F.col("_r.side") == "call")
    y = x.select(*keys, F.col("_r.name").alias("_n"), iv.alias("_iv")).where((F.col("_iv") > 0.01) & (F.col("_iv") < 3.0))
    return y.groupBy(*keys).agg(*[F.avg(F.when(F.col("_n") == n, F.col("_iv"))).alias(n) for n in targets])


def prefixed(df: DataFrame, keep: Sequence[str], prefix: str) -> DataFrame:
    return df.select(*keep, *[F.col(c).alias(f"{prefix}{c}") for c in df.columns if c not in keep])


def prior(df: DataFrame, keys: Sequence[str], date: str = "date", prefix: str = "daily_prior_") -> DataFrame:
    """Shift every feature one row and mark it as known from the prior day."""
    cols = [c for c in df.columns if c not in (*keys, date)]
    return prefixed(ind.lag_all(df, keys, date, cols), [*keys, date], prefix)


def technicals_prior(daily: DataFrame, keys: Sequence[str] = (), date: str = "date") -> DataFrame:
    """Prior-day technical indicators of the underlying."""
    return prior(ind.daily_technicals(daily, keys, date).select(*keys, date, *ind.TECHNICALS), keys, date)


def index_close_prior(bars: DataFrame, value: str, ts: str, smas: Sequence[tuple[int, int]], z: tuple[int, int] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Prior-day close of a volatility index with its averages and z-score."""
    day = last_known(bars.withColumn("date", F.col(ts).cast("date")), [*keys, "date"], ts, [value])
    return prior(ind.index_vol_daily(day, keys, "date", value, smas, z), keys)


def snapshot_iv_prior(state: DataFrame, keys: Sequence[str] = (), at: int = 600) -> DataFrame:
    """Prior-day surface of the 10:00 snapshot with its rolling history."""
    snap = state.where((minute_of_day("decision_datetime") == at) & (F.second("decision_datetime") == 0))
    rows = long_sides(snap, [*keys, "date", "strike"], {"delta": "delta", "iv": "implied_vol"})
    return prior(ind.surface_history(iv_surface(rows, [*keys, "date"]), keys), keys)


def term_iv_prior(ts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    x = tenor_iv(ts, [*keys, "date"], {"ts_iv_7dte": 7, "ts_iv_14dte": 14})
    ratio = div_pos("ts_iv_7dte", "ts_iv_14dte")
    x = x.select(*keys, "date", "ts_iv_7dte", "ts_iv_14dte", ratio.alias("ts_iv_slope_7dte_14dte"), F.when(ratio.isNotNull(), (ratio > 1.0).cast("double")).alias("ts_iv_inverted_7dte_14dte"))
    return prior(x, keys)


def option_volume_prior(volume: DataFrame, keys: Sequence[str] = (), value: str = "volume") -> DataFrame:
    """Prior-day call and put volume; the measure is a parameter, not open interest by accident."""
    side = side_of("right")
    x = volume.groupBy(*keys, "date").agg(F.sum(F.when(side == "call", F.col(value))).alias("total_call_volume"), F.sum(F.when(side == "put", F.col(value))).alias("total_put_volume"))
    return prior(x.withColumn("pc_volume_ratio", div_pos("total_put_volume", "total_call_volume")), keys)


def regime_prior(regime: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return prior(regime.select(*keys, "date", "regime_state", "regime_prob_highvol", "regime_duration", "regime_switch"), keys)


def term_structure_daily(ts: DataFrame, date: str = "date") -> DataFrame:
    x = atm_straddle(ts, date, {"ts_0dte_atm_mid": 0, "ts_7dte_atm_mid": 7, "ts_30dte_atm_mid": 30})
    return x.withColumns({"ts_slope_0_30": F.col("ts_30dte_atm_mid") - F.col("ts_0dte_atm_mid"), "ts_slope_0_7": F.col("ts_7dte_atm_mid") - F.col("ts_0dte_atm_mid")})


def oi_daily(oi: DataFrame) -> DataFrame:
    return open_interest_daily(oi)


def spot_daily(bars: DataFrame, ts: str = "datetime", keys: Sequence[str] = ()) -> DataFrame:
    return roll_up(bars.withColumn("date", F.col(ts).cast("date")), [*keys, "date"], ts)
