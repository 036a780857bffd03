"""The wide training table: spine, lagged daily tables and nine feature families."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strikeline.functions.scalar import div_pos, safe_ln, to_step
from strikeline.operators import calendar as cal
from strikeline.operators import indicators as ind
from strikeline.operators.bars import opening_moves
from strikeline.operators.clean import one_hot, sanitize_numeric
from strikeline.operators.lagjoin import join_daily, unique_on
from strikeline.plans import daily as dl
from strikeline.plans.strategies import STRATEGY_NAMES
from strikeline.plans.tables import settle
from strikeline.registry import prior_name


@dataclass
class Inputs:
    """Tables a training table is built from; optional ones may stay None."""

    spine: DataFrame
    state: DataFrame
    bars: DataFrame
    vix_bars: DataFrame
    vix1d_bars: DataFrame
    daily_specs: Sequence[tuple[DataFrame, str | int]] = field(default_factory=list)
    term_structure: DataFrame | None = None
    option_volume: DataFrame | None = None
    volume_column: str = "volume"
    closes: DataFrame | None = None
    regime: DataFrame | None = None
    events: DataFrame | None = None
    event_names: Sequence[str] = ("CPI", "NFP", "GDP", "PPI", "FOMC")
    earnings: DataFrame | None = None
    earnings_names: Sequence[str] = ()


def family_entry(df: DataFrame) -> DataFrame:
    """Strategy flags, time of day, calendar position (families 1 and 2)."""
    x = df.select("*", *[e.alias(n) for n, e in cal.entry_time_columns("decision_datetime").items()])
    x = one_hot(x, "strategy", STRATEGY_NAMES, "strat_")
    return x.select("*", *[e.alias(n) for n, e in cal.weekday_columns("decision_datetime").items()])


def family_daily_names(df: DataFrame, lagged: Sequence[str]) -> DataFrame:
    """Lag-correct daily columns under their contract names (families 3 and 4)."""
    return df.select("*", *[F.col(c).alias(prior_name(c)) for c in lagged])


def family_session(bars: DataFrame, state: DataFrame) -> DataFrame:
    """Per-minute session features keyed by decision time (family 5)."""
    b = bars.withColumn("date", F.col("datetime").cast("date"))
    f = ind.session_features(b, [], "date", "datetime")
    names = {c: ("intraday_spx_" if c.startswith(("ret_", "vs_")) else "intraday_") + c for c in ind.SESSION}
    per_minute = f.select((F.col("datetime") + F.expr("INTERVAL 1 MINUTE")).alias("decision_datetime"), "date", *[F.col(c).alias(n) for c, n in names.items()])
    moves = opening_moves(b.withColumn("_k", F.lit(0)), ["_k"], "date", "datetime")
    fixed = moves.select(
        "date", F.col("day_open").alias("spx_intraday_first_bar_open"), F.col("gap_pct").alias("daily_spx_open_vs_prev_close_gap_pct"),
        "first_15m_return_pct", "first_30m_return_pct", "first_30m_range_pct", "first_30m_direction", "open_drive_strength", "prev_close_gap_reversal",
    )
    w = W.partitionBy("date").orderBy("decision_datetime").rowsBetween(W.unboundedPreceding, 0)
    vix = state.groupBy("date", "decision_datetime").agg(*[F.max(c).alias(c) for c in ("vix_close", "vix_high", "vix_low")]).select(
        "decision_datetime", F.col("vix_close").alias("vix_intraday_prior_min_close"), F.max("vix_high").over(w).alias("vix_intraday_running_high"), F.min("vix_low").over(w).alias("vix_intraday_running_low"),
    )
    return per_minute.join(fixed, "date", "left").join(vix, "decision_datetime", "left").drop("date")


def family_cross_horizon(df: DataFrame, daily: DataFrame) -> DataFrame:
    """Intraday state against prior-day context (family 6)."""
    x = df.join(settle(ind.daily_context(daily, []), "daily"), "date", "left")
    x = x.withColumn("_first", F.col("spx_intraday_first_bar_open") * F.col("first_30m_range_pct") / 100.0)
    cols = ind.cross_horizon("spx_prev_min_close", "intraday_spx_vs_ma15", "intraday_rvol_30m", "intraday_running_range", "_first")
    ctx = ["daily_rv_5", "daily_rv_20", "atr_14", "sma_7", "sma_20", "sma_50", "sma_180", "_first"]
    return x.select("*", to_step("spx_prev_min_close").alias("spx_intraday_atm_strike"), *[e.alias(f"intraday_{n}") for n, e in cols.items()]).drop(*ctx)


def family_daily_technicals(df: DataFrame, daily: DataFrame, t: Inputs) -> DataFrame:
    """Prior-day indicators, volatility indices and surface history (family 7)."""
    parts = [
        dl.technicals_prior(daily),
        dl.index_close_prior(t.vix_bars, "vix_close", "datetime", [(10, 5), (20, 10)]),
        dl.index_close_prior(t.vix1d_bars, "vix1d_close", "datetime", [(5, 3), (20, 10)], (21, 10)),
        dl.snapshot_iv_prior(t.state),
    ]
    out = df
    for p in parts:
        out = out.join(settle(unique_on(p, ["date"]), "daily"), "date", "left")
    ratios = {"daily_prior_vix1d_vs_vix": div_pos("daily_prior_vix1d_close", "daily_prior_vix_close"), "daily_prior_iv_rv_ratio": div_pos("daily_prior_atm_iv", "daily_prior_yz_hv_20")}
    ratios |= {f"daily_prior_iv_hv_ratio_{n}day": div_pos("daily_prior_atm_iv", f"daily_prior_yz_hv_{n}") for n in (5, 10, 20, 30)}
    return out.withColumns(ratios)


def snapshot_features(state: DataFrame) -> DataFrame:
    """ATM mids, surface and fixed-offset credits of every decision minute, one aggregation."""
    atm = to_step("spx_close")
    aggs: list[Column] = [F.max("spx_close").alias("_spx")]

    def mid_at(side: str, off: float) -> Column:
        m = F.col(f"{side}_mid_close")
        return F.max(F.when((F.col("strike") == atm + off) & (m > 0), m))

    need = {("call", 0), ("put", 0)} | {(s, sg * o) for o in (50, 100, 150, 200) for s, sg in (("call", 1), ("put", -1))}
    aggs += [mid_at(s, o).alias(f"_{s}_{abs(o)}") for s, o in sorted(need)]
    picks = (("call", 0.50, 0.15), ("put", -0.50, 0.15), ("call", 0.25, 0.10), ("put", -0.25, 0.10), ("call", 0.10, 0.10), ("put", -0.10, 0.10))
    for i, (s, target, _) in enumerate(picks):
        iv, delta = F.col(f"{s}_implied_vol"), F.col(f"{s}_delta")
        ok = (iv > 0.01) & (iv < 5.0) & delta.isNotNull()
        aggs.append(F.min(F.when(ok, F.struct(F.abs(delta - target).alias("d"), F.col("strike"), iv.alias("iv")))).alias(f"_p{i}"))
    g = state.groupBy("decision_datetime").agg(*aggs)
    v = [F.when(F.col(f"_p{i}.d") <= tol, F.col(f"_p{i}.iv")) for i, (_, _, tol) in enumerate(picks)]

    def credit(a: int, b: int) -> Column:
        c = F.col(f"_call_{a}") + F.col(f"_put_{a}") - F.col(f"_call_{b}") - F.col(f"_put_{b}")
        return F.when(c > 0, c)

    x = g.select(
        "decision_datetime", "_spx", F.col("_call_0").alias("intraday_atm_call_mid"), F.col("_put_0").alias("intraday_atm_put_mid"), (F.col("_call_0") + F.col("_put_0")).alias("intraday_atm_straddle_mid"),
        F.coalesce((v[0] + v[1]) / 2.0, v[0], v[1]).alias("intraday_atm_iv"), v[2].alias("intraday_iv_25d_call"), v[3].alias("intraday_iv_25d_put"), v[4].alias("intraday_iv_10d_call"), v[5].alias("intraday_iv_10d_put"),
        credit(50, 100).alias("intraday_ic_credit_50pt"), credit(100, 150).alias("intraday_ic_credit_100pt"), credit(150, 200).alias("intraday_ic_credit_150pt"),
    )
    p, c = F.col("intraday_iv_25d_put"), F.col("intraday_iv_25d_call")
    return x.select(
        "*", (p - c).alias("intraday_skew_25d"), (F.col("intraday_iv_10d_put") - F.col("intraday_iv_10d_call")).alias("intraday_skew_10d"), ((p + c) / 2.0 - F.col("intraday_atm_iv")).alias("intraday_iv_smile_curve")
    )


def family_snapshot(df: DataFrame, state: DataFrame) -> DataFrame:
    """Chain snapshot at the decision minute plus distances to daily levels (family 8)."""
    x = df.join(settle(snapshot_features(state), "snapshot"), "decision_datetime", "left")
    cols: dict[str, Column] = {}
    if "max_pain_strike" in df.columns:
        gap = F.col("_spx") - F.col("max_pain_strike")
        cols |= {"intraday_max_pain_distance_pts": gap, "intraday_max_pain_distance_pct": div_pos(gap, "_spx") * 100.0}
    for tag, src in (("7dte", "ts_7dte_atm_mid"), ("30dte", "ts_30dte_atm_mid")):
        if src in df.columns:
            ratio = F.when(F.col(src) > 0, div_pos(src, "intraday_atm_straddle_mid"))
            cols[f"intraday_ts_slope_0dte_{tag}"] = safe_ln(ratio)
    return x.withColumns(cols).drop("_spx")


def family_context(df: DataFrame, t: Inputs) -> DataFrame:
    """Term volatility, option volume, sector spreads, regime, events, earnings (family 9)."""
    out, days = df, df.select("date").distinct()
    parts: list[DataFrame] = []
    if t.term_structure is not None:
        parts.append(dl.term_iv_prior(t.term_structure))
    if t.option_volume is not None:
        parts.append(dl.option_volume_prior(t.option_volume, value=t.volume_column))
    if t.closes is not None:
        w = W.partitionBy(F.lit(0)).orderBy("date")
        spread = {f"{s}_spy_ret_spread_1day": F.try_divide(s, F.lag(s).over(w)) - F.try_divide("spy", F.lag("spy").over(w)) for s in ("xlf", "xlk", "xle")}
        parts.append(dl.prior(t.closes.select("date", *[e.alias(n) for n, e in spread.items()]), []))
    if t.regime is not None:
        parts.append(dl.regime_prior(t.regime))
    if t.events is not None:
        names = [n for n in t.event_names if n != "FOMC"]
        parts.append(cal.event_flags(days, t.events, "date", "event", names))
        parts.append(cal.days_to_next(days, t.events, "date", "event", t.event_names, any_name="any_econ"))
    if t.earnings is not None:
        parts.append(cal.earnings_flags(days, t.earnings, "date", "symbol", t.earnings_names))
    for p in parts:
        out = out.join(settle(unique_on(p, ["date"]), "daily"), "date", "left")
    if t.term_structure is not None:
        out = out.withColumns({f"intraday_iv_ts_slope_0dte_{n}dte": div_pos("intraday_atm_iv", f"daily_prior_ts_iv_{n}dte") for n in (7, 14)})
    return out


def build_training_table(t: Inputs) -> DataFrame:
    """One row per decision minute and strategy, infinities and NaN as NULL.

    All joins keep the spine's grain. Every daily table and the session and snapshot
    features are written as tables of their own, one row per date or minute and
    guarded against repeats; the wide table is then a chain of joins over them.
    """
    base_cols = set(t.spine.columns)
    x = join_daily(t.spine, [(settle(df, "daily"), lag) for df, lag in t.daily_specs])
    lagged = [c for c in x.columns if c not in base_cols]
    x = family_daily_names(family_entry(x), lagged)
    x = x.join(settle(family_session(t.bars, t.state), "session"), "decision_datetime", "left")
    daily = settle(dl.spot_daily(t.bars), "daily")
    x = family_cross_horizon(x, daily)
    x = family_daily_technicals(x, daily, t)
    x = family_snapshot(x, t.state)
    return sanitize_numeric(family_context(x, t))
