"""Technical, volatility, breadth, macro and session indicators.

Each builder takes bars or a daily table and returns it with the indicator
columns added. Windows run per symbol over daily rows, or per symbol and session
over minute bars, so a window group is bounded by the calendar.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strikeline.functions.scalar import div, div_pos, minute_of_day, pct_over, safe_ln
from strikeline.operators import runs
from strikeline.operators import windows as wn

DAY = math.sqrt(252.0)
MINUTE = math.sqrt(390.0 * 252.0)


def by(keys: Sequence[str], order: str) -> WindowSpec:
    return W.partitionBy(*keys).orderBy(order) if keys else W.partitionBy(F.lit(0)).orderBy(order)


def lag_all(df: DataFrame, keys: Sequence[str], date: str, cols: Sequence[str], k: int = 1) -> DataFrame:
    """Shift feature columns so that a date sees values ending ``k`` rows earlier."""
    w = by(keys, date)
    shifted = set(cols)
    return df.select(*[F.lag(c, k).over(w).alias(c) if c in shifted else F.col(c) for c in df.columns])


def true_range(high: str, low: str, prev_close: Column) -> Column:
    h, l = F.col(high), F.col(low)
    return F.greatest(h - l, F.abs(h - prev_close), F.abs(l - prev_close))


def with_log_parts(df: DataFrame, w: WindowSpec) -> DataFrame:
    """Previous close, true range and the log ratios that volatility estimators share."""
    prev = F.lag("close").over(w)
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    ho, lo, co = safe_ln(div(h, o)), safe_ln(div(l, o)), safe_ln(div(c, o))
    return df.withColumns(
        {
            "_prev": prev, "_tr": true_range("high", "low", prev), "_ret": safe_ln(div(c, prev)),
            "_gapln": safe_ln(div(o, prev)), "_rs": ho * (ho - co) + lo * (lo - co),
            "_ho2": ho * ho, "_chg": c - prev,
        }
    )


def rsi_wilder(df: DataFrame, keys: Sequence[str], date: str, n: int = 14, out: str = "rsi") -> DataFrame:
    """Relative strength with Wilder smoothing; no losses gives NULL."""
    x = df.withColumns({"_g": wn.clamp_zero(F.col("_chg")), "_l": wn.clamp_zero(-F.col("_chg"))})
    x = wn.with_ewm(x, keys, date, {"_up": ("_g", 1.0 / n, n), "_dn": ("_l", 1.0 / n, n)})
    return x.withColumn(out, 100.0 - div(F.lit(100.0), 1.0 + div("_up", "_dn"))).drop("_g", "_l", "_up", "_dn")


def rsi_simple(df: DataFrame, w: WindowSpec, n: int = 14, out: str = "rsi_simple") -> DataFrame:
    x = df.withColumns({"_g": wn.clamp_zero(F.col("_chg")), "_l": wn.clamp_zero(-F.col("_chg"))})
    rs = div(wn.rolling_mean("_g", w, n), wn.rolling_mean("_l", w, n))
    return x.withColumn(out, 100.0 - div(F.lit(100.0), 1.0 + rs)).drop("_g", "_l")


def macd_histogram(df: DataFrame, keys: Sequence[str], date: str, fast: int = 12, slow: int = 26, signal: int = 9, out: str = "macd_hist") -> DataFrame:
    x = wn.with_ewm(df, keys, date, {"_fast": wn.span("close", fast), "_slow": wn.span("close", slow)})
    x = wn.with_ewm(x.withColumn("_macd", F.col("_fast") - F.col("_slow")), keys, date, {"_signal": wn.span("_macd", signal)})
    return x.withColumn(out, F.col("_macd") - F.col("_signal")).drop("_fast", "_slow", "_macd", "_signal")


def bollinger(w: WindowSpec, n: int = 20, min_periods: int = 10) -> dict[str, Column]:
    mid, sd = wn.rolling_mean("close", w, n, min_periods), wn.rolling_std("close", w, n, min_periods)
    upper, lower = mid + 2.0 * sd, mid - 2.0 * sd
    return {"bb_bandwidth": div(upper - lower, mid), "bb_pct_b": div(F.col("close") - lower, upper - lower)}


def yang_zhang(w: WindowSpec, n: int) -> Column:
    """Annualised Yang-Zhang volatility from variances, as a fraction."""
    k = 0.34 / (1.34 + (n + 1) / (n - 1))
    var = wn.rolling_var("_gapln", w, n) + F.lit(k) * wn.rolling_var("_ret", w, n) + F.lit(1 - k) * wn.rolling_mean("_rs", w, n)
    return F.sqrt(wn.clamp_zero(var) * 252.0)


def yang_zhang_mean_square(w: WindowSpec, n: int) -> Column:
    """The mean-square variant, in percent."""
    k = 0.34 / (1.34 + (n + 1) / (n - 1))
    var = (
        wn.rolling_mean(F.col("_gapln") * F.col("_gapln"), w, n)
        + F.lit(k) * wn.rolling_mean(F.col("_ret") * F.col("_ret"), w, n) + F.lit(1 - k) * wn.rolling_mean("_rs", w, n)
    )
    return F.sqrt(wn.clamp_zero(var) * 252.0) * 100.0


def garman_klass_part() -> Column:
    hl, co = safe_ln(div("high", "low")), safe_ln(div("close", "open"))
    return 0.5 * hl * hl - F.lit(2 * math.log(2) - 1) * co * co


def efficiency_ratio(w: WindowSpec, n: int = 10) -> Column:
    return div(F.abs(wn.diff("close", w, n)), wn.rolling_sum(F.abs("_chg"), w, n))


def choppiness(w: WindowSpec, n: int = 14) -> Column:
    span = wn.rolling_max("high", w, n) - wn.rolling_min("low", w, n)
    ratio = div(wn.rolling_sum("_tr", w, n), span)
    return F.when(ratio > 0, 100.0 * F.log10(ratio) / F.lit(math.log10(n)))


def daily_technicals(daily: DataFrame, keys: Sequence[str], date: str = "date") -> DataFrame:
    """Trend, momentum, band, range and volatility indicators of a daily OHLC table."""
    w = by(keys, date)
    x = with_log_parts(daily, w)
    cols: dict[str, Column] = {
        "open_to_close_pct": div(F.col("close") - F.col("open"), "open") * 100.0,
        "range_pct": div(F.col("high") - F.col("low"), "open") * 100.0,
        **bollinger(w),
        "atr_pct": div(wn.rolling_mean("_tr", w, 14, 7), "close") * 100.0,
        "efficiency_ratio": efficiency_ratio(w),
        "choppiness_14": choppiness(w),
        "log_ret": F.col("_ret"),
    }
    for n in (5, 10, 20, 50, 100, 200):
        sma = wn.rolling_mean("close", w, n)
        cols[f"close_ratio_sma_{n}"] = div(F.col("close") - sma, sma) * 100.0
    x = wn.with_ewm(x, keys, date, {f"_ema_{n}": wn.span("close", n) for n in (5, 20)})
    for n in (5, 20):
        ema = F.col(f"_ema_{n}")
        cols[f"close_ratio_ema_{n}"] = div(F.col("close") - ema, ema) * 100.0
    for n in (5, 10, 20, 30):
        cols[f"yz_hv_{n}"] = yang_zhang(w, n)
    x = x.withColumns(cols)
    x = macd_histogram(rsi_wilder(x, keys, date, 14, "rsi_14"), keys, date)
    x = x.withColumn("bb_bandwidth_pctile", wn.pct_rank_of_last("bb_bandwidth", w, 60, 20))
    return x.drop("_prev", "_tr", "_ret", "_gapln", "_rs", "_ho2", "_chg")


TECHNICALS = [
    "open_to_close_pct", "range_pct", "bb_bandwidth", "bb_pct_b", "bb_bandwidth_pctile", "atr_pct", "efficiency_ratio",
    "choppiness_14", *[f"close_ratio_sma_{n}" for n in (5, 10, 20, 50, 100, 200)], *[f"close_ratio_ema_{n}" for n in (5, 20)],
    *[f"yz_hv_{n}" for n in (5, 10, 20, 30)], "rsi_14", "macd_hist",
]


def daily_context(daily: DataFrame, keys: Sequence[str], date: str = "date") -> DataFrame:
    """Prior-day averages, realised volatility and range scale for cross-horizon ratios."""
    w = by(keys, date)
    x = daily.withColumn("_r", wn.log_return("close", w))
    cols = {
        "daily_rv_5": wn.rolling_std("_r", w, 5, 3) * DAY,
        "daily_rv_20": wn.rolling_std("_r", w, 20, 10) * DAY,
        "atr_14": wn.rolling_mean(F.col("high") - F.col("low"), w, 14, 7),
    }
    for n in (7, 20, 50, 180):
        cols[f"sma_{n}"] = wn.rolling_mean("close", w, n, max(3, n // 2))
    x = x.withColumns(cols)
    return lag_all(x, keys, date, list(cols)).select(*keys, date, *cols)


def session_features(bars: DataFrame, keys: Sequence[str], date: str, ts: str, orb_end_minute: int = 600) -> DataFrame:
    """Per-bar features that look only backward within the session.

    Returns, averages, realised and Garman-Klass volatility, running position,
    opening range and the band squeeze with its duration.
    """
    w = W.partitionBy(*keys, date).orderBy(ts)
    day = W.partitionBy(*keys, date)
    c, h, l = F.col("close"), F.col("high"), F.col("low")
    opening = minute_of_day(ts) < orb_end_minute
    x = bars.withColumns(
        {
            "_ret": wn.log_return("close", w), "_gk": garman_klass_part(),
            "_vwap": wn.expanding_mean((h + l + c) / 3.0, w),
            "_rh": wn.running_max("high", w), "_rl": wn.running_min("low", w),
            "_oh": F.max(F.when(opening, h)).over(day), "_ol": F.min(F.when(opening, l)).over(day),
            "_mid": wn.rolling_mean("close", w, 20, 10), "_sd": wn.rolling_std("close", w, 20, 10),
            "_atr": wn.rolling_mean(h - l, w, 20, 10),
            **{f"_ma{n}": wn.rolling_mean("close", w, n, max(1, n // 3)) for n in (5, 15, 30)},
        }
    )
    rng = F.col("_rh") - F.col("_rl")
    squeeze = (2.0 * F.col("_sd") < 1.5 * F.col("_atr"))
    cols: dict[str, Column] = {}
    for n in (5, 10, 15, 30):
        cols[f"ret_{n}m"] = wn.pct_change("close", w, n, 100.0)
        cols[f"rvol_{n}m"] = wn.rolling_std("_ret", w, n, max(2, n // 2)) * MINUTE
    cols["garman_klass_rv_30m"] = F.sqrt(wn.clamp_zero(wn.rolling_mean("_gk", w, 30, 10)) * (390.0 * 252.0))
    cols["pct_b"] = F.when(rng > 0, div(c - F.col("_rl"), rng)).otherwise(0.5)
    cols["vs_vwap"] = pct_over(c, "_vwap")
    for n in (5, 15, 30):
        cols[f"vs_ma{n}"] = pct_over(c, f"_ma{n}")
    cols["orb_range_pct"] = div_pos(F.col("_oh") - F.col("_ol"), c) * 100.0
    cols["orb_containment"] = F.coalesce((c >= F.col("_ol")) & (c <= F.col("_oh")), F.lit(False)).cast("double")
    cols["orb_breakout_dir"] = F.when(c > F.col("_oh"), 1.0).when(c < F.col("_ol"), -1.0).otherwise(0.0)
    cols["ttm_squeeze"] = F.coalesce(squeeze, F.lit(False)).cast("double")
    cols["running_range"] = rng
    x = x.withColumns(cols)
    x = runs.run_of_true(x, F.col("ttm_squeeze") == 1.0, w, "bb_squeeze_duration")
    return x.drop("_ret", "_gk", "_vwap", "_rh", "_rl", "_oh", "_ol", "_mid", "_sd", "_atr", "_ma5", "_ma15", "_ma30")


SESSION = [
    *[f"ret_{n}m" for n in (5, 10, 15, 30)], *[f"rvol_{n}m" for n in (5, 10, 15, 30)], "garman_klass_rv_30m", "pct_b", "vs_vwap",
    "vs_ma5", "vs_ma15", "vs_ma30", "orb_range_pct", "orb_containment", "orb_breakout_dir", "ttm_squeeze", "running_range", "bb_squeeze_duration",
]


def cross_horizon(price: str, vs_ma15: str, rvol: str, running: str, first_range: str) -> dict[str, Column]:
    """Intraday state against the prior-day context columns of ``daily_context``."""
    p = F.col(price)
    ma15 = div(p, 1.0 + F.col(vs_ma15) / 100.0)
    out = {f"spx_vs_sma_{n}": pct_over(p, f"sma_{n}") for n in (7, 20, 50, 180)}
    out["ma15_vs_sma_7"] = pct_over(ma15, "sma_7")
    out["ma15_vs_sma_20"] = pct_over(ma15, "sma_20")
    out["rvol_vs_daily_5"] = div_pos(rvol, "daily_rv_5")
    out["rvol_vs_daily_20"] = div_pos(rvol, "daily_rv_20")
    out["range_exhaustion"] = div_pos(running, "atr_14")
    out["range_vs_atr"] = div_pos(first_range, "atr_14") * 100.0
    return out


def index_vol_daily(daily: DataFrame, keys: Sequence[str], date: str, close: str, smas: Sequence[tuple[int, int]], z: tuple[int, int] | None = None) -> DataFrame:
    """Close against its averages in percent and a z-score, for a volatility index."""
    w = by(keys, date)
    cols = {}
    for n, m in smas:
        sma = wn.rolling_mean(close, w, n, m)
        cols[f"{close}_vs_sma_{n}"] = div(F.col(close) - sma, sma) * 100.0
    if z:
        cols[f"{close}_zscore_{z[0]}"] = wn.zscore(close, w, *z)
    return daily.withColumns(cols)


def vol_context(daily: DataFrame, keys: Sequence[str], date: str = "date") -> DataFrame:
    """Volatility-of-volatility block, realised minus implied, and regime persistence.

    Needs ``vvix``, ``vix``, ``spy`` closes and a 0/1 ``fomc`` flag.
    """
    w = by(keys, date)
    x = daily.withColumns({"_ret": wn.pct_change("spy", w), "_vchg": wn.pct_change("vix", w), "_dv": wn.diff("vix", w), "_hi": F.col("vix") > 20})
    x = x.withColumn("_dvlag", F.lag("_dv").over(w))
    x = x.withColumns(
        {
            "vvix_ma20": wn.rolling_mean("vvix", w, 20),
            "vvix_zscore_21": wn.zscore("vvix", w, 21),
            "vvix_vs_vix_ratio": div("vvix", "vix"),
            "rv_iv_spread_10": wn.rolling_std("_ret", w, 10) * (DAY * 100.0) - F.col("vix"),
            "rv_iv_spread_20": wn.rolling_std("_ret", w, 20) * (DAY * 100.0) - F.col("vix"),
            "iv_change_after_fomc": F.when(F.lag("fomc").over(w) == 1, F.col("_vchg")).otherwise(0.0),
            "vix_change_autocorr_20": wn.rolling_autocorr("_dv", "_dvlag", w, 20),
        }
    )
    x = runs.signed_run(x, "_hi", w, "vol_regime_run")
    return x.drop("_ret", "_vchg", "_dv", "_dvlag", "_hi")


def post_fomc_flag(days_since: Column) -> Column:
    """Within two business days after a meeting, NULL before the first one."""
    return F.when(days_since.isNotNull(), (days_since <= 2).cast("double"))


def cross_asset(daily: DataFrame, keys: Sequence[str], date: str = "date") -> DataFrame:
    """Returns, ratios to the index with their changes, and the bond correlation."""
    w = by(keys, date)
    x = daily.withColumns(
        {
            **{f"{t}_spx_ratio": div(t, "spy") for t in ("qqq", "iwm", "eem", "tlt")},
            "spx_iwm_ratio": div("spy", "iwm"), "_r": wn.pct_change("spy", w), "_b": wn.pct_change("tlt", w),
        }
    )
    cols = {f"spx_ret_{n}d": wn.pct_change("spy", w, n) for n in (5, 20, 60)}
    cols |= {f"tlt_ret_{n}d": wn.pct_change("tlt", w, n) for n in (5, 20)}
    for r in ("qqq_spx_ratio", "iwm_spx_ratio", "eem_spx_ratio", "spx_iwm_ratio", "tlt_spx_ratio"):
        cols |= {f"{r}_chg_{n}d": wn.pct_change(r, w, n) for n in (5, 20)}
    cols["tlt_spx_corr_20d"] = wn.rolling_corr("_r", "_b", w, 20)
    return x.withColumns(cols).drop("tlt_spx_ratio", "_r", "_b")


def breadth(daily: DataFrame, keys: Sequence[str], date: str = "date", sectors: Sequence[str] = ("xlf", "xlk", "xle")) -> DataFrame:
    """Equal-weight against cap-weight, term ratio, sector spreads and divergence, thrust."""
    w = by(keys, date)
    x = daily.withColumns({"vix_vxv_ratio": div("vix", "vix3m"), "rsp_spy_ratio": div("rsp", "spy"), "_r1": wn.pct_change("rsp", w), "_s20": wn.pct_change("spy", w, 20)})
    spread = {s: wn.pct_change(s, w, 20) for s in sectors}

    def up(c: Column) -> Column:
        return F.coalesce(c > 0, F.lit(False))

    count, wide = F.lit(0), F.lit(0)
    for s in sectors:
        count = count + (up(spread[s]) != up(F.col("_s20"))).cast("long")
        wide = wide + F.coalesce((F.abs(spread[s] - F.col("_s20")) > 0.01).cast("long"), F.lit(0))
    cols = {
        "vix_vxv_zscore_21d": wn.zscore("vix_vxv_ratio", w, 21),
        "vix_term_structure_slope": F.col("vix3m") - F.col("vix"),
        "rsp_spy_ratio_chg_5d": wn.pct_change("rsp_spy_ratio", w, 5), "rsp_spy_ratio_chg_20d": wn.pct_change("rsp_spy_ratio", w, 20),
        "rsp_spy_ratio_zscore_21d": wn.zscore("rsp_spy_ratio", w, 21),
        "iwm_spy_ret_spread_20d": wn.pct_change("iwm", w, 20) - F.col("_s20"),
        **{f"{s}_spy_spread_20d": spread[s] - F.col("_s20") for s in sectors},
        **{f"{s}_spy_spread_1d": wn.pct_change(s, w) - wn.pct_change("spy", w) for s in sectors},
        "sector_divergence_count": count, "sector_wide_count": wide,
        "breadth_thrust": wn.rolling_mean("_r1", w, 5), "breadth_thrust_cumulative_5d": wn.rolling_sum("_r1", w, 5),
    }
    x = x.withColumns(cols).withColumn("sector_divergence_flag", (F.col("sector_divergence_count") >= 2).cast("long"))
    return x.drop("_r1", "_s20")


# Names of the macro series, and those compared by difference.
MACRO = ("fed_funds_rate", "yield_2y", "yield_10y", "yield_spread_2y10y", "ig_spread", "hy_spread", "wti_crude", "gold_fix_am", "dxy_broad")
BY_DIFFERENCE = ("fed_funds_rate", "yield_spread_2y10y")


def macro(daily: DataFrame, keys: Sequence[str], date: str = "date", policy_band: float = 0.1) -> DataFrame:
    """Curve, credit and policy signals plus changes, averages and trends per series.

    Series are forward-filled first; gaps would otherwise break the changes.
    """
    w = by(keys, date)
    base = [c for c in MACRO if c != "yield_spread_2y10y"]
    x = daily.withColumns({c: wn.ffill(c, w) for c in base})
    x = x.withColumn("yield_spread_2y10y", F.col("yield_10y") - F.col("yield_2y")).withColumn("credit_stress", F.col("hy_spread") - F.col("ig_spread"))
    cols: dict[str, Column] = {"yield_curve_inverted": F.coalesce((F.col("yield_spread_2y10y") < 0).cast("long"), F.lit(0))}
    step = wn.diff("fed_funds_rate", w, 21)
    cols["fed_policy_direction"] = F.when(step > policy_band, 1).when(step < -policy_band, -1).otherwise(0).cast("long")
    cols["credit_stress_chg_20d"] = wn.diff("credit_stress", w, 20)
    for c in MACRO:
        change = wn.diff if c in BY_DIFFERENCE else wn.pct_change
        for n in (5, 20, 21, 63):
            cols[f"{c}_chg_{n}d"] = change(c, w, n)
        ma = wn.rolling_mean(c, w, 20)
        cols[f"{c}_ma20"] = ma
        cols[f"{c}_above_ma20"] = F.coalesce((F.col(c) > ma).cast("long"), F.lit(0))
        cols[f"{c}_trend"] = div(c, ma) - 1.0
    return x.withColumns(cols)


def business_cycle(daily: DataFrame, keys: Sequence[str], date: str = "date") -> DataFrame:
    """Purchasing-manager and leading-index levels, changes, crosses and the phase code."""
    w = by(keys, date)
    p, prev = F.col("ism_pmi"), F.lag("ism_pmi").over(w)

    def flag(c: Column) -> Column:
        return F.coalesce(c.cast("long"), F.lit(0))

    x = daily.withColumns(
        {
            "pmi_expanding": flag(p >= 50), "pmi_contracting": flag(p < 50), "pmi_above_52": flag(p >= 52), "pmi_below_48": flag(p <= 48),
            "pmi_chg_1m": wn.diff("ism_pmi", w, 21), "pmi_chg_3m": wn.diff("ism_pmi", w, 63),
            "pmi_cross_50": F.when((p >= 50) & (prev < 50), 1).when((p < 50) & (prev >= 50), -1).otherwise(0).cast("long"),
            "lei_chg_1m": wn.diff("lei", w, 21), "lei_chg_3m": wn.diff("lei", w, 63),
        }
    )
    lei3 = F.col("lei_chg_3m")
    phase = (
        F.when((p >= 52) & (lei3 >= 0), 3).when((p >= 48) & (p < 52), 2)
        .when((p < 48) & (F.col("pmi_chg_3m") > 0) & (lei3 >= 0), 0).otherwise(1)
    )
    return x.withColumns(
        {
            "lei_rising": flag(F.col("lei_chg_1m") > 0), "lei_falling": flag(F.col("lei_chg_1m") < 0),
            "lei_3m_direction": F.coalesce(F.signum(lei3), F.lit(0.0)).cast("long"), "business_cycle_phase": phase.cast("long"),
        }
    )


def gap_fill_features(daily: DataFrame, keys: Sequence[str], date: str = "date") -> DataFrame:
    """Share of recent gap reversals, the previous outcome and the overnight move."""
    w = by(keys, date)
    return daily.withColumns(
        {
            "gap_fill_rate_5d": wn.rolling_mean("gap_reversal", w, 5, 1), "gap_fill_rate_20d": wn.rolling_mean("gap_reversal", w, 20, 5),
            "prev_outcome": F.lag("outcome").over(w), "overnight_range_pct": pct_over("open", F.lag("close").over(w)),
        }
    )


def term_slopes(short: str, mid: str, long: str) -> dict[str, Column]:
    """Term structure as differences, log ratios, and an inversion flag."""
    s, m, l = F.col(short), F.col(mid), F.col(long)
    ratio = div_pos(s, m)
    return {
        "slope_diff_short_mid": m - s, "slope_diff_short_long": l - s,
        "slope_log_short_mid": safe_ln(F.when((s > 0) & (m > 0), div(m, s))),
        "slope_log_short_long": safe_ln(F.when((s > 0) & (l > 0), div(l, s))),
        "slope_ratio": ratio, "inverted": F.when(ratio.isNotNull(), (ratio > 1.0).cast("double")),
    }


def surface_history(daily: DataFrame, keys: Sequence[str], date: str = "date") -> DataFrame:
    """Rolling means, spreads, z-scores and rank of the daily ATM volatility and skew."""
    w = by(keys, date)
    cols: dict[str, Column] = {}
    for c in ("atm_iv", "skew_25d"):
        for n in (5, 21):
            m = max(3, n // 2)
            cols[f"{c}_{n}day_mean"] = wn.rolling_mean(c, w, n, m)
            cols[f"{c}_{n}day_std"] = wn.rolling_std(c, w, n, m)
        cols[f"{c}_zscore_21day"] = wn.zscore(c, w, 21, 10)
    cols["iv_rank_30day"] = wn.pct_rank_of_last("atm_iv", w, 30, 10, 100.0)
    return daily.withColumns(cols)
