"""Rolling windows, run lengths and indicators over daily and session bars."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strikeline.catalog import base
from strikeline.catalog.base import query
from strikeline.functions.scalar import div, pct_over
from strikeline.operators import indicators as ind
from strikeline.operators import runs
from strikeline.operators import windows as wn
from strikeline.operators.bars import first_known, last_known, ohlc, opening_moves, opening_moves_by_rows, roll_up
from strikeline.operators.slicing import rolling_over_ticks, with_time_slice

def wd():  # noqa: ANN201
    """Window over a symbol's daily rows; needs a running session, hence a function."""
    return W.partitionBy("sym").orderBy("d")


@query("bars_ohlc_hourly", "A1 S1", """
SELECT event_type AS sym, date_trunc('hour', ts) AS bar, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*) AS n
FROM events GROUP BY 1, 2
""", num="open high low close", time="bar")
def _(spark, d):
    e = base.table(spark, d, "events").select("ts", "event_type", "value")
    return ohlc(e, [F.col("event_type").alias("sym"), F.window("ts", "1 hour").getField("start").alias("bar")], "ts", "value", [F.count(F.lit(1)).alias("n")])


@query("bars_rolled_to_day", "A1 W27", """
SELECT sym, d, arg_min(open, bar) AS open, max(high) AS high, min(low) AS low, arg_max(close, bar) AS close FROM bars5 GROUP BY 1, 2
""", uses="bars5", num="open high low close", day="d")
def _(spark, d):
    return roll_up(base.bars5(spark, d), ["sym", "d"], "bar")


@query("last_and_first_value_per_day", "A2 A3", """
SELECT CAST(ts AS DATE) AS d, arg_max(value, ts) FILTER (value > 1) AS last_v, arg_min(value, ts) FILTER (value > 1) AS first_v FROM events GROUP BY 1
""", num="last_v first_v", day="d")
def _(spark, d):
    e = base.table(spark, d, "events").select(F.col("ts").cast("date").alias("d"), "ts", F.when(F.col("value") > 1, F.col("value")).alias("v"))
    return last_known(e, ["d"], "ts", ["v"]).withColumnRenamed("v", "last_v").join(first_known(e, ["d"], "ts", ["v"]).withColumnRenamed("v", "first_v"), "d")


@query("returns_and_changes", "W1 W2 W3 W4", """
SELECT sym, d, lag(close) OVER w AS prev, close / nullif(lag(close, 5) OVER w, 0) - 1 AS pct5, close - lag(close, 21) OVER w AS diff21, ln(close / nullif(lag(close) OVER w, 0)) AS logret
FROM daily WINDOW w AS (PARTITION BY sym ORDER BY d)
""", uses="daily", num="prev pct5 diff21 logret", day="d")
def _(spark, d):
    return base.daily(spark, d).select(
        "sym", "d", wn.shift("close", wd()).alias("prev"), wn.pct_change("close", wd(), 5).alias("pct5"),
        wn.diff("close", wd(), 21).alias("diff21"), wn.log_return("close", wd()).alias("logret"),
    )


def _gated(agg: str, n: int, m: int, c: str = "close") -> str:
    f = f"OVER (PARTITION BY sym ORDER BY d ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({c}) {f} >= {m} THEN {agg}({c}) {f} END"


@query("rolling_mean_min_periods", "W5", f"""
SELECT sym, d, {_gated('avg', 20, 20)} AS m20, {_gated('avg', 20, 10)} AS m20_half, {_gated('avg', 15, 5)} AS m15_third, {_gated('avg', 7, 3)} AS m7 FROM daily
""", uses="daily", num="m20 m20_half m15_third m7", day="d", digits=4)
def _(spark, d):
    return base.daily(spark, d).select(
        "sym", "d", wn.rolling_mean("close", wd(), 20).alias("m20"), wn.rolling_mean("close", wd(), 20, 10).alias("m20_half"),
        wn.rolling_mean("close", wd(), 15, 5).alias("m15_third"), wn.rolling_mean("close", wd(), 7, 3).alias("m7"),
    )


@query("rolling_std_var_annualised", "W6", f"""
SELECT sym, d, {_gated('stddev_samp', 10, 5, 'r')} * sqrt(252.0) AS rv10, {_gated('stddev_samp', 20, 10, 'r')} * sqrt(390.0 * 252.0) AS rv20m, {_gated('var_samp', 20, 20, 'r')} AS var20
FROM (SELECT *, ln(close / lag(close) OVER (PARTITION BY sym ORDER BY d)) AS r FROM daily)
""", uses="daily", num="rv10 rv20m var20", day="d")
def _(spark, d):
    x = base.daily(spark, d).withColumn("r", wn.log_return("close", wd()))
    return x.select(
        "sym", "d", (wn.rolling_std("r", wd(), 10, 5) * ind.DAY).alias("rv10"), (wn.rolling_std("r", wd(), 20, 10) * ind.MINUTE).alias("rv20m"),
        wn.rolling_var("r", wd(), 20).alias("var20"),
    )


@query("zscore_21", "W7", f"""
SELECT sym, d, (close - {_gated('avg', 21, 10)}) / nullif({_gated('stddev_samp', 21, 10)}, 0) AS z FROM daily
""", uses="daily", num="z", day="d")
def _(spark, d):
    return base.daily(spark, d).select("sym", "d", wn.zscore("close", wd(), 21, 10).alias("z"))


@query("rolling_sum_max_min", "W8", f"""
SELECT sym, d, CAST({_gated('sum', 14, 14, 'volume')} AS BIGINT) AS s, {_gated('max', 14, 7, 'high')} AS hi, {_gated('min', 14, 7, 'low')} AS lo FROM daily
""", uses="daily", num="hi lo", day="d")
def _(spark, d):
    return base.daily(spark, d).select(
        "sym", "d", wn.rolling_sum("volume", wd(), 14).alias("s"), wn.rolling_max("high", wd(), 14, 7).alias("hi"), wn.rolling_min("low", wd(), 14, 7).alias("lo")
    )


@query("rolling_corr_autocorr", "W9 W10", """
SELECT sym, d, CASE WHEN count(CASE WHEN a IS NOT NULL AND v IS NOT NULL THEN 1 END) OVER f >= 20 THEN corr(a, v) OVER f END AS corr20,
  CASE WHEN count(CASE WHEN a IS NOT NULL AND la IS NOT NULL THEN 1 END) OVER g >= 19 THEN corr(a, la) OVER g END AS autocorr20
FROM (SELECT *, lag(a) OVER (PARTITION BY sym ORDER BY d) AS la FROM (
  SELECT sym, d, close - lag(close) OVER (PARTITION BY sym ORDER BY d) AS a, high - low + 0.001 * open AS v FROM daily))
WINDOW f AS (PARTITION BY sym ORDER BY d ROWS 19 PRECEDING), g AS (PARTITION BY sym ORDER BY d ROWS 18 PRECEDING)
""", uses="daily", num="corr20 autocorr20", day="d")
def _(spark, d):
    x = base.daily(spark, d).select("sym", "d", wn.diff("close", wd()).alias("a"), (F.col("high") - F.col("low") + 0.001 * F.col("open")).alias("v"))
    x = x.withColumn("la", F.lag("a").over(wd()))
    return x.select("sym", "d", wn.rolling_corr("a", "v", wd(), 20).alias("corr20"), wn.rolling_autocorr("a", "la", wd(), 20).alias("autocorr20"))


@query("rolling_percentile_rank", "W11", """
SELECT sym, d, CASE WHEN len(l) >= 20 THEN (len(list_filter(l, lambda x: x < close)) + (len(list_filter(l, lambda x: x = close)) + 1) / 2.0) / len(l) END AS pct_rank,
  CASE WHEN len(l) >= 20 THEN len(list_filter(l, lambda x: x <= close)) / len(l) END AS share_le
FROM (SELECT sym, d, close, list(close) OVER (PARTITION BY sym ORDER BY d ROWS 59 PRECEDING) AS l FROM daily)
""", uses="daily", num="pct_rank share_le", day="d")
def _(spark, d):
    return base.daily(spark, d).select("sym", "d", wn.pct_rank_of_last("close", wd(), 60, 20).alias("pct_rank"), wn.share_at_or_below("close", wd(), 60, 20).alias("share_le"))


def _ewm(c: str, alpha: str) -> str:
    return f"list_reduce(list({c}) OVER (PARTITION BY sym ORDER BY d ROWS UNBOUNDED PRECEDING), lambda a, x: a + ({alpha}) * (x - a))"


@query("ewm_span_and_alpha", "W12", f"""
SELECT sym, d, CASE WHEN rn >= 20 THEN {_ewm('close', '2.0 / 21')} END AS ema20, {_ewm('close', '1.0 / 14')} AS wilder14
FROM (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY d) AS rn FROM daily)
""", uses="daily", num="ema20 wilder14", day="d", digits=4)
def _(spark, d):
    return wn.with_ewm(base.daily(spark, d), ["sym"], "d", {"ema20": wn.span("close", 20), "wilder14": ("close", 1.0 / 14, 1)}).select("sym", "d", "ema20", "wilder14")


def _ewm_gaps(decay: str) -> str:
    """The recursion as a fold over (value, weight of the past); ``decay``: what a row without a value does to the weight."""
    return f"""list_reduce(list({{'y': x, 'w': 1.0::DOUBLE}}) OVER (PARTITION BY sym ORDER BY d ROWS UNBOUNDED PRECEDING), lambda a, v:
      CASE WHEN a.y IS NULL THEN v WHEN v.y IS NULL THEN {{'y': a.y, 'w': a.w * {decay}}}
      ELSE {{'y': (a.w * 0.6 * a.y + 0.4 * v.y) / (a.w * 0.6 + 0.4), 'w': 1.0::DOUBLE}} END).y"""


@query("ewm_with_gaps", "W12", f"""
SELECT sym, d, {_ewm_gaps('0.6')} AS aged, {_ewm_gaps('1.0')} AS skipped, CASE WHEN count(x) OVER (PARTITION BY sym ORDER BY d) >= 5 THEN {_ewm_gaps('0.6')} END AS after_five
FROM (SELECT sym, d, CAST(CASE WHEN CAST(floor(close) AS BIGINT) % 6 < 2 OR (month(d) BETWEEN 3 AND 8) THEN NULL ELSE close END AS DOUBLE) AS x FROM daily)
""", uses="daily", num="aged skipped after_five", day="d", digits=4)
def _(spark, d):
    gone = (F.floor("close").cast("long") % 6 < 2) | F.month("d").between(3, 8)
    x = base.daily(spark, d).select("sym", "d", F.when(~gone, F.col("close")).alias("x"))
    x = wn.with_ewm(x, ["sym"], "d", {"aged": ("x", 0.4, 1), "after_five": ("x", 0.4, 5)})
    return wn.with_ewm(x, ["sym"], "d", {"skipped": ("x", 0.4, 1)}, ignore_null=True).select("sym", "d", "aged", "skipped", "after_five")


@query("session_running_values", "W13 W14 W26", """
SELECT sym, bar, avg((high + low + close) / 3.0) OVER w AS vwap, max(high) OVER w AS rh, min(low) OVER w AS rl,
  max(high) FILTER (hour(bar) < 10) OVER (PARTITION BY sym, d) AS orb_high, min(low) FILTER (hour(bar) < 10) OVER (PARTITION BY sym, d) AS orb_low
FROM bars5 WINDOW w AS (PARTITION BY sym, d ORDER BY bar ROWS UNBOUNDED PRECEDING)
""", uses="bars5", num="vwap rh rl orb_high orb_low", time="bar", digits=9)
def _(spark, d):
    w, day = W.partitionBy("sym", "d").orderBy("bar"), W.partitionBy("sym", "d")
    early = F.hour("bar") < 10
    return base.bars5(spark, d).select(
        "sym", "bar", wn.expanding_mean((F.col("high") + F.col("low") + F.col("close")) / 3.0, w).alias("vwap"),
        wn.running_max("high", w).alias("rh"), wn.running_min("low", w).alias("rl"),
        F.max(F.when(early, F.col("high"))).over(day).alias("orb_high"), F.min(F.when(early, F.col("low"))).over(day).alias("orb_low"),
    )


@query("run_length_of_condition", "W16", """
SELECT sym, d, CAST(CASE WHEN up THEN row_number() OVER (PARTITION BY sym, g, up ORDER BY d) ELSE 0 END AS BIGINT) AS run
FROM (SELECT *, sum(CASE WHEN up THEN 0 ELSE 1 END) OVER (PARTITION BY sym ORDER BY d) AS g FROM (
  SELECT sym, d, coalesce(close > lag(close) OVER (PARTITION BY sym ORDER BY d), false) AS up FROM daily))
""", uses="daily", day="d")
def _(spark, d):
    x = base.daily(spark, d).withColumn("up", F.col("close") > F.lag("close").over(wd()))
    return runs.run_of_true(x, "up", wd(), "run").select("sym", "d", "run")


@query("signed_run_length", "W17", """
SELECT sym, d, CAST(CASE WHEN hi THEN 1 ELSE -1 END * row_number() OVER (PARTITION BY sym, g ORDER BY d) AS BIGINT) AS run
FROM (SELECT *, sum(chg) OVER (PARTITION BY sym ORDER BY d) AS g FROM (
  SELECT sym, d, close > 250000 AS hi, CASE WHEN (close > 250000) IS DISTINCT FROM lag(close > 250000) OVER (PARTITION BY sym ORDER BY d) THEN 1 ELSE 0 END AS chg FROM daily))
""", uses="daily", day="d")
def _(spark, d):
    x = base.daily(spark, d).withColumn("hi", F.col("close") > 250000)
    return runs.signed_run(x, "hi", wd(), "run").select("sym", "d", "run")


@query("win_loss_streaks", "W18", """
SELECT sym, d, CAST(lag(n - ll) OVER w AS BIGINT) AS wins, CAST(lag(n - lw) OVER w AS BIGINT) AS losses FROM (
  SELECT sym, d, n, coalesce(max(n) FILTER (o = 0) OVER v, 0) AS ll, coalesce(max(n) FILTER (o = 1) OVER v, 0) AS lw FROM (
    SELECT sym, d, o, count(o) OVER (PARTITION BY sym ORDER BY d) AS n FROM (
      SELECT sym, d, CASE WHEN volume = 1 THEN NULL WHEN close > open THEN 1 ELSE 0 END AS o FROM daily))
  WINDOW v AS (PARTITION BY sym ORDER BY d)) WINDOW w AS (PARTITION BY sym ORDER BY d)
""", uses="daily", day="d")
def _(spark, d):
    x = base.daily(spark, d).withColumn("o", F.when(F.col("volume") > 1, (F.col("close") > F.col("open")).cast("int")))
    return runs.streaks(x, ["sym"], "d", "o", "wins", "losses").select("sym", "d", "wins", "losses")


@query("state_duration_and_switch", "W19", """
SELECT sym, d, st, CAST(row_number() OVER (PARTITION BY sym, g ORDER BY d) AS BIGINT) AS duration, chg AS switched
FROM (SELECT *, sum(chg) OVER (PARTITION BY sym ORDER BY d) AS g FROM (
  SELECT sym, d, st, CAST(CASE WHEN lag(st) OVER w IS NULL OR lag(st) OVER w = st THEN 0 ELSE 1 END AS BIGINT) AS chg
  FROM (SELECT sym, d, CAST(CASE WHEN close < 150000 THEN 0 WHEN close < 350000 THEN 1 ELSE 2 END AS BIGINT) AS st FROM daily)
  WINDOW w AS (PARTITION BY sym ORDER BY d)))
""", uses="daily", day="d")
def _(spark, d):
    st = F.when(F.col("close") < 150000, 0).when(F.col("close") < 350000, 1).otherwise(2).cast("long")
    x = base.daily(spark, d).select("sym", "d", st.alias("st"))
    return runs.run_of_state(x, "st", wd(), "duration", "switched")


@query("forward_fill_limits", "W20", """
SELECT sym, d, last_value(v IGNORE NULLS) OVER (PARTITION BY sym ORDER BY d ROWS UNBOUNDED PRECEDING) AS f_all,
  last_value(v IGNORE NULLS) OVER (PARTITION BY sym ORDER BY d ROWS 5 PRECEDING) AS f5, last_value(v IGNORE NULLS) OVER (PARTITION BY sym ORDER BY d ROWS 2 PRECEDING) AS f2
FROM (SELECT sym, d, CASE WHEN close > 330000 THEN close END AS v FROM daily)
""", uses="daily", num="f_all f5 f2", day="d")
def _(spark, d):
    x = base.daily(spark, d).select("sym", "d", F.when(F.col("close") > 330000, F.col("close")).alias("v"))
    return x.select("sym", "d", wn.ffill("v", wd()).alias("f_all"), wn.ffill("v", wd(), 5).alias("f5"), wn.ffill("v", wd(), 2).alias("f2"))


@query("rolling_over_raw_ticks", "W5 W6", """
SELECT event_id, avg(value) OVER f AS m30, CASE WHEN count(value) OVER f >= 15 THEN stddev_samp(value) OVER f END AS s30
FROM events WINDOW f AS (PARTITION BY event_type ORDER BY ts, event_id ROWS 29 PRECEDING)
""", num="m30 s30")
def _(spark, d):
    e = with_time_slice(base.table(spark, d, "events").select("event_id", "event_type", "ts", "value"), "ts", 86_400)
    x = rolling_over_ticks(
        e, ["event_type"], ["ts", "event_id"], "_slice", 30,
        lambda w: {"m30": wn.rolling_mean("value", w, 30, 1), "s30": wn.rolling_std("value", w, 30, 15)},
    )
    return x.select("event_id", "m30", "s30")


# --- indicators -------------------------------------------------------------

_logs = """
SELECT *, ln(open / prev) AS gapln, ln(close / prev) AS ret, ln(high / open) * (ln(high / open) - ln(close / open)) + ln(low / open) * (ln(low / open) - ln(close / open)) AS rs,
  greatest(high - low, abs(high - prev), abs(low - prev)) AS tr, close - prev AS chg
FROM (SELECT *, lag(close) OVER (PARTITION BY sym ORDER BY d) AS prev FROM daily)
"""
base.cte("dlogs", _logs, "daily")


@query("rsi_wilder_and_simple", "I1", f"""
SELECT sym, d, CASE WHEN n >= 14 THEN 100 - 100 / (1 + up / nullif(dn, 0)) END AS rsi, 100 - 100 / (1 + su / nullif(sd, 0)) AS rsi_simple FROM (
  SELECT sym, d, count(chg) OVER (PARTITION BY sym ORDER BY d) AS n,
    list_reduce(list_filter(list(greatest(chg, 0.0)) OVER u, lambda x: x IS NOT NULL), lambda a, x: a + (1.0/14) * (x - a)) AS up,
    list_reduce(list_filter(list(greatest(-chg, 0.0)) OVER u, lambda x: x IS NOT NULL), lambda a, x: a + (1.0/14) * (x - a)) AS dn,
    CASE WHEN count(chg) OVER f >= 14 THEN avg(greatest(chg, 0.0)) FILTER (chg IS NOT NULL) OVER f END AS su,
    CASE WHEN count(chg) OVER f >= 14 THEN avg(greatest(-chg, 0.0)) FILTER (chg IS NOT NULL) OVER f END AS sd
  FROM (SELECT * FROM dlogs WHERE prev IS NOT NULL) WINDOW u AS (PARTITION BY sym ORDER BY d ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY sym ORDER BY d ROWS 13 PRECEDING))
UNION ALL SELECT sym, d, NULL, NULL FROM dlogs WHERE prev IS NULL
""", uses="dlogs", num="rsi rsi_simple", day="d")
def _(spark, d):
    x = ind.with_log_parts(base.daily(spark, d), wd())
    return ind.rsi_simple(ind.rsi_wilder(x, ["sym"], "d"), wd()).select("sym", "d", "rsi", "rsi_simple")


@query("macd_histogram", "I2", f"""
SELECT sym, d, CASE WHEN rn >= 34 THEN macd - list_reduce(list_filter(list(macd) OVER (PARTITION BY sym ORDER BY d ROWS UNBOUNDED PRECEDING), lambda x: x IS NOT NULL), lambda a, x: a + 0.2 * (x - a)) END AS macd_hist
FROM (SELECT sym, d, rn, CASE WHEN rn >= 26 THEN {_ewm('close', '2.0 / 13')} - {_ewm('close', '2.0 / 27')} END AS macd
  FROM (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY d) AS rn FROM daily))
""", uses="daily", num="macd_hist", day="d", digits=3)
def _(spark, d):
    return ind.macd_histogram(base.daily(spark, d), ["sym"], "d").select("sym", "d", "macd_hist")


@query("bollinger_bands", "I3", f"""
SELECT sym, d, 4 * s / m AS bb_bandwidth, (close - (m - 2 * s)) / nullif(4 * s, 0) AS bb_pct_b
FROM (SELECT sym, d, close, {_gated('avg', 20, 10)} AS m, {_gated('stddev_samp', 20, 10)} AS s FROM daily)
""", uses="daily", num="bb_bandwidth bb_pct_b", day="d")
def _(spark, d):
    b = ind.bollinger(wd())
    return base.daily(spark, d).select("sym", "d", b["bb_bandwidth"].alias("bb_bandwidth"), b["bb_pct_b"].alias("bb_pct_b"))


@query("atr_and_simple_range", "I4", f"""
SELECT sym, d, {_gated('avg', 14, 7, 'tr')} / close * 100 AS atr_pct, {_gated('avg', 14, 7, '(high - low)')} AS atr_simple FROM dlogs
""", uses="dlogs", num="atr_pct atr_simple", day="d", digits=4)
def _(spark, d):
    x = ind.with_log_parts(base.daily(spark, d), wd())
    return x.select("sym", "d", (div(wn.rolling_mean("_tr", wd(), 14, 7), "close") * 100).alias("atr_pct"), wn.rolling_mean(F.col("high") - F.col("low"), wd(), 14, 7).alias("atr_simple"))


@query("efficiency_and_choppiness", "I5 I6", """
SELECT sym, d, abs(close - lag(close, 10) OVER w) / nullif(CASE WHEN count(chg) OVER e >= 10 THEN sum(abs(chg)) OVER e END, 0) AS er,
  CASE WHEN count(tr) OVER c >= 14 THEN 100 * log10(sum(tr) OVER c / nullif(max(high) OVER c - min(low) OVER c, 0)) / log10(14) END AS chop
FROM dlogs WINDOW w AS (PARTITION BY sym ORDER BY d), e AS (PARTITION BY sym ORDER BY d ROWS 9 PRECEDING), c AS (PARTITION BY sym ORDER BY d ROWS 13 PRECEDING)
""", uses="dlogs", num="er chop", day="d")
def _(spark, d):
    x = ind.with_log_parts(base.daily(spark, d), wd())
    return x.select("sym", "d", ind.efficiency_ratio(wd()).alias("er"), ind.choppiness(wd()).alias("chop"))


def _yz(n: int) -> str:
    k = 0.34 / (1.34 + (n + 1) / (n - 1))
    return (f"sqrt(greatest({_gated('var_samp', n, n, 'gapln')} + {k!r} * {_gated('var_samp', n, n, 'ret')} + {1 - k!r} * {_gated('avg', n, n, 'rs')}, 0.0) * 252)")


@query("yang_zhang_volatility", "I7", f"""
SELECT sym, d, CASE WHEN rn > 5 THEN {_yz(5)} END AS yz5, CASE WHEN rn > 20 THEN {_yz(20)} END AS yz20 FROM (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY d) AS rn FROM dlogs)
""", uses="dlogs", num="yz5 yz20", day="d")
def _(spark, d):
    x = ind.with_log_parts(base.daily(spark, d), wd())
    return x.select("sym", "d", ind.yang_zhang(wd(), 5).alias("yz5"), ind.yang_zhang(wd(), 20).alias("yz20"))


@query("garman_klass_volatility", "I8", """
SELECT sym, bar, CASE WHEN count(*) OVER f >= 10 THEN sqrt(greatest(avg(g) OVER f, 0.0) * 390.0 * 252.0) END AS gk
FROM (SELECT *, 0.5 * ln(high / low) * ln(high / low) - (2 * ln(2) - 1) * ln(close / open) * ln(close / open) AS g FROM bars5)
WINDOW f AS (PARTITION BY sym, d ORDER BY bar ROWS 29 PRECEDING)
""", uses="bars5", num="gk", time="bar")
def _(spark, d):
    w = W.partitionBy("sym", "d").orderBy("bar")
    x = base.bars5(spark, d).withColumn("g", ind.garman_klass_part())
    return x.select("sym", "bar", F.sqrt(wn.clamp_zero(wn.rolling_mean("g", w, 30, 10)) * (390.0 * 252.0)).alias("gk"))


_sma = ", ".join(f"(close / {_gated('avg', n, n)} - 1) * 100 AS sma_{n}" for n in (5, 10, 20, 50, 100, 200))


@query("sma_ema_distance", "I9 F16", f"""
SELECT sym, d, {_sma}, CASE WHEN rn >= 5 THEN (close / {_ewm('close', '2.0 / 6')} - 1) * 100 END AS ema_5
FROM (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY d) AS rn FROM daily)
""", uses="daily", num="sma_5 sma_10 sma_20 sma_50 sma_100 sma_200 ema_5", day="d")
def _(spark, d):
    return wn.with_ewm(base.daily(spark, d), ["sym"], "d", {"_ema": wn.span("close", 5)}).select(
        "sym", "d", *[pct_over("close", wn.rolling_mean("close", wd(), n)).alias(f"sma_{n}") for n in (5, 10, 20, 50, 100, 200)],
        pct_over("close", "_ema").alias("ema_5"),
    )


@query("gap_and_range_percent", "I10 W27", """
SELECT sym, d, (open - prev) / prev * 100 AS gap_pct, (close - open) / open * 100 AS open_to_close_pct, (high - low) / open * 100 AS range_pct FROM dlogs
""", uses="dlogs", num="gap_pct open_to_close_pct range_pct", day="d")
def _(spark, d):
    return base.daily(spark, d).select(
        "sym", "d", pct_over("open", F.lag("close").over(wd())).alias("gap_pct"), (div(F.col("close") - F.col("open"), "open") * 100).alias("open_to_close_pct"),
        (div(F.col("high") - F.col("low"), "open") * 100).alias("range_pct"),
    )


@query("opening_moves_by_clock", "I11 W26 W27", """
SELECT sym, d, day_open, prev_close, (day_open - prev_close) / prev_close * 100 AS gap_pct, (c15 - day_open) / day_open * 100 AS first_15m_return_pct, r30 AS first_30m_return_pct,
  (c60 - day_open) / day_open * 100 AS first_60m_return_pct, g30 AS first_30m_range_pct, CAST(sign(r30) AS BIGINT) AS first_30m_direction, r30 / nullif(g30, 0) AS open_drive_strength,
  CASE WHEN c30 IS NOT NULL AND prev_close IS NOT NULL THEN CASE WHEN sign(day_open - prev_close) <> 0 AND sign(c30 - day_open) = -sign(day_open - prev_close) THEN 1.0 ELSE 0.0 END END AS prev_close_gap_reversal, session_close
FROM (SELECT *, lag(session_close) OVER (PARTITION BY sym ORDER BY d) AS prev_close, (c30 - day_open) / day_open * 100 AS r30, (h30 - l30) / day_open * 100 AS g30 FROM (
  SELECT sym, d, arg_min(open, bar) AS day_open, arg_max(close, bar) AS session_close, arg_max(close, bar) FILTER (m < 585) AS c15, arg_max(close, bar) FILTER (m < 600) AS c30,
    arg_max(close, bar) FILTER (m < 630) AS c60, max(high) FILTER (m < 600) AS h30, min(low) FILTER (m < 600) AS l30
  FROM (SELECT *, hour(bar) * 60 + minute(bar) AS m FROM bars5 WHERE hour(bar) * 60 + minute(bar) >= 570) GROUP BY 1, 2))
""", uses="bars5", num="day_open prev_close session_close gap_pct first_15m_return_pct first_30m_return_pct first_60m_return_pct first_30m_range_pct open_drive_strength prev_close_gap_reversal", day="d")
def _(spark, d):
    b = base.bars5(spark, d).where(F.hour("bar") * 60 + F.minute("bar") >= 570)
    return opening_moves(b, ["sym"], "d", "bar")


@query("opening_moves_by_rows", "I11", """
SELECT sym, d, bars, CASE WHEN ok THEN (c15 - o) / o * 100 END AS first_15m_return_pct, r30 AS first_30m_return_pct, CASE WHEN ok THEN (c60 - o) / o * 100 END AS first_60m_return_pct,
  g30 AS first_30m_range_pct, CAST(CASE WHEN abs(r30) < 0.001 THEN 0 ELSE sign(r30) END AS BIGINT) AS first_30m_direction, CASE WHEN ok THEN v30 / v END AS first_30m_vol_ratio,
  CASE WHEN ok THEN CASE WHEN g30 > 0.001 THEN r30 / g30 ELSE 0.0 END END AS open_drive_strength
FROM (SELECT *, CASE WHEN ok THEN (c30 - o) / o * 100 END AS r30, CASE WHEN ok THEN (h30 - l30) / o * 100 END AS g30 FROM (
  SELECT sym, d, count(*) AS bars, count(*) >= 30 AS ok, arg_min(open, bar) AS o, max(close) FILTER (i = 15) AS c15, max(close) FILTER (i = 30) AS c30, max(close) FILTER (i = 60) AS c60,
    max(high) FILTER (i <= 30) AS h30, min(low) FILTER (i <= 30) AS l30, sum(volume) FILTER (i <= 30) AS v30, sum(volume) AS v
  FROM (SELECT *, row_number() OVER (PARTITION BY sym, d ORDER BY bar) AS i FROM bars5) GROUP BY 1, 2))
""", uses="bars5", num="first_15m_return_pct first_30m_return_pct first_60m_return_pct first_30m_range_pct first_30m_vol_ratio open_drive_strength", day="d")
def _(spark, d):
    return opening_moves_by_rows(base.bars5(spark, d), ["sym"], "d", "bar", "volume")


def _w(n: int) -> str:
    return f"OVER (PARTITION BY sym, d ORDER BY bar ROWS {n - 1} PRECEDING)"


def _sg(agg: str, c: str, n: int, m: int) -> str:
    return f"CASE WHEN count({c}) {_w(n)} >= {m} THEN {agg}({c}) {_w(n)} END"


base.cte("sess_feat", f"""
SELECT *, CASE WHEN 2.0 * sd < 1.5 * atr THEN 1 ELSE 0 END AS sq FROM (
SELECT sym, d, bar, close, {', '.join(f"(close / nullif(lag(close, {n}) OVER (PARTITION BY sym, d ORDER BY bar), 0) - 1) * 100 AS ret_{n}m" for n in (5, 10, 15, 30))},
  {', '.join(f"{_sg('stddev_samp', 'lr', n, max(2, n // 2))} * sqrt(390.0 * 252.0) AS rvol_{n}m" for n in (5, 10, 15, 30))},
  {', '.join(f"(close / ({_sg('avg', 'close', n, max(1, n // 3))}) - 1) * 100 AS vs_ma{n}" for n in (5, 15, 30))},
  (close / avg((high + low + close) / 3.0) OVER u - 1) * 100 AS vs_vwap,
  CASE WHEN max(high) OVER u > min(low) OVER u THEN (close - min(low) OVER u) / (max(high) OVER u - min(low) OVER u) ELSE 0.5 END AS pct_b,
  max(high) OVER u - min(low) OVER u AS running_range, {_sg('stddev_samp', 'close', 20, 10)} AS sd, {_sg('avg', '(high - low)', 20, 10)} AS atr,
  (oh - ol) / close * 100 AS orb_range_pct, CASE WHEN close >= ol AND close <= oh THEN 1.0 ELSE 0.0 END AS orb_containment,
  CASE WHEN close > oh THEN 1.0 WHEN close < ol THEN -1.0 ELSE 0.0 END AS orb_breakout_dir
FROM (SELECT *, ln(close / lag(close) OVER (PARTITION BY sym, d ORDER BY bar)) AS lr, max(high) FILTER (hour(bar) < 10) OVER (PARTITION BY sym, d) AS oh,
  min(low) FILTER (hour(bar) < 10) OVER (PARTITION BY sym, d) AS ol FROM bars5) WINDOW u AS (PARTITION BY sym, d ORDER BY bar ROWS UNBOUNDED PRECEDING))
""", "bars5")
_SESS = [c for c in ind.SESSION if c not in ("garman_klass_rv_30m", "ttm_squeeze", "bb_squeeze_duration")]


@query("session_indicators", "I12 I13 W13 W14", f"SELECT sym, bar, {', '.join(_SESS)} FROM sess_feat", uses="sess_feat", num=" ".join(_SESS), time="bar")
def _(spark, d):
    return ind.session_features(base.bars5(spark, d), ["sym"], "d", "bar").select("sym", "bar", *_SESS)


@query("ttm_squeeze_duration", "I14 W16", """
SELECT sym, bar, CAST(sq AS DOUBLE) AS ttm_squeeze, CAST(CASE WHEN sq = 1 THEN row_number() OVER (PARTITION BY sym, d, g, sq ORDER BY bar) ELSE 0 END AS BIGINT) AS bb_squeeze_duration
FROM (SELECT *, sum(1 - sq) OVER (PARTITION BY sym, d ORDER BY bar) AS g FROM sess_feat)
""", uses="sess_feat", num="ttm_squeeze", time="bar")
def _(spark, d):
    return ind.session_features(base.bars5(spark, d), ["sym"], "d", "bar").select("sym", "bar", "ttm_squeeze", "bb_squeeze_duration")


base.cte("bday", "SELECT sym, d, arg_min(open, bar) AS open, max(high) AS high, min(low) AS low, arg_max(close, bar) AS close FROM bars5 GROUP BY 1, 2", "bars5")
_ctx = ", ".join(f"lag({_gated('avg', n, max(3, n // 2))}) OVER w AS sma_{n}" for n in (7, 20))
base.cte("bctx", f"""
SELECT sym, d, lag(sma7) OVER w AS sma_7, lag(sma20) OVER w AS sma_20, lag(rv5) OVER w AS daily_rv_5, lag(rv20) OVER w AS daily_rv_20, lag(atr) OVER w AS atr_14 FROM (
SELECT sym, d, {_gated('avg', 7, 3)} AS sma7, {_gated('avg', 20, 10)} AS sma20, {_gated('stddev_samp', 5, 3, 'r')} * sqrt(252) AS rv5, {_gated('stddev_samp', 20, 10, 'r')} * sqrt(252) AS rv20,
  {_gated('avg', 14, 7, '(high - low)')} AS atr FROM (SELECT *, ln(close / lag(close) OVER (PARTITION BY sym ORDER BY d)) AS r FROM bday)) WINDOW w AS (PARTITION BY sym ORDER BY d)
""", "bday")


@query("cross_horizon_ratios", "I15 J4 J8", """
SELECT sym, bar, (close - sma_7) / sma_7 * 100 AS spx_vs_sma_7, (close - sma_20) / sma_20 * 100 AS spx_vs_sma_20,
  (close / (1 + vs_ma15 / 100) - sma_7) / sma_7 * 100 AS ma15_vs_sma_7, (close / (1 + vs_ma15 / 100) - sma_20) / sma_20 * 100 AS ma15_vs_sma_20,
  rvol_30m / nullif(daily_rv_5, 0) AS rvol_vs_daily_5, rvol_30m / nullif(daily_rv_20, 0) AS rvol_vs_daily_20, running_range / nullif(atr_14, 0) AS range_exhaustion
FROM sess_feat JOIN bctx USING (sym, d)
""", uses="sess_feat bctx", num="spx_vs_sma_7 spx_vs_sma_20 ma15_vs_sma_7 ma15_vs_sma_20 rvol_vs_daily_5 rvol_vs_daily_20 range_exhaustion", time="bar")
def _(spark, d):
    b = base.bars5(spark, d)
    f = ind.session_features(b, ["sym"], "d", "bar")
    ctx = ind.daily_context(roll_up(b, ["sym", "d"], "bar"), ["sym"], "d")
    x = f.join(ctx, ["sym", "d"], "left").withColumn("first_range", F.lit(None).cast("double"))
    cols = ind.cross_horizon("close", "vs_ma15", "rvol_30m", "running_range", "first_range")
    want = ["spx_vs_sma_7", "spx_vs_sma_20", "ma15_vs_sma_7", "ma15_vs_sma_20", "rvol_vs_daily_5", "rvol_vs_daily_20", "range_exhaustion"]
    return x.select("sym", "bar", *[cols[c].alias(c) for c in want])


def _cg(agg: str, c: str, n: int, m: int | None = None) -> str:
    f = f"OVER (ORDER BY date ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({c}) {f} >= {m or n} THEN {agg}({c}) {f} END"


def _pc(c: str, n: int) -> str:
    return f"({c} / nullif(lag({c}, {n}) OVER (ORDER BY date), 0) - 1)"


@query("volatility_index_daily", "I16 I17", f"""
SELECT date, vix, (vix / ({_cg('avg', 'vix', 10, 5)}) - 1) * 100 AS vix_vs_sma_10, (vix / ({_cg('avg', 'vix', 20, 10)}) - 1) * 100 AS vix_vs_sma_20,
  (vix - ({_cg('avg', 'vix', 21, 10)})) / ({_cg('stddev_samp', 'vix', 21, 10)}) AS vix_zscore_21, vix3m / vix AS term_ratio FROM closes
""", uses="closes", num="vix vix_vs_sma_10 vix_vs_sma_20 vix_zscore_21 term_ratio", day="date")
def _(spark, d):
    x = ind.index_vol_daily(base.closes(spark, d), [], "date", "vix", [(10, 5), (20, 10)], (21, 10))
    return x.select("date", "vix", "vix_vs_sma_10", "vix_vs_sma_20", "vix_zscore_21", div("vix3m", "vix").alias("term_ratio"))


@query("volatility_context", "I18 I17 W10 W17", f"""
SELECT date, {_cg('avg', 'vvix', 20)} AS vvix_ma20, (vvix - ({_cg('avg', 'vvix', 21)})) / ({_cg('stddev_samp', 'vvix', 21)}) AS vvix_zscore_21, vvix / vix AS vvix_vs_vix_ratio,
  ({_cg('stddev_samp', 'r', 10)}) * sqrt(252) * 100 - vix AS rv_iv_spread_10, CASE WHEN lag(fomc) OVER (ORDER BY date) = 1 THEN {_pc('vix', 1)} ELSE 0.0 END AS iv_change_after_fomc,
  CASE WHEN count(CASE WHEN dv IS NOT NULL AND ldv IS NOT NULL THEN 1 END) OVER g >= 19 THEN corr(dv, ldv) OVER g END AS vix_change_autocorr_20,
  CAST(CASE WHEN vix > 20 THEN 1 ELSE -1 END * row_number() OVER (PARTITION BY grp ORDER BY date) AS BIGINT) AS vol_regime_run
FROM (SELECT *, lag(dv) OVER (ORDER BY date) AS ldv, sum(chg) OVER (ORDER BY date) AS grp FROM (SELECT *, {_pc('spy', 1)} AS r, vix - lag(vix) OVER (ORDER BY date) AS dv,
  CASE WHEN (vix > 20) IS DISTINCT FROM lag(vix > 20) OVER (ORDER BY date) THEN 1 ELSE 0 END AS chg FROM closes)) WINDOW g AS (ORDER BY date ROWS 18 PRECEDING)
""", uses="closes", num="vvix_ma20 vvix_zscore_21 vvix_vs_vix_ratio rv_iv_spread_10 iv_change_after_fomc vix_change_autocorr_20", day="date")
def _(spark, d):
    return ind.vol_context(base.closes(spark, d), []).select(
        "date", "vvix_ma20", "vvix_zscore_21", "vvix_vs_vix_ratio", "rv_iv_spread_10", "iv_change_after_fomc", "vix_change_autocorr_20", "vol_regime_run"
    )


@query("cross_asset_ratios", "I19 W2 W9", f"""
SELECT date, {_pc('spy', 5)} AS spx_ret_5d, {_pc('spy', 60)} AS spx_ret_60d, qqq_spx_ratio, spx_iwm_ratio, {_pc('qqq_spx_ratio', 5)} AS qqq_spx_ratio_chg_5d,
  {_pc('tlt_spx_ratio', 20)} AS tlt_spx_ratio_chg_20d, CASE WHEN count(CASE WHEN r IS NOT NULL AND b IS NOT NULL THEN 1 END) OVER g >= 20 THEN corr(r, b) OVER g END AS tlt_spx_corr_20d
FROM (SELECT *, qqq / spy AS qqq_spx_ratio, tlt / spy AS tlt_spx_ratio, spy / iwm AS spx_iwm_ratio, {_pc('spy', 1)} AS r, {_pc('tlt', 1)} AS b FROM closes) WINDOW g AS (ORDER BY date ROWS 19 PRECEDING)
""", uses="closes", num="spx_ret_5d spx_ret_60d qqq_spx_ratio spx_iwm_ratio qqq_spx_ratio_chg_5d tlt_spx_ratio_chg_20d tlt_spx_corr_20d", day="date")
def _(spark, d):
    return ind.cross_asset(base.closes(spark, d), []).select(
        "date", "spx_ret_5d", "spx_ret_60d", "qqq_spx_ratio", "spx_iwm_ratio", "qqq_spx_ratio_chg_5d", "tlt_spx_ratio_chg_20d", "tlt_spx_corr_20d"
    )


@query("market_breadth", "I20 A38", f"""
SELECT date, vix / vix3m AS vix_vxv_ratio, vix3m - vix AS vix_term_structure_slope, rsp / spy AS rsp_spy_ratio, {_pc('iwm', 20)} - s20 AS iwm_spy_ret_spread_20d, {_pc('xlf', 1)} - {_pc('spy', 1)} AS xlf_spy_spread_1d,
  CAST((coalesce(f20 > 0, false) <> coalesce(s20 > 0, false))::INT + (coalesce(k20 > 0, false) <> coalesce(s20 > 0, false))::INT + (coalesce(e20 > 0, false) <> coalesce(s20 > 0, false))::INT AS BIGINT) AS sector_divergence_count,
  CAST(coalesce(abs(f20 - s20) > 0.01, false)::INT + coalesce(abs(k20 - s20) > 0.01, false)::INT + coalesce(abs(e20 - s20) > 0.01, false)::INT AS BIGINT) AS sector_wide_count,
  {_cg('avg', 'r1', 5)} AS breadth_thrust, {_cg('sum', 'r1', 5)} AS breadth_thrust_cumulative_5d
FROM (SELECT *, {_pc('spy', 20)} AS s20, {_pc('xlf', 20)} AS f20, {_pc('xlk', 20)} AS k20, {_pc('xle', 20)} AS e20, {_pc('rsp', 1)} AS r1 FROM closes)
""", uses="closes", num="vix_vxv_ratio vix_term_structure_slope rsp_spy_ratio iwm_spy_ret_spread_20d xlf_spy_spread_1d breadth_thrust breadth_thrust_cumulative_5d", day="date")
def _(spark, d):
    return ind.breadth(base.closes(spark, d), []).select(
        "date", "vix_vxv_ratio", "vix_term_structure_slope", "rsp_spy_ratio", "iwm_spy_ret_spread_20d", "xlf_spy_spread_1d", "sector_divergence_count", "sector_wide_count",
        "breadth_thrust", "breadth_thrust_cumulative_5d",
    )


_ff = ", ".join(f"last_value({c} IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS {c}" for c in ("fed_funds_rate", "yield_2y", "yield_10y", "ig_spread", "hy_spread", "gold_fix_am"))


@query("macro_signals", "I21 W3 W20", f"""
SELECT date, yield_10y - yield_2y AS yield_spread_2y10y, CAST(coalesce(yield_10y < yield_2y, false) AS BIGINT) AS yield_curve_inverted, hy_spread - ig_spread AS credit_stress,
  CAST(CASE WHEN ch > 0.1 THEN 1 WHEN ch < -0.1 THEN -1 ELSE 0 END AS BIGINT) AS fed_policy_direction, ch AS fed_funds_rate_chg_21d, {_pc('gold_fix_am', 5)} AS gold_fix_am_chg_5d,
  {_cg('avg', 'gold_fix_am', 20)} AS gold_fix_am_ma20, CAST(coalesce(gold_fix_am > ({_cg('avg', 'gold_fix_am', 20)}), false) AS BIGINT) AS gold_fix_am_above_ma20
FROM (SELECT *, fed_funds_rate - lag(fed_funds_rate, 21) OVER (ORDER BY date) AS ch FROM (SELECT date, {_ff} FROM closes))
""", uses="closes", num="yield_spread_2y10y credit_stress fed_funds_rate_chg_21d gold_fix_am_chg_5d gold_fix_am_ma20", day="date", digits=9)
def _(spark, d):
    return ind.macro(base.closes(spark, d), []).select(
        "date", "yield_spread_2y10y", "yield_curve_inverted", "credit_stress", "fed_policy_direction", "fed_funds_rate_chg_21d", "gold_fix_am_chg_5d", "gold_fix_am_ma20", "gold_fix_am_above_ma20"
    )


@query("business_cycle_phase", "I22", """
SELECT date, CAST(p >= 50 AS BIGINT) AS pmi_expanding, CAST(CASE WHEN p >= 50 AND lp < 50 THEN 1 WHEN p < 50 AND lp >= 50 THEN -1 ELSE 0 END AS BIGINT) AS pmi_cross_50, p - p63 AS pmi_chg_3m,
  CAST(coalesce(lei - l21 > 0, false) AS BIGINT) AS lei_rising, CAST(coalesce(sign(lei - l63), 0) AS BIGINT) AS lei_3m_direction,
  CAST(CASE WHEN p >= 52 AND lei - l63 >= 0 THEN 3 WHEN p >= 48 AND p < 52 THEN 2 WHEN p < 48 AND p - p63 > 0 AND lei - l63 >= 0 THEN 0 ELSE 1 END AS BIGINT) AS business_cycle_phase
FROM (SELECT date, ism_pmi AS p, lei, lag(ism_pmi) OVER w AS lp, lag(ism_pmi, 63) OVER w AS p63, lag(lei, 21) OVER w AS l21, lag(lei, 63) OVER w AS l63 FROM closes WINDOW w AS (ORDER BY date))
""", uses="closes", num="pmi_chg_3m", day="date")
def _(spark, d):
    return ind.business_cycle(base.closes(spark, d), []).select("date", "pmi_expanding", "pmi_cross_50", "pmi_chg_3m", "lei_rising", "lei_3m_direction", "business_cycle_phase")


@query("gap_fill_and_overnight", "I23 J9", """
SELECT sym, d, CASE WHEN count(g) OVER f5 >= 1 THEN avg(g) OVER f5 END AS gap_fill_rate_5d, CASE WHEN count(g) OVER f20 >= 5 THEN avg(g) OVER f20 END AS gap_fill_rate_20d,
  lag(CASE WHEN close > open THEN 1.0 ELSE 0.0 END) OVER w AS prev_outcome, (open - prev) / prev * 100 AS overnight_range_pct
FROM (SELECT *, CASE WHEN prev IS NOT NULL THEN CASE WHEN sign(open - prev) <> sign(close - open) THEN 1.0 ELSE 0.0 END END AS g FROM dlogs)
WINDOW w AS (PARTITION BY sym ORDER BY d), f5 AS (PARTITION BY sym ORDER BY d ROWS 4 PRECEDING), f20 AS (PARTITION BY sym ORDER BY d ROWS 19 PRECEDING)
""", uses="dlogs", num="gap_fill_rate_5d gap_fill_rate_20d prev_outcome overnight_range_pct", day="d")
def _(spark, d):
    x = base.daily(spark, d).withColumn("_p", F.lag("close").over(wd()))
    x = x.withColumns(
        {
            "gap_reversal": F.when(F.col("_p").isNotNull(), (F.signum(F.col("open") - F.col("_p")) != F.signum(F.col("close") - F.col("open"))).cast("double")),
            "outcome": (F.col("close") > F.col("open")).cast("double"),
        }
    )
    return ind.gap_fill_features(x, ["sym"], "d").select("sym", "d", "gap_fill_rate_5d", "gap_fill_rate_20d", "prev_outcome", "overnight_range_pct")


@query("cusum_change_score", "I26", """
SELECT sym, d, list_reduce(list_prepend(0.0, l), lambda a, x: greatest(0.0, a + x - 0.01)) AS cusum_up, list_reduce(list_prepend(0.0, l), lambda a, x: greatest(0.0, a - x - 0.01)) AS cusum_down
FROM (SELECT sym, d, list(ret) OVER (PARTITION BY sym ORDER BY d ROWS UNBOUNDED PRECEDING) AS l FROM dlogs WHERE ret IS NOT NULL)
""", uses="dlogs", num="cusum_up cusum_down", day="d")
def _(spark, d):
    x = ind.with_log_parts(base.daily(spark, d), wd()).where(F.col("_ret").isNotNull())
    return wn.with_cusum(x, wd(), "_ret", F.lit(0.0), F.lit(0.02)).select("sym", "d", "cusum_up", "cusum_down")
