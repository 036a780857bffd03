"""Decision state, spine and outcome queries over a chain derived from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from strikeline.catalog import base
from strikeline.catalog.base import cte, query
from strikeline.plans.decision_state import build_decision_state
from strikeline.plans.outcomes import build_outcomes
from strikeline.plans.spine import build_spine
from strikeline.plans.tables import settle

STATE_NUM = " ".join(
    f"{s}_{c}" for s in ("call", "put")
    for c in ("bid_close", "ask_close", "mid_close", "delta", "gamma", "theta", "vega", "rho", "implied_vol", "iv_error")
) + " " + " ".join(f"{p}_{c}" for p in ("spx", "vix", "vix1d") for c in ("open", "high", "low", "close"))


def state(spark, d):
    return build_decision_state(base.chain(spark, d), base.index_bars(spark, d))


@query("decision_state", "L1 A4 J1 P1 P2 P3 S3 W25", "SELECT * FROM state", uses="state", num=STATE_NUM, day="date", time="decision_datetime state_datetime")
def _(spark, d):
    return state(spark, d)


_strats = ", ".join(f"('IC_{d:02d}d_25w', {d / 100.0}, 25.0)" for d in range(5, 50, 5))
cte("strats", f"SELECT * FROM (VALUES {_strats}) AS t(strategy, delta, wing)")
# Two variants of the race share their statements: entries of the decision state (no suffix), and
# entries at the quote minute itself (suffix 1).


def _race_ctes(x: str, entries: str, unique: bool, ends: str) -> None:
    """CTEs from entries to outcomes. A minute's quotes are maps from strike to value, so that legs and
    paths need one join on the minute or the day instead of one for each leg."""
    cte(f"ent{x}", f"SELECT * FROM state{x} WHERE {entries}", f"state{x}")
    cte(f"quotes{x}", f"""
SELECT date, decision_datetime AS t, map(list(strike), list(call_mid_close)) AS cm, map(list(strike), list(put_mid_close)) AS pm,
  map(list(strike), list(call_delta)) AS cd, map(list(strike), list(put_delta)) AS pd, map(list(strike), list(call_implied_vol)) AS ci, map(list(strike), list(put_implied_vol)) AS pi
FROM state{x} GROUP BY 1, 2
""", f"state{x}")
    cte(f"scp{x}", f"""
SELECT decision_datetime, date, spx_close, strategy, wing, delta, arg_min(strike, (abs(call_delta - delta), strike)) AS sc
FROM ent{x}, strats WHERE call_delta > 0 AND call_delta < 1 AND call_bid_close > 0 GROUP BY ALL
""", f"ent{x} strats")
    cte(f"spp{x}", f"""
SELECT decision_datetime, strategy, arg_min(strike, (abs(put_delta + delta), strike)) AS sp
FROM ent{x}, strats WHERE put_delta < 0 AND put_delta > -1 AND put_bid_close > 0 GROUP BY ALL
""", f"ent{x} strats")
    cte(f"shorts{x}", f"""
SELECT a.*, b.sp FROM scp{x} a JOIN spp{x} b USING (decision_datetime, strategy) WHERE b.sp < a.spx_close AND a.spx_close < a.sc
""", f"scp{x} spp{x}")
    cte(f"longs{x}", f"""
SELECT s.decision_datetime, s.strategy,
  arg_min(e.strike, (abs(e.strike - (s.sc + s.wing)), -e.strike)) FILTER (e.call_bid_close > 0 AND abs(e.strike - (s.sc + s.wing)) <= 10) AS lc,
  arg_min(e.strike, (abs(e.strike - (s.sp - s.wing)), -e.strike)) FILTER (e.put_bid_close > 0 AND abs(e.strike - (s.sp - s.wing)) <= 10) AS lp
FROM shorts{x} s JOIN ent{x} e USING (decision_datetime) GROUP BY ALL
""", f"shorts{x} ent{x}")
    cte(f"spine_all{x}", f"""
SELECT s.decision_datetime, s.date, s.strategy, s.delta AS target, s.spx_close AS spx_prev_min_close, s.sc AS short_call, s.sp AS short_put, l.lc AS long_call, l.lp AS long_put,
  l.lc - s.sc AS call_wing_width, s.sp - l.lp AS put_wing_width, q.cd[s.sc] AS sc_delta, q.pd[s.sp] AS sp_delta, q.ci[s.sc] AS sc_iv, q.pi[s.sp] AS sp_iv,
  q.cm[s.sc] + q.pm[s.sp] - q.cm[l.lc] - q.pm[l.lp] AS raw_credit
FROM shorts{x} s JOIN longs{x} l USING (decision_datetime, strategy) JOIN quotes{x} q ON q.t = s.decision_datetime
WHERE l.lc IS NOT NULL AND l.lp IS NOT NULL
""", f"shorts{x} longs{x} quotes{x}")
    rank = "row_number() OVER (PARTITION BY decision_datetime, short_call, short_put, long_call, long_put ORDER BY target DESC)" if unique else "1"
    cte(f"spine{x}", f"""
SELECT * EXCLUDE (target, raw_credit, rn), round(raw_credit, 4) AS credit FROM (
  SELECT *, {rank} AS rn FROM spine_all{x} WHERE call_wing_width > 0 AND put_wing_width > 0 AND raw_credit > 0) WHERE rn = 1
""", f"spine_all{x}")
    cte(f"ends{x}", ends, f"state{x}")
    cte(f"legs{x}", f"SELECT DISTINCT date, short_call, short_put, long_call, long_put FROM spine{x}", f"spine{x}")
    cte(f"paths{x}", f"""
SELECT * FROM (SELECT l.*, q.t, q.cm[l.short_call] + q.pm[l.short_put] - q.cm[l.long_call] - q.pm[l.long_put] AS debit FROM legs{x} l JOIN quotes{x} q USING (date)) WHERE debit IS NOT NULL
""", f"legs{x} quotes{x}")
    reach = [f"p.debit <= s.credit * (1.0 - {tp})" for tp in TP]
    cte(f"races{x}", f"""
SELECT s.decision_datetime, s.strategy, s.date, s.credit, max(p.t) AS lt, arg_max(p.debit, p.t) AS lv_,
  min(p.t) FILTER (p.debit >= 2.0 * s.credit) AS st, arg_min(p.debit, p.t) FILTER (p.debit >= 2.0 * s.credit) AS sv,
  [{", ".join(f"min(p.t) FILTER ({r})" for r in reach)}] AS pts, [{", ".join(f"arg_min(p.debit, p.t) FILTER ({r})" for r in reach)}] AS pvs
FROM spine{x} s JOIN ends{x} USING (date) JOIN paths{x} p USING (date, short_call, short_put, long_call, long_put)
WHERE p.t > s.decision_datetime AND p.t <= z GROUP BY s.decision_datetime, s.strategy, s.date, s.credit
""", f"spine{x} ends{x} paths{x}")
    cte(f"touched{x}", f"""
SELECT *, st IS NOT NULL AND (pt IS NULL OR st <= pt) AS hit_sl, pt IS NOT NULL AND (st IS NULL OR pt < st) AS hit_tp
FROM (SELECT * EXCLUDE (pts, pvs), unnest([{", ".join(TP)}]) AS tp, unnest(pts) AS pt, unnest(pvs) AS pv FROM races{x})
""", f"races{x}")
    cte(f"outcomes{x}", f"""
SELECT decision_datetime, strategy, date, credit, tp, lt,
  CAST(CASE WHEN hit_sl THEN 0 WHEN hit_tp THEN 1 WHEN lv_ < credit THEN 1 ELSE 0 END AS BIGINT) AS target,
  CASE WHEN hit_sl THEN 'sl' WHEN hit_tp THEN 'tp' WHEN lv_ < credit THEN 'close_win' ELSE 'close_loss' END AS exit_reason,
  CASE WHEN hit_sl THEN st WHEN hit_tp THEN pt ELSE lt END AS exit_time,
  round(CASE WHEN hit_sl THEN sv WHEN hit_tp THEN pv ELSE lv_ END, 4) AS exit_debit,
  round(credit - CASE WHEN hit_sl THEN sv WHEN hit_tp THEN pv ELSE lv_ END, 4) AS pnl
FROM touched{x}
""", f"touched{x}")


TP = ["0.1", "0.15", "0.2", "0.25", "0.3", "0.35", "0.4", "0.45", "0.5"]
_race_ctes("", "hour(decision_datetime) BETWEEN 10 AND 14 AND spx_close IS NOT NULL", True, """
SELECT date, coalesce(max(decision_datetime) FILTER (hour(decision_datetime) = 15 AND minute(decision_datetime) = 0), max(decision_datetime)) AS z FROM state GROUP BY 1
""")


@query("spine", "L2 J14 J15 P13 O1 O4 F17 W25", "SELECT * FROM spine", uses="spine", num="spx_prev_min_close sc_delta sp_delta sc_iv sp_iv credit", day="date", time="decision_datetime")
def _(spark, d):
    return build_spine(state(spark, d))


def outcomes(spark, d):
    s = settle(state(spark, d), "state")
    return build_outcomes(settle(build_spine(s), "spine"), s, long_form=True).where(F.col("target").isNotNull())


@query("outcomes", "L3 J20 J19 A39", "SELECT * EXCLUDE (lt) FROM outcomes", uses="outcomes", num="credit exit_debit pnl tp", day="date", time="decision_datetime exit_time")
def _(spark, d):
    return outcomes(spark, d).select("decision_datetime", "strategy", "date", "credit", "tp", "target", "exit_reason", "exit_time", "exit_debit", "pnl")


_sides1 = ", ".join(
    f"max(CASE WHEN \"right\" = '{s}' THEN {c} END) AS {s}_{o}"
    for s in ("call", "put") for c, o in (("bid", "bid_close"), ("(bid + ask) / 2.0", "mid_close"), ("delta", "delta"), ("implied_vol", "implied_vol"))
)
cte("state1", f"SELECT date, timestamp AS decision_datetime, strike, median(underlying_price) AS spx_close, {_sides1} FROM chain GROUP BY 1, 2, 3", "chain")
_race_ctes("1", "hour(decision_datetime) * 60 + minute(decision_datetime) BETWEEN 570 AND 899", False, "SELECT DISTINCT date, date + INTERVAL 15 HOUR AS z FROM state1")


@query("entry_labels", "L4 L3", """
SELECT decision_datetime, strategy, tp, target, exit_reason, exit_time, exit_debit, pnl, date_diff('minute', decision_datetime, lt) AS time_to_close_min FROM outcomes1
""", uses="outcomes1", num="tp exit_debit pnl", time="decision_datetime exit_time")
def _(spark, d):
    from strikeline.plans.labels import build_entry_labels

    x = build_entry_labels(base.chain(spark, d), long_form=True)
    return x.select("decision_datetime", "strategy", "tp", "target", "exit_reason", "exit_time", "exit_debit", "pnl", "time_to_close_min")


@query("outcome_baseline", "A41 A23", """
SELECT strategy, tp, count(*) AS n, avg(target) AS win_rate, avg(pnl) AS ev, count(*) FILTER (exit_reason = 'sl') AS n_sl, count(*) FILTER (exit_reason = 'tp') AS n_tp,
  count(*) FILTER (exit_reason = 'close_win') AS n_close_win, count(*) FILTER (exit_reason = 'close_loss') AS n_close_loss,
  median(date_diff('minute', decision_datetime, exit_time)) AS median_minutes
FROM outcomes GROUP BY 1, 2
""", uses="outcomes", num="tp win_rate ev median_minutes")
def _(spark, d):
    from strikeline.operators.radix import exact_quantiles

    o = outcomes(spark, d)
    mins = F.timestamp_diff("MINUTE", F.col("decision_datetime"), F.col("exit_time"))
    o = o.withColumn("minutes", mins)
    table = o.groupBy("strategy", "tp").agg(
        F.count(F.lit(1)).alias("n"), F.avg("target").alias("win_rate"), F.avg("pnl").alias("ev"),
        *[F.count_if(F.col("exit_reason") == r).alias(f"n_{r}") for r in ("sl", "tp", "close_win", "close_loss")],
    )
    med = exact_quantiles(o, ["strategy", "tp"], "minutes", [0.5]).select("strategy", "tp", F.col("quantiles")[0].alias("median_minutes"))
    return table.join(med, ["strategy", "tp"])


def training_inputs(spark, d):
    """All inputs of a training table, derived from the driver tables."""
    from strikeline.operators import indicators as ind
    from strikeline.operators.runs import run_of_state
    from strikeline.plans import daily as dl
    from strikeline.plans.training import Inputs

    s = settle(state(spark, d), "state")
    bars = base.index_bars(spark, d)
    ts = base.term_structure(spark, d)
    # daily closes are moved onto the session calendar so that lags have dates to meet
    closes = base.closes(spark, d)
    first = closes.agg(F.min("date")).scalar()
    shifted = settle(closes.withColumn("date", F.date_add(F.lit("2022-06-01").cast("date"), F.datediff("date", first))), "closes")
    w = ind.by([], "date")
    regime = run_of_state(
        shifted.select("date", (F.col("vix") > 20).cast("long").alias("regime_state"), (F.col("vix") / 40.0).alias("regime_prob_highvol")), "regime_state", w, "regime_duration", "regime_switch"
    )
    events = shifted.where(F.col("fomc") == 1).select("date", F.lit("FOMC").alias("event")).unionByName(
        shifted.where(F.col("vix") > 24).select("date", F.lit("CPI").alias("event"))
    )
    cross = ind.cross_asset(shifted.select("date", "spy", "qqq", "iwm", "eem", "tlt"), []).drop("spy", "qqq", "iwm", "eem", "tlt")
    macro = ind.macro(shifted.select("date", *[c for c in ind.MACRO if c != "yield_spread_2y10y"]), [])
    oi, term = dl.oi_daily(base.open_interest(spark, d)), dl.term_structure_daily(ts)
    return Inputs(
        spine=settle(build_spine(s), "spine"), state=s, bars=bars["spx"], vix_bars=bars["vix"], vix1d_bars=bars["vix1d"],
        daily_specs=[(oi, "same_day"), (term, "t1"), (cross, "t1"), (macro, "t2")], term_structure=ts,
        option_volume=base.open_interest(spark, d), volume_column="open_interest", closes=shifted, regime=regime, events=events, event_names=("CPI", "FOMC"),
    )


cte("mday", "SELECT date, arg_max(close, datetime) AS session_close, arg_min(open, datetime) AS day_open FROM (SELECT CAST(datetime AS DATE) AS date, datetime, spot - 0.5 AS open, spot AS close FROM spots) GROUP BY 1", "spots")
cte("oiday_", """
SELECT date, sum(c) AS total_call_oi, arg_max(strike, (c + p, -strike)) AS max_pain_strike FROM (
  SELECT date, strike, coalesce(sum(open_interest) FILTER ("right" = 'call'), 0) AS c, coalesce(sum(open_interest) FILTER ("right" = 'put'), 0) AS p FROM oi GROUP BY 1, 2) GROUP BY 1
""", "oi")
cte("surf_", """
SELECT timestamp, CASE WHEN min(abs(delta - 0.5)) FILTER ("right" = 'call') <= 0.15 THEN arg_min(implied_vol, (abs(delta - 0.5), strike)) FILTER ("right" = 'call') END AS ac,
  CASE WHEN min(abs(delta + 0.5)) FILTER ("right" = 'put') <= 0.15 THEN arg_min(implied_vol, (abs(delta + 0.5), strike)) FILTER ("right" = 'put') END AS ap FROM chain WHERE implied_vol > 0.01 AND implied_vol < 5.0 GROUP BY 1
""", "chain")


@query("training_table", "P5 P9 J2 J3 J4 I11 I12 I15 I16 A21 F1 F2 P10", """
SELECT s.decision_datetime, s.strategy, s.credit, hour(s.decision_datetime) * 60 + minute(s.decision_datetime) - 570 AS minutes_since_open, CAST(s.strategy = 'IC_20d_25w' AS BIGINT) AS strat_ic20, CAST(isodow(s.date) - 1 AS BIGINT) AS day_of_week,
  o.total_call_oi AS daily_prior_total_call_oi, (b.close - lag5) / lag5 * 100 AS intraday_spx_ret_5m, (g.day_open - g.prev) / g.prev * 100 AS gap_pct, round_even(s.spx_prev_min_close / 5, 0) * 5 AS spx_intraday_atm_strike,
  coalesce((u.ac + u.ap) / 2.0, u.ac, u.ap) AS intraday_atm_iv, s.spx_prev_min_close - o.max_pain_strike AS intraday_max_pain_distance_pts
FROM spine s LEFT JOIN oiday_ o USING (date)
LEFT JOIN (SELECT datetime, spot AS close, lag(spot, 5) OVER (PARTITION BY date ORDER BY datetime) AS lag5 FROM spots) b ON b.datetime + INTERVAL 1 MINUTE = s.decision_datetime
LEFT JOIN (SELECT *, lag(session_close) OVER (ORDER BY date) AS prev FROM mday) g USING (date)
LEFT JOIN surf_ u ON u.timestamp + INTERVAL 1 MINUTE = s.decision_datetime
""", uses="spine mday oiday_ surf_", num="credit daily_prior_total_call_oi intraday_spx_ret_5m gap_pct spx_intraday_atm_strike intraday_atm_iv intraday_max_pain_distance_pts", time="decision_datetime")
def _(spark, d):
    from strikeline.plans.training import build_training_table

    t = settle(build_training_table(training_inputs(spark, d)), "training")
    return t.select(
        "decision_datetime", "strategy", "credit", "minutes_since_open", F.col("strat_IC_20d_25w").alias("strat_ic20"), "day_of_week", "daily_prior_total_call_oi", "intraday_spx_ret_5m",
        F.col("daily_spx_open_vs_prev_close_gap_pct").alias("gap_pct"), "spx_intraday_atm_strike", "intraday_atm_iv", "intraday_max_pain_distance_pts",
    )
