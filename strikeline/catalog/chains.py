"""Option-chain aggregations, exposure, surface and pricing."""

from __future__ import annotations

from pyspark.sql import functions as F

from strikeline.catalog import base
from strikeline.catalog.base import cte, query, table
from strikeline.functions import bsm
from strikeline.functions.scalar import div_pos, to_step
from strikeline.operators import chain as ch
from strikeline.operators import indicators as ind


@query("pivot_contract_sides", "A4", """
SELECT timestamp, strike, max(bid) FILTER ("right" = 'call') AS call_bid, max(mid) FILTER ("right" = 'call') AS call_mid, max(bid) FILTER ("right" = 'put') AS put_bid, max(mid) FILTER ("right" = 'put') AS put_mid FROM chain GROUP BY 1, 2
""", uses="chain", num="strike call_bid call_mid put_bid put_mid", time="timestamp")
def _(spark, d):
    return ch.pivot_sides(base.chain(spark, d), ["timestamp", "strike"], "right", ["bid", "mid"])


@query("oi_pivot_by_side", "A5", """
SELECT date, sum(open_interest) FILTER ("right" = 'call') AS "call", sum(open_interest) FILTER ("right" = 'put') AS put FROM oi GROUP BY 1
""", uses="oi", num='"call" put'.replace('"call"', "call"), day="date")
def _(spark, d):
    return base.open_interest(spark, d).groupBy("date").pivot("right", ["call", "put"]).agg(F.sum("open_interest"))


@query("event_flag_pivot", "A6 A7", """
SELECT date, CAST(max(CASE WHEN event = 'CPI' THEN 1 ELSE 0 END) AS BIGINT) AS "CPI", CAST(max(CASE WHEN event = 'FOMC' THEN 1 ELSE 0 END) AS BIGINT) AS "FOMC", count(*) AS n, string_agg(event, ',' ORDER BY event) AS events FROM cal GROUP BY 1
""", uses="cal", day="date")
def _(spark, d):
    c = base.calendar_events(spark, d)
    p = c.groupBy("date").pivot("event", ["CPI", "FOMC"]).agg(F.max(F.lit(1).cast("long")))
    n = c.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("event")), ",").alias("events"))
    return p.fillna(0, ["CPI", "FOMC"]).join(n, "date")


cte("oiday", """
SELECT *, CASE WHEN total_call_oi > 0 THEN total_put_oi / total_call_oi END AS pc_oi_ratio, sq / ((total_call_oi + total_put_oi) * (total_call_oi + total_put_oi)) AS oi_concentration FROM (
SELECT date, sum(c) AS total_call_oi, sum(p) AS total_put_oi, sum((c + p) * (c + p)) AS sq, arg_max(strike, (c + p, -strike)) AS max_pain_strike FROM (
  SELECT date, strike, coalesce(sum(open_interest) FILTER ("right" = 'call'), 0) AS c, coalesce(sum(open_interest) FILTER ("right" = 'put'), 0) AS p FROM oi GROUP BY 1, 2) GROUP BY 1)
""", "oi")


@query("open_interest_daily", "A8 A9 A10 I25", "SELECT date, total_call_oi, total_put_oi, pc_oi_ratio, oi_concentration, max_pain_strike FROM oiday", uses="oiday",
       num="total_call_oi total_put_oi pc_oi_ratio oi_concentration max_pain_strike", day="date")
def _(spark, d):
    return ch.open_interest_daily(base.open_interest(spark, d))


@query("supplier_concentration", "A9", """
SELECT m, sum(v * v) / (sum(v) * sum(v)) AS concentration FROM (SELECT strftime(l_shipdate, '%Y-%m') AS m, l_suppkey, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2) GROUP BY 1
""", num="concentration", digits=8)
def _(spark, d):
    x = table(spark, d, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM").alias("m"), "l_suppkey", "l_extendedprice")
    return ch.concentration(x, ["m"], "l_suppkey", "l_extendedprice")


def _pain(legacy: bool) -> str:
    c, p = ("greatest(b.strike - a.strike, 0)", "greatest(a.strike - b.strike, 0)") if legacy else ("greatest(a.strike - b.strike, 0)", "greatest(b.strike - a.strike, 0)")
    return f"""
SELECT date, arg_min(k, (payout, k)) AS max_pain_strike, min(payout) AS min_payout FROM (
  SELECT a.date, a.strike AS k, sum(CASE WHEN b."right" = 'call' THEN b.open_interest * {c} ELSE b.open_interest * {p} END) AS payout
  FROM (SELECT DISTINCT date, strike FROM oi) a JOIN oi b USING (date) GROUP BY 1, 2) GROUP BY 1
"""


@query("max_pain_by_payout", "A11", _pain(False), uses="oi", num="max_pain_strike min_payout", day="date")
def _(spark, d):
    return ch.max_pain(base.open_interest(spark, d), ["date"])


@query("max_pain_legacy_payout", "A11", _pain(True), uses="oi", num="max_pain_strike min_payout", day="date")
def _(spark, d):
    return ch.max_pain(base.open_interest(spark, d), ["date"], legacy=True)


cte("gex", """
SELECT *, CASE WHEN "right" = 'call' THEN 1.0 ELSE -1.0 END * gamma * open_interest * 100.0 * spot * spot * 0.01 AS gex FROM contracts WHERE gamma IS NOT NULL AND open_interest > 0 AND spot > 0
""", "contracts")
cte("gexk", "SELECT date, strike, sum(gex) AS v FROM gex GROUP BY 1, 2", "gex")
cte("zero", """
SELECT date, arg_min(pk + (strike - pk) * (-p) / (c - p), strike) AS zero_gamma_level FROM (
  SELECT *, lag(c) OVER (PARTITION BY date ORDER BY strike) AS p, lag(strike) OVER (PARTITION BY date ORDER BY strike) AS pk FROM (
    SELECT date, strike, sum(v) OVER (PARTITION BY date ORDER BY strike) AS c FROM gexk)) WHERE p IS NOT NULL AND sign(p) <> sign(c) AND p <> 0 GROUP BY 1
""", "gexk")


@query("gamma_exposure_daily", "A12 A13 A14 W15 J5", """
SELECT date, net_gex, net_gex / s AS net_gex_normalized, cg / (cg + pg) AS gex_imbalance, zero_gamma_level, call_wall, put_wall, (call_wall - s) / s * 100 AS call_wall_distance, (s - put_wall) / s * 100 AS put_wall_distance
FROM (SELECT date, max(spot) AS s, sum(gex) AS net_gex, coalesce(sum(gex) FILTER ("right" = 'call'), 0) AS cg, coalesce(sum(abs(gex)) FILTER ("right" = 'put'), 0) AS pg,
  arg_max(strike, (gex, -strike)) FILTER ("right" = 'call') AS call_wall, arg_max(strike, (abs(gex), -strike)) FILTER ("right" = 'put') AS put_wall FROM gex GROUP BY 1) LEFT JOIN zero USING (date)
""", uses="gex zero", num="net_gex net_gex_normalized gex_imbalance zero_gamma_level call_wall put_wall call_wall_distance put_wall_distance", day="date", digits=4)
def _(spark, d):
    return ch.gex_daily(base.contracts(spark, d), ["date"])


@query("gamma_exposure_profile", "A15", """
SELECT date, strike, coalesce(sum(gex) FILTER ("right" = 'call'), 0) AS call_gex, coalesce(sum(gex) FILTER ("right" = 'put'), 0) AS put_gex, sum(gex) AS net_gex FROM gex GROUP BY 1, 2
""", uses="gex", num="strike call_gex put_gex net_gex", day="date", digits=4)
def _(spark, d):
    return ch.gex_profile(base.contracts(spark, d), ["date"])


@query("zero_crossing_of_signed_revenue", "A14 W15", """
SELECT b, arg_min(pk + (k - pk) * (-p) / (c - p), k) AS zero_level FROM (SELECT *, lag(c) OVER (PARTITION BY b ORDER BY k) AS p, lag(k) OVER (PARTITION BY b ORDER BY k) AS pk FROM (
  SELECT b, k, sum(v) OVER (PARTITION BY b ORDER BY k) AS c FROM (SELECT p_brand AS b, CAST(p_size AS DOUBLE) AS k, sum(CASE WHEN l_returnflag = 'R' THEN -2.0 ELSE 1.0 END * l_extendedprice) AS v
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2))) WHERE p IS NOT NULL AND sign(p) <> sign(c) AND p <> 0 GROUP BY 1
UNION ALL SELECT DISTINCT p_brand, NULL FROM part WHERE p_brand NOT IN (SELECT b FROM (SELECT *, lag(c) OVER (PARTITION BY b ORDER BY k) AS p FROM (
  SELECT b, k, sum(v) OVER (PARTITION BY b ORDER BY k) AS c FROM (SELECT p_brand AS b, p_size AS k, sum(CASE WHEN l_returnflag = 'R' THEN -2.0 ELSE 1.0 END * l_extendedprice) AS v
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2))) WHERE p IS NOT NULL AND sign(p) <> sign(c) AND p <> 0)
  AND p_brand IN (SELECT p_brand FROM lineitem JOIN part ON l_partkey = p_partkey)
""", num="zero_level", digits=4)
def _(spark, d):
    x = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    v = x.groupBy(F.col("p_brand").alias("b"), F.col("p_size").cast("double").alias("k")).agg(F.sum(F.when(F.col("l_returnflag") == "R", -2.0).otherwise(1.0) * F.col("l_extendedprice")).alias("v"))
    return ch.zero_crossing(v, ["b"], "k", "v")


cte("vc", """
SELECT date, "right", spot AS s, sg * open_interest * 100.0 * (-pdf * d2 / iv) AS vanna, sg * open_interest * 100.0 * (pdf * (2.0 * 0.05 * T - d2 * iv * sqrt(T)) / (2.0 * T * iv * sqrt(T))) AS charm
FROM (SELECT *, d1 - iv * sqrt(T) AS d2, exp(-d1 * d1 / 2.0) / sqrt(2.0 * pi()) AS pdf, CASE WHEN "right" = 'call' THEN 1.0 ELSE -1.0 END AS sg FROM (
  SELECT *, (ln(spot / strike) + (0.05 + iv * iv / 2.0) * T) / (iv * sqrt(T)) AS d1 FROM (SELECT *, 0.5 / 365.0 AS T FROM contracts WHERE open_interest > 0 AND iv > 0.01 AND iv < 5.0)))
""", "contracts")


@query("vanna_charm_exposure", "A16 F9 F10 J5", """
SELECT date, nv AS net_vanna_exposure, nv / s AS net_vanna_normalized, cv / (cv + pv) AS vanna_imbalance, nc AS net_charm_exposure, nc / s AS net_charm_normalized, cc / (cc + pc) AS charm_imbalance, abs(nv) / (abs(nv) + abs(nc)) AS vanna_charm_ratio
FROM (SELECT date, max(s) AS s, sum(vanna) AS nv, sum(charm) AS nc, abs(coalesce(sum(vanna) FILTER ("right" = 'call'), 0)) AS cv, coalesce(sum(abs(vanna)) FILTER ("right" = 'put'), 0) AS pv,
  abs(coalesce(sum(charm) FILTER ("right" = 'call'), 0)) AS cc, coalesce(sum(abs(charm)) FILTER ("right" = 'put'), 0) AS pc FROM vc GROUP BY 1 HAVING count(*) >= 2)
""", uses="vc", num="net_vanna_exposure net_vanna_normalized vanna_imbalance net_charm_exposure net_charm_normalized charm_imbalance vanna_charm_ratio", day="date", digits=4)
def _(spark, d):
    return ch.vanna_charm_daily(base.contracts(spark, d), ["date"])


def _atm(name: str, dte: int) -> str:
    return f"""
SELECT date, coalesce((c + p) / 2.0, c, p) AS {name} FROM (SELECT date, avg(mid) FILTER ("right" = 'call') AS c, avg(mid) FILTER ("right" = 'put') AS p FROM (
  SELECT *, bool_or(strike = atm_strike) OVER (PARTITION BY date) AS has, row_number() OVER (PARTITION BY date ORDER BY abs(strike - spx_close), strike, "right") AS rk FROM ts
  JOIN (SELECT date, arg_min(dte, (abs(dte - {dte}), dte)) AS dte FROM ts GROUP BY 1 HAVING min(abs(dte - {dte})) <= 5) USING (date, dte)) WHERE CASE WHEN has THEN strike = atm_strike ELSE rk <= 2 END GROUP BY 1)
"""


for _n, _t in (("ts_0dte", 0), ("ts_7dte", 7), ("ts_30dte", 30)):
    cte(f"atm_{_n}", _atm(_n, _t), "ts")


@query("atm_straddle_by_tenor", "A17 J18 I24", """
SELECT *, ts_30dte - ts_0dte AS slope_0_30, ts_7dte - ts_0dte AS slope_0_7, ln(ts_7dte / ts_0dte) AS log_slope_0_7 FROM (SELECT DISTINCT date FROM ts)
LEFT JOIN atm_ts_0dte USING (date) LEFT JOIN atm_ts_7dte USING (date) LEFT JOIN atm_ts_30dte USING (date)
""", uses="ts atm_ts_0dte atm_ts_7dte atm_ts_30dte", num="ts_0dte ts_7dte ts_30dte slope_0_30 slope_0_7 log_slope_0_7", day="date", digits=9)
def _(spark, d):
    x = ch.atm_straddle(base.term_structure(spark, d), "date", {"ts_0dte": 0, "ts_7dte": 7, "ts_30dte": 30})
    s = ind.term_slopes("ts_0dte", "ts_7dte", "ts_30dte")
    return x.select("*", s["slope_diff_short_long"].alias("slope_0_30"), s["slope_diff_short_mid"].alias("slope_0_7"), s["slope_log_short_mid"].alias("log_slope_0_7"))


cte("offs", """
SELECT datetime, spot, round_even(spot / 5.0, 0) * 5.0 AS atm FROM spots
""", "spots")
_px = {f"{s}{o}": (f"max(c.mid) FILTER (c.\"right\" = '{s}' AND c.strike = o.atm + {o} AND c.mid > 0)") for s in ("call", "put") for o in (-200, -150, -100, -50, 50, 100, 150, 200, 25, -25)}
cte("wings", "SELECT o.datetime, o.spot, o.atm, " + ", ".join(f"{e} AS \"{n}\"" for n, e in _px.items()) + " FROM offs o JOIN chain c ON c.timestamp = o.datetime GROUP BY 1, 2, 3", "offs chain")


@query("condor_credit_fixed_offsets", "A19 J16", """
SELECT datetime, CASE WHEN "call50" + "put-50" - "call100" - "put-100" > 0 THEN "call50" + "put-50" - "call100" - "put-100" END AS credit_50,
  CASE WHEN "call100" + "put-100" - "call150" - "put-150" > 0 THEN "call100" + "put-100" - "call150" - "put-150" END AS credit_100,
  CASE WHEN "call150" + "put-150" - "call200" - "put-200" > 0 THEN "call150" + "put-150" - "call200" - "put-200" END AS credit_150 FROM wings
""", uses="wings", num="credit_50 credit_100 credit_150", time="datetime")
def _(spark, d):
    c = base.chain(spark, d).withColumn("atm", to_step("underlying_price"))
    st = ch.pivot_sides(c, ["timestamp", "strike", "atm"], "right", ["mid"]).withColumnsRenamed({"call_mid": "call_mid_close", "put_mid": "put_mid_close"})
    out = ch.condor_credit(["timestamp"], st, "atm", 50, 100, "credit_50")
    for short in (100, 150):
        out = out.join(ch.condor_credit(["timestamp"], st, "atm", short, short + 50, f"credit_{short}"), "timestamp")
    return out.withColumnRenamed("timestamp", "datetime")


@query("chain_skew_by_offset", "A20", 'SELECT datetime, "call25" / nullif("put-25", 0) AS skew_25, "call50" / nullif("put-50", 0) AS skew_50, "call100" / nullif("put-100", 0) AS skew_100 FROM wings',
       uses="wings", num="skew_25 skew_50 skew_100", time="datetime")
def _(spark, d):
    c = base.chain(spark, d).withColumn("atm", to_step("underlying_price"))

    def at(side, off):
        return F.max(F.when((F.col("right") == side) & (F.col("strike") == F.col("atm") + off) & (F.col("mid") > 0), F.col("mid")))

    g = c.groupBy("timestamp").agg(*[at("call", o).alias(f"c{o}") for o in (25, 50, 100)], *[at("put", -o).alias(f"p{o}") for o in (25, 50, 100)])
    return g.select(F.col("timestamp").alias("datetime"), *[div_pos(f"c{o}", f"p{o}").alias(f"skew_{o}") for o in (25, 50, 100)])


def _iv(side: str, t: float, tol: float) -> str:
    ok = f"\"right\" = '{side}' AND implied_vol > 0.01 AND implied_vol < 5.0"
    return f"CASE WHEN min(abs(delta - {t})) FILTER ({ok}) <= {tol} THEN arg_min(implied_vol, (abs(delta - {t}), strike)) FILTER ({ok}) END"


cte("surf", f"""
SELECT *, coalesce((ac + ap) / 2.0, ac, ap) AS atm_iv FROM (SELECT timestamp, {_iv('call', 0.5, 0.15)} AS ac, {_iv('put', -0.5, 0.15)} AS ap, {_iv('call', 0.25, 0.1)} AS iv_25d_call, {_iv('put', -0.25, 0.1)} AS iv_25d_put,
  {_iv('call', 0.1, 0.1)} AS iv_10d_call, {_iv('put', -0.1, 0.1)} AS iv_10d_put FROM chain GROUP BY 1)
""", "chain")


@query("iv_surface_snapshot", "A21 J14", """
SELECT timestamp, atm_iv, iv_25d_call, iv_25d_put, iv_10d_call, iv_10d_put, iv_25d_put - iv_25d_call AS skew_25d, iv_10d_put - iv_10d_call AS skew_10d, (iv_25d_put + iv_25d_call) / 2.0 - atm_iv AS iv_smile_curve FROM surf
""", uses="surf", num="atm_iv iv_25d_call iv_25d_put iv_10d_call iv_10d_put skew_25d skew_10d iv_smile_curve", time="timestamp")
def _(spark, d):
    return ch.iv_surface(base.chain(spark, d).withColumnRenamed("implied_vol", "iv"), ["timestamp"])


@query("median_quote_per_strike", "A22", """
SELECT date, strike, "right", median(implied_vol) AS iv, median(delta) AS delta, min(iv_error) AS iv_error FROM chain WHERE hour(timestamp) = 10 GROUP BY 1, 2, 3
""", uses="chain", num="strike iv delta iv_error", day="date")
def _(spark, d):
    c = base.chain(spark, d).where(F.hour("timestamp") == 10)
    # a strike and side has at most one row per minute, so each group holds at most sixty values
    return c.groupBy("date", "strike", "right").agg(F.percentile("implied_vol", 0.5).alias("iv"), F.percentile("delta", 0.5).alias("delta"), F.min("iv_error").alias("iv_error"))


@query("surface_rolling_history", "W5 W7 W11 I17", """
SELECT date, atm_iv, CASE WHEN count(atm_iv) OVER f5 >= 3 THEN avg(atm_iv) OVER f5 END AS atm_iv_5day_mean, CASE WHEN count(atm_iv) OVER f21 >= 10 THEN (atm_iv - avg(atm_iv) OVER f21) / nullif(stddev_samp(atm_iv) OVER f21, 0) END AS atm_iv_zscore_21day,
  CASE WHEN count(skew_25d) OVER f21 >= 10 THEN stddev_samp(skew_25d) OVER f21 END AS skew_25d_21day_std
FROM (SELECT CAST(timestamp AS DATE) AS date, avg(atm_iv) AS atm_iv, avg(iv_25d_put - iv_25d_call) AS skew_25d FROM surf GROUP BY 1) WINDOW f5 AS (ORDER BY date ROWS 4 PRECEDING), f21 AS (ORDER BY date ROWS 20 PRECEDING)
""", uses="surf", num="atm_iv atm_iv_5day_mean atm_iv_zscore_21day skew_25d_21day_std", day="date", digits=5)
def _(spark, d):
    s = ch.iv_surface(base.chain(spark, d).withColumnRenamed("implied_vol", "iv"), ["timestamp"])
    day = s.groupBy(F.col("timestamp").cast("date").alias("date")).agg(F.avg("atm_iv").alias("atm_iv"), F.avg("skew_25d").alias("skew_25d"))
    return ind.surface_history(day, []).select("date", "atm_iv", "atm_iv_5day_mean", "atm_iv_zscore_21day", "skew_25d_21day_std")


@query("expiry_payoff_label", "A18 L5", """
SELECT l_orderkey, l_linenumber, CASE WHEN cr > 0 THEN round(cr, 2) END AS ic_credit, CASE WHEN cr > 0 THEN round(pnl, 2) END AS ic_pnl_per_share, CASE WHEN cr > 0 THEN CAST(pnl > 0 AS BIGINT) END AS ic_profitable, CASE WHEN cr > 0 THEN CAST(pnl / cr * 100 >= 25 AS BIGINT) END AS ic_tp25_hit
FROM (SELECT *, greatest(cr - (greatest(0, c - o - 50) + greatest(0, o - 50 - c) - greatest(0, c - o - 100) - greatest(0, o - 100 - c)), cr - 50) AS pnl FROM (
  SELECT l_orderkey, l_linenumber, 5000.0 + 0.37 AS o, 5000.0 + 0.37 + (l_extendedprice - 40000.0) / 397.31 AS c, l_quantity + 13.77 + l_quantity * 0.3137193 - l_discount * 211.3713 - 7.0 - l_tax * 97.1731 AS cr FROM lineitem))
""", num="ic_credit ic_pnl_per_share")
def _(spark, d):
    x = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.lit(5000.0 + 0.37).alias("o"), (F.lit(5000.0 + 0.37) + (F.col("l_extendedprice") - 40000.0) / 397.31).alias("c"),
        (F.col("l_quantity") + 13.77).alias("sc"), (F.col("l_quantity") * 0.3137193).alias("sp"), (F.col("l_discount") * 211.3713).alias("lc"), (7.0 + F.col("l_tax") * 97.1731).alias("lp"),
    )
    p = ch.expiry_payoff(x, "o", "c", {"short_call": "sc", "short_put": "sp", "long_call": "lc", "long_put": "lp"}, 50.0, 100.0)
    return x.select("l_orderkey", "l_linenumber", *[p[c].alias(c) for c in ("ic_credit", "ic_pnl_per_share", "ic_profitable", "ic_tp25_hit")])


def _ncdf(x: str) -> str:
    k = f"(1.0 / (1.0 + {bsm.CDF_P} * abs({x})))"
    poly = "0.0"
    for b in reversed(bsm.CDF_B):
        poly = f"(({poly} + ({b})) * {k})"
    tail = f"(exp(-({x}) * ({x}) / 2.0) / sqrt(2.0 * pi()) * {poly})"
    return f"(CASE WHEN {x} >= 0 THEN 1.0 - {tail} ELSE {tail} END)"


cte("bsin", """
SELECT *, d1 - iv * sqrt(T) AS d2, exp(-d1 * d1 / 2.0) / sqrt(2.0 * pi()) AS pdf FROM (SELECT *, (ln(spot / strike) + (0.05 + iv * iv / 2.0) * T) / (iv * sqrt(T)) AS d1 FROM (
  SELECT date, strike, "right", spot, iv, 7.0 / 365.0 AS T FROM contracts))
""", "contracts")


@query("black_scholes_greeks", "F8 F11 F15", f"""
SELECT date, strike, "right", CASE WHEN "right" = 'call' THEN spot * {_ncdf('d1')} - strike * exp(-0.05 * T) * {_ncdf('d2')} ELSE strike * exp(-0.05 * T) * {_ncdf('(-d2)')} - spot * {_ncdf('(-d1)')} END AS price,
  CASE WHEN "right" = 'call' THEN {_ncdf('d1')} ELSE -{_ncdf('(-d1)')} END AS delta, pdf / (spot * iv * sqrt(T)) AS gamma, spot * pdf * sqrt(T) / 100.0 AS vega,
  (-spot * pdf * iv / (2.0 * sqrt(T)) + CASE WHEN "right" = 'call' THEN -0.05 * strike * exp(-0.05 * T) * {_ncdf('d2')} ELSE 0.05 * strike * exp(-0.05 * T) * {_ncdf('(-d2)')} END) / 252.0 AS theta
FROM bsin
""", uses="bsin", num="strike price delta gamma vega theta", day="date")
def _(spark, d):
    x = base.contracts(spark, d)
    call, T, r = F.col("right") == "call", F.lit(7.0 / 365.0), F.lit(0.05)
    g = bsm.bs_greeks("spot", "strike", T, r, "iv", call)
    return x.select("date", "strike", "right", bsm.bs_price("spot", "strike", T, r, "iv", call).alias("price"), *[g[n].alias(n) for n in ("delta", "gamma", "vega", "theta")])


@query("implied_vol_round_trip", "F12 F8", """
SELECT date, strike, "right", CASE WHEN price > greatest(CASE WHEN "right" = 'call' THEN spot - strike ELSE strike - spot END, 0) + 0.01 THEN iv END AS iv FROM (
  SELECT *, CASE WHEN "right" = 'call' THEN spot * {} - strike * exp(-0.05 * T) * {} ELSE strike * exp(-0.05 * T) * {} - spot * {} END AS price FROM bsin)
""".format(_ncdf("d1"), _ncdf("d2"), _ncdf("(-d2)"), _ncdf("(-d1)")), uses="bsin", num="strike iv", digits=4, day="date")
def _(spark, d):
    x = base.contracts(spark, d)
    call, T, r = F.col("right") == "call", F.lit(7.0 / 365.0), F.lit(0.05)
    p = x.withColumn("price", bsm.bs_price("spot", "strike", T, r, "iv", call))
    return p.select("date", "strike", "right", bsm.implied_vol("price", "spot", "strike", T, r, call).alias("iv"))


def _price(vol: str) -> str:
    d1 = f"((ln(s / k) + (0.05 + ({vol}) * ({vol}) / 2) * t) / (({vol}) * sqrt(t)))"
    d2 = f"({d1} - ({vol}) * sqrt(t))"
    return f"(CASE WHEN call THEN s * {_ncdf(d1)} - k * exp(-0.05 * t) * {_ncdf(d2)} ELSE k * exp(-0.05 * t) * {_ncdf('(-' + d2 + ')')} - s * {_ncdf('(-' + d1 + ')')} END)"


_STEPS = ",\n".join(f"b{i} AS MATERIALIZED (SELECT * EXCLUDE (lo, hi, m), CASE WHEN {_price('m')} < p THEN m ELSE lo END AS lo, CASE WHEN {_price('m')} < p THEN hi ELSE m END AS hi FROM (SELECT *, (lo + hi) / 2 AS m FROM b{i - 1}))" for i in range(1, 31))


@query("term_structure_iv", "F13 I24", f"""
WITH pick AS (SELECT date, n, "right" = 'call' AS call, max(spx_close) AS s, arg_min({{'d': dte, 'k': strike, 'p': mid}}, (abs(moneyness), dte, strike, mid)) AS x
  FROM ts, (SELECT unnest([7, 14]) AS n) WHERE dte BETWEEN n - 3 AND n + 3 AND moneyness IS NOT NULL GROUP BY ALL),
b0 AS (SELECT date, n, call, s, x.k AS k, x.p AS p, greatest(x.d / 365.0, 1.0 / 8760.0) AS t, 0.01 AS lo, 5.0 AS hi FROM pick WHERE x.p > 0 AND x.p > greatest(CASE WHEN call THEN s - x.k ELSE x.k - s END, 0) + 0.01),
{_STEPS},
iv AS (SELECT date, n, avg((lo + hi) / 2) FILTER (lo > 0.010001 AND hi < 2.99999) AS v FROM b30 GROUP BY 1, 2),
w AS (SELECT date, max(v) FILTER (n = 7) AS a, max(v) FILTER (n = 14) AS b FROM iv GROUP BY 1)
SELECT date, a AS ts_iv_7dte, b AS ts_iv_14dte, a / nullif(b, 0) AS slope_ratio, CAST(a > b AS DOUBLE) AS inverted FROM (SELECT DISTINCT date FROM ts) LEFT JOIN w USING (date)
""", uses="ts", num="ts_iv_7dte ts_iv_14dte slope_ratio", digits=4, day="date")
def _(spark, d):
    t = base.term_structure(spark, d)
    out = t.select("date").distinct()
    from strikeline.plans.daily import tenor_iv

    x = tenor_iv(t, ["date"], {"ts_iv_7dte": 7, "ts_iv_14dte": 14})
    s = ind.term_slopes("ts_iv_7dte", "ts_iv_14dte", "ts_iv_14dte")
    return out.join(x, "date", "left").select("date", "ts_iv_7dte", "ts_iv_14dte", s["slope_ratio"].alias("slope_ratio"), s["inverted"].alias("inverted"))


@query("strike_grid_generation", "O11 F7", """
SELECT datetime, atm_strike, count(*) AS n, min(strike) AS lo, max(strike) AS hi FROM (SELECT datetime, round_even(spot / 5, 0) * 5 AS atm_strike, unnest(range(-50, 51)) * 5 + round_even(spot / 5, 0) * 5 AS strike FROM spots), (SELECT unnest(['call', 'put']) AS "right") GROUP BY 1, 2
""", uses="spots", num="atm_strike lo hi", time="datetime")
def _(spark, d):
    g = ch.strike_grid(base.spots(spark, d).select("datetime", "spot"), "spot")
    return g.groupBy("datetime", "atm_strike").agg(F.count(F.lit(1)).alias("n"), F.min("strike").alias("lo"), F.max("strike").alias("hi"))


@query("max_pain_distance", "I25 F14", """
SELECT date, spot - max_pain_strike AS pts, (spot - max_pain_strike) / spot * 100 AS pct FROM oiday JOIN dspot USING (date)
""", uses="oiday dspot", num="pts pct", day="date")
def _(spark, d):
    x = ch.open_interest_daily(base.open_interest(spark, d)).join(base.day_spot(spark, d), "date")
    gap = F.col("spot") - F.col("max_pain_strike")
    return x.select("date", gap.alias("pts"), (div_pos(gap, "spot") * 100).alias("pct"))


@query("lognormal_strike_estimate", "F20", """
SELECT date, short_put, short_call, width, short_put - width AS long_put, short_call + width AS long_call, width * ratio AS credit FROM (
  SELECT date, least(round_even(spot * exp(-1.036 * vix / 100 * sqrt(1.0 / 252)) / 5, 0) * 5, floor(spot) - 10) AS short_put, greatest(round_even(spot * exp(1.036 * vix / 100 * sqrt(1.0 / 252)) / 5, 0) * 5, floor(spot) + 10) AS short_call,
    greatest(50.0, round_even(spot * 0.01 / 25, 0) * 25) AS width, greatest(0.08, least(0.2, 0.1 + (vix - 15) / 100)) AS ratio FROM (SELECT date, spot, 10 + (spot - 5000) / 2 AS vix FROM dspot))
""", uses="dspot", num="short_put short_call width long_put long_call credit", day="date")
def _(spark, d):
    x = base.day_spot(spark, d).withColumn("vix", 10 + (F.col("spot") - 5000) / 2)
    s = bsm.lognormal_strikes("spot", "vix")
    y = x.select("date", "vix", s["short_put"].alias("short_put"), s["short_call"].alias("short_call"), s["long_put"].alias("long_put"), s["long_call"].alias("long_call"), s["spread_width"].alias("width"))
    return y.select("date", "short_put", "short_call", "width", "long_put", "long_call", bsm.estimated_credit("width", "vix").alias("credit"))


@query("condor_close_pnl", "F20", """
SELECT o_orderkey, CASE WHEN c BETWEEN 4950 AND 5050 THEN 3.5 WHEN c <= 4925 OR c >= 5075 THEN 3.5 - 25 ELSE 3.5 - CASE WHEN c < 4950 THEN 4950 - c ELSE c - 5050 END END AS pnl FROM (SELECT o_orderkey, 4900 + o_totalprice / 2500 AS c FROM orders)
""", num="pnl")
def _(spark, d):
    x = table(spark, d, "orders").select("o_orderkey", (4900 + F.col("o_totalprice") / 2500).alias("c"))
    L = F.lit
    return x.select("o_orderkey", bsm.close_pnl("c", L(4950.0), L(5050.0), L(4925.0), L(5075.0), L(25.0), L(3.5)).alias("pnl"))


@query("adaptive_exit_rules", "F23", """
SELECT l_orderkey, l_linenumber, 2.0 * (2.5 * pl + 2.0 * pm + 1.5 * ph) * greatest(0.8, least(1.2, 1.0 / atr)) AS stop, CASE WHEN m > 180 THEN 0.25 WHEN m > 60 THEN 0.25 - 0.10 * ((180 - m) / 120.0) ELSE 0.15 - 0.10 * ((60 - m) / 60.0) END AS take,
  CAST(l_discount * 4 > 0.25 OR l_tax * 4 > 0.25 AS BIGINT) AS emergency, 0.40 * pl + 0.30 * pm + 0.20 * ph AS activate_pct
FROM (SELECT *, l_discount AS pl, l_tax AS pm, 1 - l_discount - l_tax AS ph, l_quantity / 25 AS atr, l_quantity * 7 AS m FROM lineitem)
""", num="stop take activate_pct")
def _(spark, d):
    x = table(spark, d, "lineitem").withColumns({"pl": F.col("l_discount"), "pm": F.col("l_tax"), "ph": 1 - F.col("l_discount") - F.col("l_tax"), "m": F.col("l_quantity") * 7})
    return x.select(
        "l_orderkey", "l_linenumber", bsm.adaptive_stop(F.lit(2.0), F.col("l_quantity"), F.lit(25.0), "pl", "pm", "ph").alias("stop"), bsm.decaying_target(0.25, "m").alias("take"),
        bsm.delta_emergency(F.col("l_discount") * 4, F.col("l_tax") * 4).cast("long").alias("emergency"), bsm.adaptive_ratchet("pl", "pm", "ph")["activate_pct"].alias("activate_pct"),
    )
