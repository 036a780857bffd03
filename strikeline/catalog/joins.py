"""Lagged, as-of, nearest-match, interval and comparison joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from strikeline.catalog import base
from strikeline.catalog.base import cte, query, table
from strikeline.operators.asof import asof_join, lookup_interval
from strikeline.operators.audit import parity
from strikeline.operators.barrier import first_touch, ratchet_exit, ratchet_tiers
from strikeline.operators.calendar import business_days_between, days_to_next, earnings_flags, event_flags, near_event
from strikeline.operators.lagjoin import join_daily
from strikeline.operators.nearest import closest_bucket, first_available, nearest_in_band, nearest_per_target
from strikeline.operators.slicing import time_width


def order_days(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(F.sum("o_totalprice").alias("total"), F.count(F.lit(1)).alias("orders"))


def ship_days(spark, d, name):
    return table(spark, d, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("date")).agg(F.sum("l_quantity").alias(name), F.max("l_discount").alias("top_discount"))


@query("lagged_daily_joins", "J2 J3 J7", """
WITH o AS (SELECT CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) AS total, count(*) AS orders FROM orders GROUP BY 1),
l AS (SELECT CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS qty, max(l_discount) AS top_discount FROM lineitem GROUP BY 1),
c AS (SELECT date, lead(date, 1) OVER (ORDER BY date) AS e1, lead(date, 2) OVER (ORDER BY date) AS e2 FROM o)
SELECT o.date, o.total, o.orders, a.qty AS qty_same, b.qty AS qty_t1, b.top_discount, t.qty AS qty_t2 FROM o
LEFT JOIN l a ON a.date = o.date
LEFT JOIN (SELECT e1, l.* FROM l JOIN c USING (date) WHERE e1 IS NOT NULL) b ON b.e1 = o.date
LEFT JOIN (SELECT e2, l.* FROM l JOIN c USING (date) WHERE e2 IS NOT NULL) t ON t.e2 = o.date
""", num="total qty_same qty_t1 top_discount qty_t2", day="date", digits=2)
def _(spark, d):
    same = ship_days(spark, d, "qty_same").drop("top_discount")
    return join_daily(order_days(spark, d), [(same, "same_day"), (ship_days(spark, d, "qty_t1"), "t1"), (ship_days(spark, d, "qty_t2"), "t2")])


@query("inner_three_way_daily_join", "J7", """
WITH o AS (SELECT CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) AS total, count(*) AS orders FROM orders GROUP BY 1),
l AS (SELECT CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS qty FROM lineitem GROUP BY 1),
e AS (SELECT CAST(l_shipdate AS DATE) AS date, max(l_tax) AS top_tax FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT date, total, orders, qty, top_tax FROM o JOIN l USING (date) JOIN e USING (date)
""", num="total qty top_tax", day="date", digits=2)
def _(spark, d):
    e = table(spark, d, "lineitem").where(F.col("l_returnflag") == "R").groupBy(F.col("l_shipdate").cast("date").alias("date")).agg(F.max("l_tax").alias("top_tax"))
    return order_days(spark, d).join(ship_days(spark, d, "qty").drop("top_discount"), "date").join(e, "date")


@query("asof_backward_last_view", "J10", """
SELECT p.event_id, v.event_id AS view_id, v.value AS view_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON v.user_id = p.user_id AND v.ts <= p.ts
""", num="view_value")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "value", "event_type")
    p, v = e.where(F.col("event_type") == "purchase"), e.where(F.col("event_type") == "view")
    out = asof_join(p, v, ["user_id"], "ts", "ts", {"view_id": "event_id", "view_value": "value"}, slice_seconds=7 * 86_400)
    return out.select("event_id", "view_id", "view_value")


@query("asof_with_tolerance", "J10 J14", """
SELECT p.event_id, CASE WHEN epoch(date_trunc('second', p.ts)) - epoch(date_trunc('second', v.ts)) <= 86400 THEN v.event_id END AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON v.user_id = p.user_id AND v.ts < p.ts
""")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    p, v = e.where(F.col("event_type") == "purchase"), e.where(F.col("event_type") == "view")
    return asof_join(p, v, ["user_id"], "ts", "ts", {"view_id": "event_id"}, strict=True, tolerance_seconds=86_400).select("event_id", "view_id")


@query("asof_forward_next_signup", "J11", """
SELECT p.event_id, v.event_id AS next_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') v ON v.user_id = p.user_id AND v.ts > p.ts
""")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    p, s = e.where(F.col("event_type") == "purchase"), e.where(F.col("event_type") == "signup")
    return asof_join(p, s, ["user_id"], "ts", "ts", {"next_id": "event_id"}, "forward", strict=True).select("event_id", "next_id")


def _next(op: str, miss: str) -> str:
    one = ", ".join(f"coalesce(date_diff('day', d.date, (SELECT min(c.date) FROM cal c WHERE c.event = '{e}' AND c.date {op} d.date)), {miss}) AS days_to_next_{e.lower()}" for e in base.EVENTS)
    return f"SELECT d.date, {one}, coalesce(date_diff('day', d.date, (SELECT min(c.date) FROM cal c WHERE c.date {op} d.date)), {miss}) AS days_to_next_any_econ FROM odates d"


@query("days_to_next_event_strict", "J11 O7", _next(">", "NULL"), uses="cal odates", day="date")
def _(spark, d):
    return days_to_next(base.order_dates(spark, d), base.calendar_events(spark, d), "date", "event", base.EVENTS, any_name="any_econ")


@query("days_to_next_event_inclusive", "J11", _next(">=", "-1"), uses="cal odates", day="date")
def _(spark, d):
    return days_to_next(base.order_dates(spark, d), base.calendar_events(spark, d), "date", "event", base.EVENTS, strict=False, missing=-1, any_name="any_econ")


@query("business_days_since_event", "J12 I18", """
SELECT date, CASE WHEN e IS NOT NULL THEN (SELECT count(*) FROM range(0, date_diff('day', e, date)) t(i) WHERE isodow(e + CAST(i AS INTEGER)) <= 5) END AS bdays,
  CASE WHEN e IS NOT NULL THEN CASE WHEN (SELECT count(*) FROM range(0, date_diff('day', e, date)) t(i) WHERE isodow(e + CAST(i AS INTEGER)) <= 5) <= 2 THEN 1.0 ELSE 0.0 END END AS post_event
FROM (SELECT d.date, (SELECT max(c.date) FROM cal c WHERE c.event = 'FOMC' AND c.date <= d.date) AS e FROM odates d)
""", uses="cal odates", num="post_event", day="date")
def _(spark, d):
    from strikeline.operators.indicators import post_fomc_flag

    f = base.calendar_events(spark, d).where(F.col("event") == "FOMC").select(F.col("date").alias("ev"), F.lit(1).alias("k"))
    x = asof_join(base.order_dates(spark, d).withColumn("k", F.lit(1)), f, ["k"], "date", "ev", {"last": "ev"}, slice_seconds=366 * 86_400)
    x = x.select("date", business_days_between("last", "date").alias("bdays"))
    return x.select("date", "bdays", post_fomc_flag(F.col("bdays")).alias("post_event"))


@query("event_day_flags", "J13 A6", """
SELECT d.date, {} FROM odates d LEFT JOIN cal c ON c.date = d.date GROUP BY 1
""".format(", ".join(f"CAST(count(*) FILTER (c.event = '{e}') > 0 AS BIGINT) AS is_{e.lower()}_day" for e in base.EVENTS)), uses="cal odates", day="date")
def _(spark, d):
    return event_flags(base.order_dates(spark, d), base.calendar_events(spark, d), "date", "event", base.EVENTS)


@query("earnings_day_flags", "J13 A6 A7", """
SELECT d.date, coalesce(n, 0) AS earnings_count, coalesce(s, '') AS earnings_symbols, CAST(coalesce(n, 0) > 0 AS BIGINT) AS is_earnings_day, CAST(coalesce(a, 0) AS BIGINT) AS is_earnings_cpi, CAST(coalesce(b, 0) AS BIGINT) AS is_earnings_nfp
FROM odates d LEFT JOIN (SELECT date, count(*) AS n, string_agg(event, ',' ORDER BY event) AS s, max(CASE WHEN event = 'CPI' THEN 1 ELSE 0 END) AS a, max(CASE WHEN event = 'NFP' THEN 1 ELSE 0 END) AS b FROM cal GROUP BY 1) c USING (date)
""", uses="cal odates", day="date")
def _(spark, d):
    return earnings_flags(base.order_dates(spark, d), base.calendar_events(spark, d), "date", "event", ["CPI", "NFP"]).select(
        "date", "earnings_count", "earnings_symbols", "is_earnings_day", "is_earnings_cpi", "is_earnings_nfp"
    )


@query("event_proximity_flags", "J21", """
SELECT d.date, CAST(exists(SELECT 1 FROM cal c WHERE c.event = 'FOMC' AND abs(date_diff('day', c.date, d.date)) <= 4) AS BIGINT) AS near_event,
  CAST(exists(SELECT 1 FROM cal c WHERE c.event = 'FOMC' AND date_trunc('week', c.date) = date_trunc('week', d.date)) AS BIGINT) AS event_week FROM odates d
""", uses="cal odates", day="date")
def _(spark, d):
    return near_event(base.order_dates(spark, d), base.calendar_events(spark, d).where(F.col("event") == "FOMC"), "date", 4)


@query("validity_interval_lookup", "J22 F6", """
SELECT o_orderkey, CAST(CASE WHEN d >= DATE '1993-01-20' AND d < DATE '1997-01-20' THEN 1 WHEN d >= DATE '1997-01-20' AND d < DATE '2001-01-20' THEN 2 ELSE 3 END AS BIGINT) AS term
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)
""")
def _(spark, d):
    spans = [("1993-01-20", "1997-01-20", {"term": 1}), ("1997-01-20", "2001-01-20", {"term": 2}), ("2001-01-20", "2005-01-20", {"term": 3})]
    return lookup_interval(table(spark, d, "orders"), "o_orderdate", spans, ["term"]).select("o_orderkey", F.col("term").cast("long").alias("term"))


_targets = {f"t{i}": 905.0 + 10.0 * i for i in range(9)}


@query("nearest_price_per_target", "J14 H7", """
SELECT p_brand, t AS target, CASE WHEN min(abs(p_retailprice - t)) <= 2.0 THEN arg_min(p_partkey, (abs(p_retailprice - t), p_partkey)) END AS p_partkey
FROM part, (SELECT unnest([905.0, 915.0, 925.0, 935.0, 945.0, 955.0, 965.0, 975.0, 985.0]) AS t) GROUP BY 1, 2
""", num="target")
def _(spark, d):
    x = nearest_per_target(table(spark, d, "part"), ["p_brand"], "p_retailprice", _targets, ["p_partkey"], ties=["p_partkey"], tolerance=2.0)
    rows = F.array(*[F.struct(F.lit(v).alias("target"), F.col(f"{n}.p_partkey").alias("p_partkey")) for n, v in _targets.items()])
    return x.select("p_brand", F.explode(rows).alias("_r")).select("p_brand", "_r.*")


@query("nearest_strike_within_band", "J15", """
SELECT o_orderkey, arg_min(strike, (abs(strike - goal), -strike)) AS near_strike FROM (SELECT o_orderkey, 4900.0 + o_totalprice / 1000.0 AS goal, CAST(DATE '2024-01-01' + CAST(o_orderkey % 30 AS INTEGER) AS DATE) AS date FROM orders) o
LEFT JOIN (SELECT DISTINCT date, strike FROM oi) s ON s.date = o.date AND abs(strike - goal) <= 10 GROUP BY 1
""", uses="oi", num="near_strike")
def _(spark, d):
    asks = table(spark, d, "orders").select("o_orderkey", (4900.0 + F.col("o_totalprice") / 1000.0).alias("goal"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("o_orderkey") % 30).cast("int")).alias("date"))
    ladder = base.open_interest(spark, d).select("date", "strike").distinct()
    return nearest_in_band(asks, ladder, ["date"], ["o_orderkey"], "goal", "strike", [], 10.0).select("o_orderkey", "near_strike")


@query("snapshot_fallback_chain", "J17 A22", """
SELECT d, event_type, tier, median(value) AS med, count(*) AS n FROM (
  SELECT *, min(tier) OVER (PARTITION BY d, event_type) AS best FROM (
    SELECT CAST(ts AS DATE) AS d, event_type, value, CAST(CASE WHEN hour(ts) = 10 AND minute(ts) = 0 THEN 0 WHEN hour(ts) = 10 AND minute(ts) <= 15 THEN 1 WHEN hour(ts) = 10 THEN 2 ELSE 3 END AS BIGINT) AS tier FROM events))
WHERE tier = best GROUP BY 1, 2, 3
""", num="med", day="d")
def _(spark, d):
    from strikeline.operators.radix import exact_quantiles

    h, m = F.hour("ts"), F.minute("ts")
    tier = F.when((h == 10) & (m == 0), 0).when((h == 10) & (m <= 15), 1).when(h == 10, 2).otherwise(3).cast("long")
    e = table(spark, d, "events").select(F.col("ts").cast("date").alias("d"), "event_type", "value", tier.alias("tier"))
    x = first_available(e, ["d", "event_type"], F.col("tier"))
    q = exact_quantiles(x, ["d", "event_type", "tier"], "value", [0.5])
    return q.select("d", "event_type", "tier", F.col("quantiles")[0].alias("med"), F.col("n"))


@query("closest_tenor_bucket", "J18", """
SELECT date, dte, count(*) AS n, CAST(sum(CAST(mid AS DECIMAL(20, 8))) AS DOUBLE) AS mids FROM ts JOIN (SELECT date, arg_min(dte, (abs(dte - 30), dte)) AS dte FROM ts GROUP BY 1 HAVING min(abs(dte - 30)) <= 5) USING (date, dte) GROUP BY 1, 2
""", uses="ts", num="mids", day="date", digits=4)
def _(spark, d):
    return closest_bucket(base.term_structure(spark, d), ["date"], "dte", 30.0, 5.0).groupBy("date", "dte").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("mid").cast("decimal(20,8)")).cast("double").alias("mids"))


@query("minute_equi_left_join", "J1 J4", """
SELECT s.datetime, s.spot, v.vix_close, w.vix1d_close FROM spots s LEFT JOIN vixb v USING (datetime) LEFT JOIN vix1db w USING (datetime)
""", uses="spots vixb vix1db", num="spot vix_close vix1d_close", time="datetime")
def _(spark, d):
    b = base.index_bars(spark, d)
    return base.spots(spark, d).select("datetime", "spot").join(b["vix"].select("datetime", "vix_close"), "datetime", "left").join(b["vix1d"].select("datetime", "vix1d_close"), "datetime", "left")


@query("eod_left_join_fill", "J5 J6", """
SELECT t.date, t.strike, t."right", t.dte, coalesce(o.open_interest, 0) AS open_interest FROM ts t LEFT JOIN oi o USING (date, strike, "right")
""", uses="ts oi", num="open_interest strike", day="date")
def _(spark, d):
    x = base.term_structure(spark, d).join(base.open_interest(spark, d), ["date", "strike", "right"], "left")
    return x.select("date", "strike", "right", "dte", F.coalesce("open_interest", F.lit(0.0)).alias("open_interest"))


@query("outer_join_of_daily_tables", "J9", """
SELECT date, o.n AS n_orders, l.n AS n_lines FROM (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n FROM orders GROUP BY 1) o
FULL JOIN (SELECT CAST(l_shipdate AS DATE) AS date, count(*) AS n FROM lineitem GROUP BY 1) l USING (date)
""", day="date")
def _(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(F.count(F.lit(1)).alias("n_orders"))
    s = table(spark, d, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("date")).agg(F.count(F.lit(1)).alias("n_lines"))
    return o.join(s, "date", "full_outer")


@query("semi_join_prefilter", "J19 J16", """
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 40 AND p_retailprice > 905)
""", num="l_extendedprice", digits=2)
def _(spark, d):
    want = table(spark, d, "part").where((F.col("p_size") > 40) & (F.col("p_retailprice") > 905)).select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, d, "lineitem").join(want, "l_partkey", "left_semi").select("l_orderkey", "l_linenumber", "l_extendedprice")


cte("su", "SELECT event_id, ts, event_type, value, value + 60.0 AS up, greatest(value - 15.0, 2.0) AS down FROM events WHERE event_type = 'signup'")


@query("barrier_race_on_events", "L3 J20", """
SELECT s.event_id, min(e.ts) FILTER (e.value >= s.up) AS up_t, min(e.ts) FILTER (e.value <= s.down) AS down_t, max(e.ts) AS last_t, arg_max(e.value, e.ts) AS last_v
FROM su s JOIN events e ON e.event_type = s.event_type AND e.ts > s.ts AND e.ts <= s.ts + INTERVAL 6 HOUR GROUP BY 1
""", uses="su", num="last_v", time="up_t down_t last_t")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", "ts", "event_type", "value")
    s = e.where(F.col("event_type") == "signup").select(
        "event_id", "ts", "event_type", (F.col("value") + 60.0).alias("up"), F.greatest(F.col("value") - 15.0, F.lit(2.0)).alias("down"), (F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias("z")
    )
    x = first_touch(s, e, ["event_type"], ["event_id"], "ts", "z", "ts", "value", [("up", ">=", "up"), ("down", "<=", "down")], time_width(e, ["event_type"], "ts"), dense=True)
    return x.select("event_id", "up_t", "down_t", "last_t", "last_v")


def _floor(expr: str) -> str:
    out = " ".join(f"WHEN {expr} <= round(credit * {1.0 - a!r}, 2) THEN round(credit * {1.0 - k!r}, 2)" for a, k in reversed(ratchet_tiers()))
    return f"CASE {out} END"


@query("ratchet_profit_lock", "L11", f"""
SELECT sym, d, min(bar) FILTER (close >= f) AS lock_time, arg_min(close, bar) FILTER (close >= f) AS lock_debit, arg_min(f, bar) FILTER (close >= f) AS lock_floor, min(low) AS best_debit
FROM (SELECT *, {_floor('low')} AS f FROM (SELECT sym, d, bar, close, 160.0 AS credit, min(close) OVER (PARTITION BY sym, d ORDER BY bar) AS low FROM bars5)) GROUP BY 1, 2
""", uses="bars5", num="lock_debit lock_floor best_debit", day="d", time="lock_time")
def _(spark, d):
    p = base.bars5(spark, d).select("sym", "d", "bar", "close", F.lit(160.0).alias("credit"))
    return ratchet_exit(p, ["sym", "d"], "bar", "close", "credit")


@query("feature_parity_report", "J23 L12", """
WITH a AS (SELECT event_type AS sym, CAST(ts AS DATE) AS d, avg(value) AS m, max(value) AS hi FROM events GROUP BY 1, 2),
b AS (SELECT event_type AS sym, CAST(ts AS DATE) AS d, sum(value) / count(*) AS m, max(value) FILTER (value < 300) AS hi FROM events GROUP BY 1, 2),
j AS (SELECT a.m AS am, b.m AS bm, a.hi AS ah, b.hi AS bh FROM a FULL JOIN b USING (sym, d))
SELECT 'm' AS feature, count(*) AS compared, count(*) FILTER (abs(am - bm) < 1e-6) AS matched, 0 AS one_sided, 0.0 AS worst FROM j
UNION ALL SELECT 'hi', count(*), count(*) FILTER (abs(ah - bh) < 1e-4 * abs(ah)), count(*) FILTER ((ah IS NULL) <> (bh IS NULL)), max(abs(ah - bh)) FROM j
""", num="worst")
def _(spark, d):
    g = table(spark, d, "events").groupBy(F.col("event_type").alias("sym"), F.col("ts").cast("date").alias("d"))
    a = g.agg(F.avg("value").alias("m"), F.max("value").alias("hi"))
    b = g.agg((F.sum("value") / F.count("value")).alias("m"), F.max(F.when(F.col("value") < 300, F.col("value"))).alias("hi"))
    return parity(a, b, ["sym", "d"], ["m", "hi"]).withColumnRenamed("max_abs_diff", "worst")
