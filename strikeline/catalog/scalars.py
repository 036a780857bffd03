"""Calendar, rounding, symbol, text and JSON functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from strikeline.catalog import base
from strikeline.catalog.base import query, table
from strikeline.functions import scalar as sc
from strikeline.operators import calendar as cal
from strikeline.sources import readers


@query("entry_time_encoding", "F1", """
SELECT event_id, CAST(hour(ts) AS BIGINT) AS entry_hour, CAST(minute(ts) AS BIGINT) AS entry_minute, CAST(hour(ts) * 60 + minute(ts) - 570 AS BIGINT) AS minutes_since_open, sin(2 * pi() * (hour(ts) * 60 + minute(ts) - 570) / 390.0) AS time_sin, cos(2 * pi() * (hour(ts) * 60 + minute(ts) - 570) / 390.0) AS time_cos FROM events
""", num="time_sin time_cos")
def _(spark, d):
    return table(spark, d, "events").select("event_id", *[e.alias(n) for n, e in cal.entry_time_columns("ts").items()])


@query("weekday_and_period_ends", "F2", """
SELECT date, CAST(isodow(date) - 1 AS BIGINT) AS day_of_week, CAST(isodow(date) = 1 AS BIGINT) AS is_monday, CAST(isodow(date) = 5 AS BIGINT) AS is_friday, CAST(date = last_day(date) AS BIGINT) AS is_month_end,
  CAST(date = last_day(date) AND month(date) % 3 = 0 AS BIGINT) AS is_quarter_end, CAST(quarter(date) AS BIGINT) AS cycle_quarter FROM odates
""", uses="odates", day="date")
def _(spark, d):
    return base.order_dates(spark, d).select("date", *[e.alias(n) for n, e in cal.weekday_columns("date").items()])


@query("season_and_quarter_position", "F3 F4", """
SELECT date, CAST(week(date) AS BIGINT) AS week_of_year, CAST(day(date) AS BIGINT) AS day_of_month, CAST(month(date) AS BIGINT) AS month, CAST(quarter(date) AS BIGINT) AS quarter, CAST(date_diff('day', date_trunc('quarter', date), date) AS BIGINT) AS days_into_quarter,
  CAST(month(date) BETWEEN 5 AND 10 AS BIGINT) AS sell_in_may, CAST(month(date) >= 10 AS BIGINT) AS q4_rally, CAST(month(date) = 1 AS BIGINT) AS january_effect, me AS days_to_month_end, CAST(me <= 3 AS BIGINT) AS near_month_end, qe AS days_to_qtr_end, CAST(qe <= 5 AS BIGINT) AS near_qtr_end,
  CAST(month(date) = 11 AND abs(date_diff('day', date, th)) <= 4 AS BIGINT) AS thanksgiving_week, CAST(month(date) = 12 AND day(date) >= 24 AS BIGINT) AS christmas_week
FROM (SELECT *, date_diff('day', date, last_day(date)) AS me, date_diff('day', date, CAST(date_trunc('quarter', date) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE)) AS qe,
  make_date(year(date), 11, 22) + CAST((4 - isodow(make_date(year(date), 11, 22)) + 7) % 7 AS INTEGER) AS th FROM odates)
""", uses="odates", day="date")
def _(spark, d):
    return base.order_dates(spark, d).select("date", *[e.alias(n) for n, e in cal.season_columns("date").items()])


@query("option_expiry_calendar", "F5 J21", """
SELECT date, CAST(date = o AS BIGINT) AS opex_day, CAST(abs(date_diff('day', date, o)) <= 4 AS BIGINT) AS opex_week, CAST(date = o AND month(date) % 3 = 0 AS BIGINT) AS triple_witching
FROM (SELECT date, make_date(year(date), month(date), 15) + CAST((5 - isodow(make_date(year(date), month(date), 15)) + 7) % 7 AS INTEGER) AS o FROM odates)
""", uses="odates", day="date")
def _(spark, d):
    return base.order_dates(spark, d).select("date", *[e.alias(n) for n, e in cal.opex_columns("date").items()])


@query("presidential_cycle", "F6 J22", """
SELECT date, CAST(p AS BIGINT) AS party_dem, CAST(t AS BIGINT) AS term_num, CAST(least(m // 12 + 1, 4) AS BIGINT) AS cycle_year, CAST(least(m % 48, 47) AS BIGINT) AS cycle_month, CAST(m // 12 + 1 = 3 AS BIGINT) AS pre_election_year,
  CAST(m // 12 + 1 = 4 AS BIGINT) AS election_year, CAST(m // 12 + 1 = 2 AS BIGINT) AS midterm_year, CAST(m // 12 + 1 = 1 AS BIGINT) AS first_year
FROM (SELECT date, p, t, (year(date) - year(s)) * 12 + month(date) - month(s) AS m FROM (SELECT date, CASE WHEN date < DATE '2001-01-20' THEN 1 ELSE 0 END AS p, CASE WHEN date >= DATE '1997-01-20' AND date < DATE '2001-01-20' THEN 2 ELSE 1 END AS t,
  CASE WHEN date < DATE '1997-01-20' THEN DATE '1993-01-20' WHEN date < DATE '2001-01-20' THEN DATE '1997-01-20' ELSE DATE '2001-01-20' END AS s FROM odates))
""", uses="odates", day="date")
def _(spark, d):
    return cal.cycle_columns(base.order_dates(spark, d), "date")


@query("half_even_strike_rounding", "F7 H5", "SELECT p_partkey, round_even(p_retailprice * 2.5 / 5, 0) * 5 AS strike FROM part", num="strike")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", sc.to_step(F.col("p_retailprice") * 2.5).alias("strike"))


@query("mid_moneyness_and_tenor", "F14", """
SELECT date, strike, dte, "right", CASE WHEN bid > 0 AND ask > 0 THEN (bid + ask) / 2.0 END AS mid, (strike - spx_close) / spx_close AS moneyness, strftime(date + CAST(dte AS INTEGER), '%Y-%m-%d') AS expiration FROM ts
""", uses="ts", num="strike mid moneyness", day="date", digits=9)
def _(spark, d):
    return base.term_structure(spark, d).select(
        "date", "strike", "dte", "right", sc.both_positive_mid("bid", "ask").alias("mid"), sc.div(F.col("strike") - F.col("spx_close"), "spx_close").alias("moneyness"),
        F.date_format(F.date_add("date", F.col("dte")), "yyyy-MM-dd").alias("expiration"),
    )


@query("log_pow_sign_clip", "F15", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_tax > 0 THEN ln(l_tax) END AS ln_tax, log10(l_quantity) AS lg, sqrt(l_quantity) AS rt, pow(l_discount, 2) AS sq, sign(l_discount - 0.05) AS sg, abs(l_tax - 0.04) AS ab, greatest(0.02, least(0.06, l_tax)) AS cl FROM lineitem
""", num="ln_tax lg rt sq sg ab cl")
def _(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", sc.safe_ln("l_tax").alias("ln_tax"), F.log10("l_quantity").alias("lg"), F.sqrt("l_quantity").alias("rt"), F.pow("l_discount", F.lit(2)).alias("sq"),
        F.signum(F.col("l_discount") - 0.05).alias("sg"), F.abs(F.col("l_tax") - 0.04).alias("ab"), sc.clip("l_tax", 0.02, 0.06).alias("cl"),
    )


@query("guarded_division", "F16", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_tax > 0 THEN l_discount / l_tax END AS pos, l_discount / nullif(l_tax, 0) AS safe, CASE WHEN l_tax > 0 THEN (l_discount - l_tax) / l_tax * 100 END AS pct FROM lineitem
""", num="pos safe pct")
def _(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", sc.div_pos("l_discount", "l_tax").alias("pos"), sc.div("l_discount", "l_tax").alias("safe"), sc.pct_over("l_discount", "l_tax").alias("pct")
    )


@query("strategy_label_parsing", "F17 F18", """
SELECT l_orderkey, l_linenumber, l_partkey, CAST(regexp_extract(label, 'IC_(\\d{2})d', 1) AS DOUBLE) / 100 AS target, lower(label) AS low, split_part(span, ' -> ', 2) AS tail FROM (
  SELECT *, 'IC_' || lpad(CAST(5 * l_linenumber AS VARCHAR), 2, '0') || 'd_25w' AS label, strftime(l_shipdate, '%Y-%m-%d') || ' -> ' || l_returnflag AS span FROM lineitem)
""", num="target")
def _(spark, d):
    x = table(spark, d, "lineitem").withColumn("label", F.concat(F.lit("IC_"), F.lpad((5 * F.col("l_linenumber")).cast("string"), 2, "0"), F.lit("d_25w")))
    span = F.concat_ws(" -> ", F.date_format("l_shipdate", "yyyy-MM-dd"), "l_returnflag")
    return x.select("l_orderkey", "l_linenumber", "l_partkey", sc.target_delta_of("label").alias("target"), F.lower("label").alias("low"), F.element_at(F.split(span, " -> "), 2).alias("tail"))


@query("option_symbol_round_trip", "F19", """
SELECT date, strike, "right", dte, 'SPXW' || strftime(date + CAST(dte AS INTEGER), '%y%m%d') || upper("right"[1]) || lpad(CAST(CAST(strike * 1000 AS BIGINT) AS VARCHAR), 8, '0') AS symbol, strike AS back FROM ts
""", uses="ts", num="strike back", day="date")
def _(spark, d):
    x = base.term_structure(spark, d).withColumn("symbol", sc.occ_symbol(F.lit("SPXW"), F.date_add("date", F.col("dte")), "right", "strike"))
    return x.select("date", "strike", "right", "dte", "symbol", sc.parse_occ("symbol")["strike"].alias("back"))


@query("blocker_reason_lists", "P15", """
SELECT date, array_to_string(list_filter([CASE WHEN v BETWEEN 25 AND 35 THEN 'elevated vol' END, CASE WHEN day(date) >= 28 THEN 'month end' END, CASE WHEN day(date) >= 28 AND month(date) % 3 = 0 THEN 'quarter end' END, CASE WHEN w THEN 'fomc week' END], lambda x: x IS NOT NULL), ';') AS soft
FROM (SELECT date, 10 + day(date) AS v, exists(SELECT 1 FROM cal c WHERE c.event = 'FOMC' AND date_trunc('week', c.date) = date_trunc('week', d.date)) AS w FROM odates d)
""", uses="odates cal", day="date")
def _(spark, d):
    from strikeline.operators.clean import soft_reasons

    x = cal.near_event(base.order_dates(spark, d), base.calendar_events(spark, d).where(F.col("event") == "FOMC"), "date", 4)
    return x.select("date", F.array_join(soft_reasons("date", 10 + F.dayofmonth("date"), "event_week"), ";").alias("soft"))


@query("hard_blocker_reasons", "P15", """
SELECT date, array_to_string(list_filter(list_concat([CASE WHEN f THEN 'fomc day' END, CASE WHEN day(date) % 9 = 0 THEN 'earnings' END, CASE WHEN t THEN 'fomc eve' END, CASE WHEN 10 + day(date) > 35 THEN 'vix above 35' END],
  list_transform(coalesce(names, []), lambda x: 'release: ' || x)), lambda x: x IS NOT NULL), ';') AS hard
FROM (SELECT date, coalesce(list_contains(names, 'FOMC'), false) AS f, exists(SELECT 1 FROM cal c WHERE c.event = 'FOMC' AND c.date = o.date + 1) AS t, list_sort(list_filter(names, lambda x: x <> 'FOMC')) AS names
  FROM odates o LEFT JOIN (SELECT date, list(event) AS names FROM cal GROUP BY 1) USING (date))
""", uses="odates cal", day="date")
def _(spark, d):
    from strikeline.operators.clean import hard_reasons

    events = base.calendar_events(spark, d)
    named = events.groupBy("date").agg(F.sort_array(F.collect_set(F.when(F.col("event") != "FOMC", F.col("event")))).alias("names"), F.bool_or(F.col("event") == "FOMC").alias("fomc"))
    eve = events.where(F.col("event") == "FOMC").select(F.date_sub("date", 1).alias("date"), F.lit(True).alias("tomorrow"))
    x = base.order_dates(spark, d).join(named, "date", "left").join(eve, "date", "left")
    return x.select("date", F.array_join(hard_reasons("fomc", "names", F.dayofmonth("date") % 9 == 0, "tomorrow", 10 + F.dayofmonth("date")), ";").alias("hard"))


@query("event_props_json", "S7 S9 F24", """
SELECT event_type, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS DOUBLE)) AS total FROM events GROUP BY 1
""", num="total")
def _(spark, d):
    e = table(spark, d, "events").select("event_type", readers.json_number("props", "$.k").alias("k"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total"))


@query("nested_chain_response", "S7 F14", """
SELECT date, strftime(date + CAST(dte AS INTEGER), '%Y-%m-%d') AS expiration, CAST(dte AS BIGINT) AS dte, strike, "right", bid, ask, (bid + ask) / 2.0 AS mid, (strike - spx_close) / spx_close AS moneyness FROM ts
""", uses="ts", num="strike bid ask mid moneyness", day="date", digits=9)
def _(spark, d):
    """Every quote packed into a vendor-style document, then read back."""
    t = base.term_structure(spark, d)
    quote = F.struct(F.col("bid"), F.col("ask"), F.lit(1).cast("long").alias("volume"))
    contract = F.struct(F.col("strike"), F.date_format(F.date_add("date", F.col("dte")), "yyyy-MM-dd").alias("expiration"), F.upper("right").alias("right"))
    body = F.to_json(F.struct(F.array(F.struct(contract.alias("contract"), F.array(quote).alias("data"))).alias("response")))
    docs = t.select("date", "spx_close", body.alias("body"))
    x = readers.explode_chain(docs, "body", ["date", "spx_close"], "date", "spx_close")
    return x.select("date", F.date_format("expiration", "yyyy-MM-dd").alias("expiration"), F.col("dte").cast("long").alias("dte"), "strike", "right", "bid", "ask", "mid", "moneyness")


@query("chain_map_flatten", "S8", """
SELECT date, "right", min(dte) AS first_dte, count(*) AS n, sum(bid) AS bids FROM (SELECT *, min(dte) OVER (PARTITION BY date, "right") AS d0 FROM ts) WHERE dte = d0 GROUP BY 1, 2
""", uses="ts", num="bids", day="date", digits=9)
def _(spark, d):
    """A map-of-map document per date and side (at most 8 tenors of 41 strikes); first expiry kept."""
    t = base.term_structure(spark, d).withColumn("exp", F.lpad(F.col("dte").cast("string"), 3, "0"))
    per = t.groupBy("date", "right", "exp").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("strike").cast("string"), F.array(F.struct("bid", "ask", F.lit(0.5).alias("delta")))))).alias("m")
    )
    docs = per.groupBy("date", "right").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("exp", "m")))).alias("body"))
    x = readers.flatten_chain_map(docs, "body", ["date", "right"])
    return x.groupBy("date", "right").agg(F.min(F.col("expiry").cast("int")).alias("first_dte"), F.count(F.lit(1)).alias("n"), F.sum("bid").alias("bids"))


@query("series_observations", "S9", """
SELECT o_orderstatus AS series, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS date, o_totalprice AS value FROM orders WHERE o_totalprice >= 50000
""", num="value")
def _(spark, d):
    o = table(spark, d, "orders")
    value = F.when(F.col("o_totalprice") < 50000, F.lit(".")).otherwise(F.col("o_totalprice").cast("string"))
    body = F.to_json(F.struct(F.array(F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), value.alias("value"))).alias("observations")))
    x = readers.explode_observations(o.select(F.col("o_orderstatus").alias("series"), body.alias("body")), "body", ["series"])
    return x.select("series", F.date_format("date", "yyyy-MM-dd").alias("date"), "value")
