"""Scans, sinks, filters, set operations, deduplication and audits."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from strikeline.catalog import base
from strikeline.catalog.base import cte, query, table
from strikeline.operators import audit, clean, dedup
from strikeline.operators.bars import latest_row
from strikeline.operators.calendar import missing_weekdays, reindex_business_days
from strikeline.plans.daily import option_volume_prior
from strikeline.plans.strategies import STRATEGY_NAMES
from strikeline.session import shared_dir
from strikeline.sources import readers, writers


def fresh_path(spark, label: str) -> str:
    return f"{shared_dir(spark)}/tables/{label}-{uuid.uuid4().hex}"


@query("pruned_scan_with_pushdown", "S1 S2 P4", """
SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' AND l_quantity > 30
""", num="l_extendedprice", digits=2)
def _(spark, d):
    day = F.col("l_shipdate")
    where = (day >= F.lit("1997-01-01").cast("timestamp_ntz")) & (day < F.lit("1998-01-01").cast("timestamp_ntz")) & (F.col("l_quantity") > 30)
    return readers.read_table(spark, f"{d}/lineitem.parquet", ["l_orderkey", "l_extendedprice"], where=where)


@query("index_bar_cleanup", "S3 P1 P2", """
SELECT datetime, open, high, low, close FROM (SELECT date_trunc('minute', ts) AS datetime, arg_min(v, ts) AS open, max(v) AS high, min(v) AS low, arg_max(v, ts) AS close FROM (SELECT ts, CASE WHEN event_type = 'error' THEN NULL WHEN value < 20 THEN 0.0 ELSE value END AS v FROM events) GROUP BY 1)
WHERE isodow(datetime) <= 5 AND NOT (coalesce(open, 0) = 0 AND coalesce(high, 0) = 0 AND coalesce(low, 0) = 0 AND coalesce(close, 0) = 0)
""", num="open high low close", time="datetime")
def _(spark, d):
    v = F.when(F.col("event_type") == "error", F.lit(None)).when(F.col("value") < 20, 0.0).otherwise(F.col("value"))
    e = table(spark, d, "events").select("ts", v.alias("v"))
    known = F.when(F.col("v").isNotNull(), F.col("ts"))
    b = e.groupBy(F.window("ts", "1 minute").getField("start").alias("datetime")).agg(F.min_by("v", known).alias("open"), F.max("v").alias("high"), F.min("v").alias("low"), F.max_by("v", known).alias("close"))
    return clean.drop_all_zero_rows(clean.drop_weekends(b, "datetime"), ["open", "high", "low", "close"])


@query("optional_table_default", "S4 S5", "SELECT n_name, n_regionkey, CAST(NULL AS DOUBLE) AS extra FROM nation")
def _(spark, d):
    readers.register_views(spark, {"strikeline_nation": f"{d}/nation.parquet"}, ["strikeline_nation"])
    schema = T.StructType([T.StructField("n_name", T.StringType()), T.StructField("extra", T.DoubleType())])
    absent = readers.read_optional(spark, f"{d}/no_such_table.parquet", schema)
    return spark.table("strikeline_nation").join(absent, "n_name", "left").select("n_name", "n_regionkey", "extra")


@query("csv_round_trip", "S6 K7", "SELECT event_type, count(*) AS n, avg(value) AS mean_value FROM events GROUP BY 1", num="mean_value")
def _(spark, d):
    rep = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"))
    path = fresh_path(spark, "report")
    writers.write_report(rep, path)
    schema = T.StructType([T.StructField("event_type", T.StringType()), T.StructField("n", T.LongType()), T.StructField("mean_value", T.DoubleType())])
    return readers.read_csv(spark, path, schema)


@query("one_pass_audit_scan", "S10 A36", """
SELECT count(*) AS rows, count(*) FILTER (l_discount > 0.09) AS high_discount, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship, sum(l_quantity) AS qty FROM lineitem
""", num="qty", time="first_ship last_ship")
def _(spark, d):
    return table(spark, d, "lineitem").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("l_discount") > 0.09).alias("high_discount"), F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"), F.sum("l_quantity").alias("qty")
    )


@query("latest_row_on_or_before", "S11", """
SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1998-06-30' GROUP BY 1
""")
def _(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("date"))
    o = o.withColumn("rank", F.struct("date", "o_orderkey"))
    return dedup.keep_one(o.where(F.col("date") <= F.lit("1998-06-30").cast("date")), ["o_custkey"], ["rank"]).select("o_custkey", "o_orderkey")


@query("latest_daily_row", "S11", """
SELECT sym, d, close FROM daily QUALIFY row_number() OVER (PARTITION BY sym ORDER BY d DESC) = 1
""", uses="daily", num="close", day="d")
def _(spark, d):
    return latest_row(base.daily(spark, d), ["sym"], "d", "2100-01-01").select("sym", "d", "close")


@query("freshness_report", "S13 T9", """
SELECT 'orders' AS "table", strftime(max(o_orderdate), '%Y-%m-%d') AS last_date, CASE WHEN max(o_orderdate) >= DATE '2001-08-01' THEN 'OK' ELSE 'STALE' END AS status FROM orders
UNION ALL SELECT 'lineitem', strftime(max(l_shipdate), '%Y-%m-%d'), CASE WHEN max(l_shipdate) >= DATE '2001-08-01' THEN 'OK' ELSE 'STALE' END FROM lineitem
UNION ALL SELECT 'events', strftime(max(ts), '%Y-%m-%d'), CASE WHEN max(ts) >= DATE '2001-08-01' THEN 'OK' ELSE 'STALE' END FROM events UNION ALL SELECT 'quotes', NULL, 'MISSING'
""")
def _(spark, d):
    t = {"orders": (table(spark, d, "orders"), "o_orderdate"), "lineitem": (table(spark, d, "lineitem"), "l_shipdate"), "events": (table(spark, d, "events"), "ts"), "quotes": (None, "ts")}
    x = audit.freshness(t, "2001-08-01")
    return x.select("table", F.date_format("last_date", "yyyy-MM-dd").alias("last_date"), "status")


# --- sinks ---------------------------------------------------------------------

@query("partitioned_write_and_prune", "K1 K2 S2", """
SELECT event_type, count(*) AS n, sum(value) AS total FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-09' GROUP BY 1
""", num="total", digits=4)
def _(spark, d):
    path = fresh_path(spark, "events")
    writers.write_partitions(table(spark, d, "events").withColumn("date", F.col("ts").cast("date")), path, ["date"], sort=["ts"])
    x = spark.read.parquet(path).where(F.col("date").between(F.lit("2024-01-05").cast("date"), F.lit("2024-01-09").cast("date")))
    return x.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


cte("vers", "SELECT o_custkey, o_orderkey, o_totalprice, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END AS batch FROM orders")


@query("upsert_keep_last", "K3 O5", """
SELECT o_custkey, arg_max(o_orderkey, (batch, o_orderkey)) AS o_orderkey, arg_max(o_totalprice, (batch, o_orderkey)) AS o_totalprice FROM vers GROUP BY 1
""", uses="vers", num="o_totalprice", digits=2)
def _(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus", F.pmod("o_custkey", F.lit(8)).alias("bucket"))
    old, new = o.where(F.col("o_orderstatus") == "F").drop("o_orderstatus"), o.where(F.col("o_orderstatus") != "F").drop("o_orderstatus")
    path = fresh_path(spark, "vers")
    writers.write_upsert(spark, old, path, ["o_custkey"], ["o_orderkey"], ["bucket"])
    return writers.write_upsert(spark, new, path, ["o_custkey"], ["o_orderkey"], ["bucket"]).drop("bucket")


@query("chunk_compaction", "K4 O6", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS o_totalprice, CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS o_orderpriority FROM orders", num="o_totalprice", digits=2)
def _(spark, d):
    o = table(spark, d, "orders")
    a, b = fresh_path(spark, "chunk"), fresh_path(spark, "chunk")
    writers.overwrite(o.where(F.col("o_orderstatus") == "F").select("o_orderkey", "o_totalprice"), a)
    writers.overwrite(o.where(F.col("o_orderstatus") != "F").select("o_orderkey", "o_orderpriority"), b)
    return writers.compact(spark, [a, b], fresh_path(spark, "merged"))


@query("incremental_overlap_replace", "K5 O5", """
SELECT date, CASE WHEN date < DATE '1999-01-01' THEN n ELSE n * 10 END AS n FROM (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n FROM orders GROUP BY 1)
""", day="date")
def _(spark, d):
    day = table(spark, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    path = fresh_path(spark, "daily")
    writers.overwrite(day, path)
    new = day.where(F.col("date") >= F.lit("1999-01-01").cast("date")).withColumn("n", F.col("n") * 10)
    return writers.write_incremental(spark, new, path, fresh_path(spark, "daily"), "date", ["date"], ["n"])


@query("json_report_round_trip", "K7 S7", """
SELECT o_orderpriority AS priority, count(*) AS orders, sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS total FROM orders GROUP BY 1
""", num="total", digits=2)
def _(spark, d):
    path = fresh_path(spark, "report")
    x = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"))
    writers.write_report(x, path, "json")
    return spark.read.schema("priority string, orders long, total double").json(path)


@query("resume_pending_dates", "K6 O7", """
SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem WHERE CAST(l_shipdate AS DATE) NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01')
""", day="date")
def _(spark, d):
    path = fresh_path(spark, "done")
    done = table(spark, d, "orders").where(F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz")).select(F.col("o_orderdate").cast("date").alias("date")).distinct()
    writers.overwrite(done, path)
    todo = table(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("date")).distinct()
    return writers.pending(spark, todo, path, ["date"])


# --- projections and filters --------------------------------------------------------

@query("session_time_filters", "P3", """
SELECT count(*) FILTER (m < 960) AS before_close, count(*) FILTER (m >= 570 AND (m < 960 OR (m = 960 AND second(ts) = 0))) AS regular, count(*) FILTER (m >= 600 AND m < 900) AS entry FROM (SELECT ts, hour(ts) * 60 + minute(ts) AS m FROM events)
""")
def _(spark, d):
    t = table(spark, d, "events")
    return t.agg(
        F.count_if(clean.in_session("ts", None, "16:00")).alias("before_close"), F.count_if(clean.in_session("ts", "09:30", "16:00", True)).alias("regular"), F.count_if(clean.in_session("ts", "10:00", "15:00")).alias("entry")
    )


@query("projection_maps", "P5 P6 P7 P11", "SELECT o_orderkey AS key, o_totalprice AS total, o_totalprice AS daily_prior_total, o_custkey FROM orders", num="total daily_prior_total", digits=2)
def _(spark, d):
    o = clean.project_existing(table(spark, d, "orders"), {"daily_prior_total": "o_totalprice", "daily_prior_gone": "not_there"})
    o = clean.rename_existing(o, {"o_orderkey": "key", "o_totalprice": "total", "absent": "x"})
    o = clean.drop_matching(o, ["unknown"], prefixes=["o_order"])
    feats = clean.feature_columns(o, ["key"], {"total": True, "daily_prior_total": True, "o_custkey": True})
    return o.select("key", *feats)


@query("label_null_drop_and_sanitize", "P8 P9 H2", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount <> 0 THEN l_tax / l_discount END AS ratio FROM lineitem WHERE l_tax > 0
""", num="ratio")
def _(spark, d):
    x = table(spark, d, "lineitem").withColumn("label", F.when(F.col("l_tax") > 0, F.col("l_tax")))
    inf = F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(F.try_divide("l_tax", "l_discount"))
    return clean.sanitize_numeric(x.withColumn("ratio", inf).dropna(subset=["label"])).select("l_orderkey", "l_linenumber", "l_partkey", "ratio")


@query("strategy_one_hot", "P10", "SELECT event_id, {} FROM events".format(
    ", ".join(f"CAST(event_type = '{v}' AS BIGINT) AS t_{v}" for v in ("click", "view", "refund"))))
def _(spark, d):
    assert len(STRATEGY_NAMES) == 9
    return clean.one_hot(table(spark, d, "events").select("event_id", "event_type"), "event_type", ["click", "view", "refund"], "t_").drop("event_type")


@query("median_impute", "P12", """
SELECT l_orderkey, l_linenumber, l_partkey, coalesce(t, (SELECT median(t) FROM x)) AS t, coalesce(q, (SELECT median(q) FROM x)) AS q FROM x
""".replace("FROM x)", "FROM (SELECT CASE WHEN l_tax > 0.02 THEN l_tax END AS t, CASE WHEN l_returnflag <> 'R' THEN l_quantity END AS q FROM lineitem))").replace(
    "FROM x\n", "FROM (SELECT *, CASE WHEN l_tax > 0.02 THEN l_tax END AS t, CASE WHEN l_returnflag <> 'R' THEN l_quantity END AS q FROM lineitem)\n"), num="t q")
def _(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_tax") > 0.02, F.col("l_tax")).alias("t"), F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).alias("q"))
    keep = clean.columns_under_null_rate(x, ["t", "q"], 0.5)
    return clean.impute(x, keep)


@query("null_rate_report", "P12 A46 A35", """
SELECT * FROM (SELECT 't' AS feature, avg(CASE WHEN l_tax > 0.02 THEN 0.0 ELSE 1.0 END) AS null_rate FROM lineitem UNION ALL SELECT 'q', avg(CASE WHEN l_returnflag <> 'R' THEN 0.0 ELSE 1.0 END) FROM lineitem) WHERE null_rate > 0.3
""", num="null_rate")
def _(spark, d):
    x = table(spark, d, "lineitem").select(F.when(F.col("l_tax") > 0.02, F.col("l_tax")).alias("t"), F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).alias("q"))
    return clean.null_rates(x, ["t", "q"]).where(F.col("null_rate") > 0.3)


@query("hard_blocker_predicate", "P14", """
SELECT date, CAST(coalesce(nxt IN (0, 1), false) OR cpi OR 10 + day(date) > 35 AS BIGINT) AS blocked FROM (
  SELECT date, date_diff('day', date, (SELECT min(c.date) FROM cal c WHERE c.event = 'FOMC' AND c.date >= d.date)) AS nxt, exists(SELECT 1 FROM cal c WHERE c.event = 'CPI' AND c.date = d.date) AS cpi FROM odates d)
""", uses="odates cal", day="date")
def _(spark, d):
    from strikeline.operators.calendar import days_to_next, event_flags

    ev = base.calendar_events(spark, d)
    x = days_to_next(base.order_dates(spark, d), ev, "date", "event", ["FOMC"], strict=False).join(event_flags(base.order_dates(spark, d), ev, "date", "event", ["CPI"]), "date")
    return x.select("date", clean.hard_blocked("days_to_next_fomc", ["is_cpi_day"], 10 + F.dayofmonth("date")).cast("long").alias("blocked"))


@query("contract_row_filter", "P13", "SELECT date, strike, \"right\" FROM contracts WHERE iv > 0.01 AND iv < 0.14 AND open_interest > 30", uses="contracts", num="strike", day="date")
def _(spark, d):
    return base.contracts(spark, d).where((F.col("iv") > 0.01) & (F.col("iv") < 0.14) & (F.col("open_interest") > 30)).select("date", "strike", "right")


# --- sorts, sets, dedup ---------------------------------------------------------------

@query("top_and_bottom_rows", "O1 O2", """
SELECT * FROM (SELECT 'top' AS side, p_partkey, rev FROM rev ORDER BY rev DESC, p_partkey LIMIT 20) UNION ALL SELECT * FROM (SELECT 'bottom', p_partkey, rev FROM rev ORDER BY rev, p_partkey LIMIT 5)
""".replace("FROM rev", "FROM (SELECT l_partkey AS p_partkey, sum(l_extendedprice) AS rev FROM lineitem GROUP BY 1)"), num="rev", digits=2)
def _(spark, d):
    r = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_extendedprice").alias("rev"))
    top = r.orderBy(F.desc("rev"), "p_partkey").limit(20).select(F.lit("top").alias("side"), "p_partkey", "rev")
    return top.unionByName(r.orderBy("rev", "p_partkey").limit(5).select(F.lit("bottom").alias("side"), "p_partkey", "rev"))


@query("priority_dedup", "O4", """
SELECT l_partkey, l_suppkey, l_returnflag, max(l_linenumber) AS l_linenumber FROM lineitem GROUP BY 1, 2, 3
""")
def _(spark, d):
    x = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", "l_linenumber")
    return dedup.keep_one(x, ["l_partkey", "l_suppkey", "l_returnflag"], ["l_linenumber"], last=True)


@query("keep_first_and_last", "O5", """
SELECT o_custkey, min(o_orderkey) AS first_key, arg_min(o_totalprice, o_orderkey) AS first_price, max(o_orderkey) AS last_key, arg_max(o_totalprice, o_orderkey) AS last_price FROM orders GROUP BY 1
""", num="first_price last_price", digits=2)
def _(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    a = dedup.keep_one(o, ["o_custkey"], ["o_orderkey"], last=False).withColumnsRenamed({"o_orderkey": "first_key", "o_totalprice": "first_price"})
    b = dedup.keep_one(o, ["o_custkey"], ["o_orderkey"], last=True).withColumnsRenamed({"o_orderkey": "last_key", "o_totalprice": "last_price"})
    return a.join(b, "o_custkey")


@query("union_with_missing_columns", "O6", "SELECT n_nationkey AS k, n_name AS name, CAST(NULL AS DOUBLE) AS bal FROM nation UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier", num="bal", digits=2)
def _(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    return n.unionByName(s, allowMissingColumns=True)


@query("date_set_operations", "O7 A39", """
SELECT 'union' AS op, count(*) AS n FROM (SELECT d FROM a UNION SELECT d FROM b) UNION ALL SELECT 'difference', count(*) FROM (SELECT d FROM a EXCEPT SELECT d FROM b) UNION ALL SELECT 'intersection', count(*) FROM (SELECT d FROM a INTERSECT SELECT d FROM b)
""".replace("FROM a", "FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_totalprice > 250000)").replace("FROM b", "FROM (SELECT CAST(l_shipdate AS DATE) AS d FROM lineitem WHERE l_quantity > 45)"))
def _(spark, d):
    a = table(spark, d, "orders").where(F.col("o_totalprice") > 250000).select(F.col("o_orderdate").cast("date").alias("d"))
    b = table(spark, d, "lineitem").where(F.col("l_quantity") > 45).select(F.col("l_shipdate").cast("date").alias("d"))

    def tally(x, op):
        return x.agg(F.count(F.lit(1)).alias("n")).select(F.lit(op).alias("op"), "n")

    a, b = a.distinct(), b.distinct()
    return tally(a.union(b).distinct(), "union").unionByName(tally(a.join(b, "d", "left_anti"), "difference")).unionByName(tally(a.intersect(b), "intersection"))


@query("business_day_reindex", "O8 W20", """
WITH g AS (SELECT sym, CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM daily GROUP BY sym)
SELECT g.sym, g.d, last_value(daily.close IGNORE NULLS) OVER (PARTITION BY g.sym ORDER BY g.d ROWS UNBOUNDED PRECEDING) AS filled, daily.close IS NULL AS gap FROM g LEFT JOIN daily USING (sym, d) WHERE isodow(g.d) <= 5
""".replace("WITH g AS (", "SELECT sym, d, filled, CAST(gap AS BIGINT) AS gap FROM (WITH g AS (").rstrip() + ")", uses="daily", num="filled", day="d", digits=2)
def _(spark, d):
    from pyspark.sql import Window as W

    from strikeline.operators.windows import ffill

    x = reindex_business_days(base.daily(spark, d), ["sym"], "d")
    return x.select("sym", "d", ffill("close", W.partitionBy("sym").orderBy("d")).alias("filled"), F.col("close").isNull().cast("long").alias("gap"))


@query("missing_weekday_detection", "O9 A36", """
SELECT sym, d FROM (SELECT sym, CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM daily GROUP BY sym) g WHERE isodow(d) <= 5 AND NOT EXISTS (SELECT 1 FROM daily x WHERE x.sym = g.sym AND x.d = g.d)
""", uses="daily", day="d")
def _(spark, d):
    return missing_weekdays(base.daily(spark, d), ["sym"], "d")


@query("value_counts", "A39", "SELECT event_type, CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1, 2", day="d")
def _(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.col("ts").cast("date").alias("d")).agg(F.count(F.lit(1)).alias("n"))


# --- audits -------------------------------------------------------------------------

_COLS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("column_profile", "A35", "\nUNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*) AS rows, count(*) - count({c}) AS nulls, count(*) FILTER ({c} = 0) AS zeros, CAST(0 AS BIGINT) AS infs, min({c}) AS min, max({c}) AS max, avg({c}) AS mean, stddev_samp({c}) AS std, count(DISTINCT {c}) AS distinct_values FROM lineitem" for c in _COLS
), num="min max mean std", digits=7)
def _(spark, d):
    return audit.column_profile(table(spark, d, "lineitem"), list(_COLS))


# The audit thresholds of operators/audit.py, stated in SQL.
_RULES = [
    ("call_delta_range", "\"right\" = 'call' AND (delta < -0.01 OR delta > 1.01)"), ("put_delta_range", "\"right\" = 'put' AND (delta < -1.01 OR delta > 0.01)"), ("gamma_negative", "gamma < -0.0001"), ("gamma_over_05", "gamma > 0.05"),
    ("gamma_zero", "gamma = 0"), ("theta_positive", "theta > 0.01"), ("vega_negative", "vega < -0.01"), ("iv_range", "implied_vol < 0 OR implied_vol > 5"), ("rho_call_negative", "\"right\" = 'call' AND rho < -0.01"),
    ("rho_put_positive", "\"right\" = 'put' AND rho > 0.01"), ("bid_over_ask", "bid > ask + 0.01"), ("bid_negative", "bid < -0.001"), ("mid_mismatch", "abs(mid - (bid + ask) / 2.0) > 0.01"), ("strike_range", "strike < 2000 OR strike > 7000"), ("side_unknown", "\"right\" NOT IN ('call', 'put')"),
]


@query("chain_rule_audit", "A36", "SELECT unnest([{}]) AS rule, unnest([{}]) AS violations FROM chain".format(
    ", ".join(f"'{n}'" for n, _ in _RULES), ", ".join(f"count(*) FILTER ({r})" for _, r in _RULES)), uses="chain")
def _(spark, d):
    return audit.rule_counts(base.chain(spark, d), audit.chain_rules())


@query("rows_per_day_flags", "A36", """
SELECT date, rows, median_rows, CAST(rows < median_rows * 0.1 AS BIGINT) AS sparse, CAST(rows > median_rows * 3 AS BIGINT) AS dense FROM (SELECT *, median(rows) OVER () AS median_rows FROM (SELECT CAST(l_shipdate AS DATE) AS date, count(*) AS rows FROM lineitem GROUP BY 1))
""", num="median_rows", day="date")
def _(spark, d):
    return audit.rows_per_day(table(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("date")), "date")


@query("rows_per_month", "A36", "SELECT strftime(date, '%Y-%m') AS month, CAST(sum(n) AS BIGINT) AS rows, count(*) AS days, avg(n) AS avg_per_day FROM (SELECT CAST(l_shipdate AS DATE) AS date, count(*) AS n FROM lineitem GROUP BY 1) GROUP BY 1", num="avg_per_day", digits=8)
def _(spark, d):
    return audit.rows_per_month(table(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("date")), "date")


@query("quantile_outliers", "A36 A31", "\nUNION ALL ".join(
    f"SELECT '{c}' AS feature, max(lo) AS q_low, max(hi) AS q_high, count(*) FILTER ({c} < lo) AS below, count(*) FILTER ({c} > hi) AS above FROM lineitem, (SELECT quantile_cont({c}, CAST(0.001 AS DOUBLE)) AS lo, quantile_cont({c}, CAST(0.999 AS DOUBLE)) AS hi FROM lineitem)" for c in ("l_extendedprice", "l_quantity")
), num="q_low q_high", digits=4)
def _(spark, d):
    return audit.outlier_counts(table(spark, d, "lineitem"), ["l_extendedprice", "l_quantity"])


@query("key_duplicate_count", "A37", "SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS keys, CAST(sum(n - 1) AS BIGINT) AS key_dupes FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2)")
def _(spark, d):
    return dedup.key_duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("option_volume_prior_day", "A8 P5", """
SELECT date, lag(c) OVER w AS daily_prior_total_call_volume, lag(p) OVER w AS daily_prior_total_put_volume, lag(CASE WHEN c > 0 THEN p / c END) OVER w AS daily_prior_pc_volume_ratio FROM (
  SELECT date, sum(open_interest) FILTER ("right" = 'call') AS c, sum(open_interest) FILTER ("right" = 'put') AS p FROM oi GROUP BY 1) WINDOW w AS (ORDER BY date)
""", uses="oi", num="daily_prior_total_call_volume daily_prior_total_put_volume daily_prior_pc_volume_ratio", day="date")
def _(spark, d):
    return option_volume_prior(base.open_interest(spark, d), value="open_interest")
