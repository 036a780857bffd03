"""Registry of runnable queries, and the tables they derive from the driver data.

Each entry pairs a Spark plan with the SQL that states the same result. Derived
inputs (bars, an option chain, open interest, daily closes, ...) exist twice: as
Spark functions here and as SQL common table expressions in ``CTES``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strikeline.functions.scalar import minute_of_day


@dataclass(frozen=True)
class Entry:
    name: str
    ids: tuple[str, ...]
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def stamp(c: str):  # noqa: ANN201
    """Timestamps leave as text so that both engines print them alike."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def query(name: str, ids: str, sql: str | None = None, num: str = "", day: str = "", time: str = "", uses: str = "", digits: int = 6):
    """Register a query. ``num`` columns are rounded, ``day``/``time`` columns become text."""
    nums, days, times = num.split(), day.split(), time.split()

    def wrap(fn: Callable[[SparkSession, str], DataFrame]):  # noqa: ANN202
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            out = []
            for c in df.columns:
                e = F.col(c)
                if c in nums:
                    e = F.round(e.cast("double"), digits)
                elif c in days:
                    e = F.date_format(c, "yyyy-MM-dd")
                elif c in times:
                    e = stamp(c)
                out.append(e.alias(c))
            return df.select(*out)

        full = None
        if sql is not None:
            swaps = [f"round(CAST({c} AS DOUBLE), {digits}) + 0.0 AS {c}" for c in nums]
            swaps += [f"strftime({c}, '%Y-%m-%d') AS {c}" for c in days]
            swaps += [f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f') AS {c}" for c in times]
            star = f"* REPLACE ({', '.join(swaps)})" if swaps else "*"
            full = f"{ctes(*uses.split())}SELECT {star} FROM (\n{sql.strip()}\n)"
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, tuple(ids.split()), run, full)
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- derived inputs: Spark side -------------------------------------------------

def daily(spark: SparkSession, d: str) -> DataFrame:
    """Daily OHLC of order values per order status."""
    return table(spark, d, "orders").groupBy(
        F.col("o_orderstatus").alias("sym"), F.col("o_orderdate").cast("date").alias("d")
    ).agg(
        F.min_by("o_totalprice", "o_orderkey").alias("open"), F.max("o_totalprice").alias("high"),
        F.min("o_totalprice").alias("low"), F.max_by("o_totalprice", "o_orderkey").alias("close"), F.count(F.lit(1)).alias("volume"),
    )


def bars5(spark: SparkSession, d: str) -> DataFrame:
    """Five-minute bars per event type, prices shifted to be positive."""
    e = table(spark, d, "events").withColumn("px", F.col("value") + 100.0)
    return e.groupBy(
        F.col("event_type").alias("sym"), F.col("ts").cast("date").alias("d"), F.window("ts", "5 minutes").getField("start").alias("bar")
    ).agg(
        F.min_by("px", "ts").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "ts").alias("close"),
        F.count(F.lit(1)).alias("volume"),
    )


def session_minutes(spark: SparkSession, d: str, kind: str | None = None) -> DataFrame:
    """Minute bars of weekday sessions 09:30-16:00 over all events or one type."""
    e = table(spark, d, "events").where((F.weekday("ts") < 5) & minute_of_day("ts").between(570, 959))
    if kind:
        e = e.where(F.col("event_type") == kind)
    return e.groupBy(F.window("ts", "1 minute").getField("start").alias("datetime")).agg(
        F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
        F.max_by("value", "ts").alias("close"), F.count(F.lit(1)).alias("n"),
    )


def spots(spark: SparkSession, d: str) -> DataFrame:
    m = session_minutes(spark, d)
    w = W.partitionBy(F.col("datetime").cast("date")).orderBy("datetime").rowsBetween(W.unboundedPreceding, 0)
    return m.select("datetime", F.col("datetime").cast("date").alias("date"), (5000.0 + F.avg("close").over(w)).alias("spot"), "n")


def index_bars(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Spot bars and two volatility-index bars."""
    s = spots(spark, d)
    spx = s.select("datetime", (F.col("spot") - 0.5).alias("open"), (F.col("spot") + 1.0).alias("high"), (F.col("spot") - 1.0).alias("low"), F.col("spot").alias("close"))
    out = {"spx": spx}
    for name, kind, base in (("vix", "click", 15.0), ("vix1d", "view", 12.0)):
        m = session_minutes(spark, d, kind)
        out[name] = m.select("datetime", *[(F.lit(base) + F.col(c) / 50.0).alias(f"{name}_{c}") for c in ("open", "high", "low", "close")])
    return out


def chain_columns(spot: str, strike: str, tau, wobble):  # noqa: ANN001, ANN201
    s, k = F.col(spot), F.col(strike)
    iv = 0.12 + 2.0 * F.abs(F.ln(k / s)) + 0.0005 * wobble
    srt = s * iv * F.sqrt(tau)
    x = (k - s) / srt
    return iv, srt, x, 1.0 / (1.0 + F.exp(1.702 * x))


def chain(spark: SparkSession, d: str) -> DataFrame:
    """Strike ladder around every session minute, both sides, with greeks."""
    s = spots(spark, d).withColumn("atm", F.bround(F.col("spot") / 5.0) * 5.0)
    # each minute grows to 122 rows: spread the minutes before that, and keep a minute's rows together
    s = s.repartition(spark.sparkContext.defaultParallelism * 2, "datetime")
    g = s.withColumn("k", F.explode(F.sequence(F.lit(-30), F.lit(30)))).withColumn("strike", F.col("atm") + 5.0 * F.col("k"))
    step = (F.col("strike") / 5.0).cast("long")
    mins = minute_of_day("datetime")
    iv, srt, x, dc = chain_columns("spot", "strike", (961 - mins) / (390.0 * 252.0), (step + F.col("n")) % 7)
    g = g.select("date", F.col("datetime").alias("timestamp"), "spot", "strike", iv.alias("iv"), srt.alias("srt"), x.alias("x"), dc.alias("dc"), ((step + mins) % 97 == 0).cast("double").alias("err"))
    tv = 0.4 * F.col("srt") * F.exp(-1.2 * F.abs("x"))
    call = F.col("right") == "call"
    y = g.withColumn("right", F.explode(F.array(F.lit("call"), F.lit("put"))))
    y = y.withColumn("mid", F.greatest(F.when(call, F.col("spot") - F.col("strike")).otherwise(F.col("strike") - F.col("spot")), F.lit(0.0)) + tv)
    return y.select(
        "date", "timestamp", "strike", "right", F.col("spot").alias("underlying_price"),
        F.greatest(F.col("mid") - 0.05, F.lit(0.0)).alias("bid"), (F.col("mid") + 0.05).alias("ask"), "mid",
        F.when(call, F.col("dc")).otherwise(F.col("dc") - 1.0).alias("delta"), (1.702 * F.col("dc") * (1.0 - F.col("dc")) / F.col("srt")).alias("gamma"),
        (F.col("mid") * -0.1).alias("theta"), (F.col("srt") * 0.01).alias("vega"),
        F.when(call, 0.001).otherwise(-0.001).alias("_s"), F.col("iv").alias("implied_vol"), F.col("err").alias("iv_error"),
    ).withColumn("rho", F.col("_s") * F.col("strike")).drop("_s")


def day_spot(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("ts").cast("date").alias("date")).agg((5000.0 + F.avg("value")).alias("spot"))


def _item_day():  # noqa: ANN202
    return F.date_add(F.lit("2024-01-01").cast("date"), (F.col("l_orderkey") % 30).cast("int")).alias("date")


def _item_side():  # noqa: ANN202
    return F.when(F.col("l_linenumber") % 2 == 1, "call").otherwise("put").alias("right")


def open_interest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(
        _item_day(), (4900.0 + 5.0 * (F.col("l_partkey") % 61)).alias("strike"), _item_side()
    ).agg(F.sum("l_quantity").alias("open_interest"))


def contracts(spark: SparkSession, d: str) -> DataFrame:
    """Open interest with a daily spot, volatility, delta and gamma."""
    x = open_interest(spark, d).join(day_spot(spark, d), "date")
    iv, srt, _, dc = chain_columns("spot", "strike", F.lit(1.0 / 252.0), (F.col("strike") / 5.0).cast("long") % 7)
    x = x.select("*", iv.alias("iv"), srt.alias("srt"), dc.alias("dc"))
    return x.select(
        "date", "strike", "right", "open_interest", "spot", "iv",
        F.when(F.col("right") == "call", F.col("dc")).otherwise(F.col("dc") - 1.0).alias("delta"),
        (1.702 * F.col("dc") * (1.0 - F.col("dc")) / F.col("srt")).alias("gamma"),
    )


def term_structure(spark: SparkSession, d: str) -> DataFrame:
    tenors = F.array(*[F.lit(n) for n in (0, 1, 5, 7, 9, 14, 28, 45)])
    x = table(spark, d, "lineitem").groupBy(
        _item_day(), F.element_at(tenors, (F.col("l_suppkey") % 8 + 1).cast("int")).alias("dte"),
        (4950.0 + 5.0 * (F.col("l_partkey") % 41)).alias("strike"), _item_side(),
    ).agg((F.avg("l_extendedprice") / 1000.0).alias("bid"), (F.avg("l_discount") * 10.0).alias("w"))
    x = x.join(day_spot(spark, d).withColumnRenamed("spot", "spx_close"), "date")
    return x.select(
        "date", "dte", "strike", "right", "spx_close", (F.bround(F.col("spx_close") / 5.0) * 5.0).alias("atm_strike"),
        ((F.col("strike") - F.col("spx_close")) / F.col("spx_close")).alias("moneyness"), "bid", (F.col("bid") + F.col("w")).alias("ask"),
        (F.col("bid") + F.col("w") / 2.0).alias("mid"),
    )


EVENT_OF = {"1-URGENT": "CPI", "2-HIGH": "NFP", "3-MEDIUM": "GDP", "4-NOT SPECIFIED": "PPI", "5-LOW": "FOMC"}
EVENTS = ["CPI", "NFP", "GDP", "PPI", "FOMC"]


def calendar_events(spark: SparkSession, d: str) -> DataFrame:
    """Dates on which the cents of all orders of a priority add up to a multiple of 40 stand in for scheduled releases."""
    kind = F.coalesce(*[F.when(F.col("o_orderpriority") == p, F.lit(e)) for p, e in EVENT_OF.items()])
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("long"))
    days = table(spark, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("date"), kind.alias("event")).agg(cents.alias("cents"))
    return days.where(F.col("cents") % 40 == 0).select("date", "event")


def order_dates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct()


def trades(spark: SparkSession, d: str) -> DataFrame:
    """Scored, labelled trades read off line items."""
    return table(spark, d, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_linenumber")).alias("strategy"), F.col("l_shipdate").cast("date").alias("date"), "l_orderkey",
        (F.col("l_quantity") / 50.0 * 0.6 + F.col("l_discount") * 4.0).alias("prob"), (F.col("l_returnflag") == "R").cast("long").alias("y"),
        (1.0 + F.col("l_tax") * 10.0).alias("credit"),
        F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice") / 10000.0).otherwise(F.col("l_extendedprice") / -20000.0).alias("pnl"),
        F.concat(F.col("l_returnflag"), F.col("l_linestatus")).alias("reason"),
    )


TICKERS = {"spy": 1, "qqq": 2, "iwm": 3, "eem": 4, "tlt": 5, "xlf": 6, "xlk": 7}


def closes(spark: SparkSession, d: str) -> DataFrame:
    """One row per ship date with a close per ticker, volatility levels and macro rates."""
    x = table(spark, d, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("date"))
    n = F.col("l_linenumber")
    return x.agg(
        *[F.avg(F.when(n == i, F.col("l_extendedprice"))).alias(t) for t, i in TICKERS.items()],
        F.avg("l_extendedprice").alias("rsp"), F.avg(F.when(n <= 3, F.col("l_extendedprice"))).alias("xle"),
        (F.avg("l_quantity") / 2.0 + 7.0).alias("vix"), (F.avg(F.when(n <= 4, F.col("l_quantity"))) / 2.0 + 8.0).alias("vix3m"),
        (F.avg("l_quantity") * 3.0 + 10.0).alias("vvix"),
        (F.avg("l_tax") * 100.0).alias("fed_funds_rate"), (F.avg(F.when(n == 1, F.col("l_tax"))) * 100.0).alias("yield_2y"),
        (F.avg(F.when(n == 2, F.col("l_tax"))) * 100.0).alias("yield_10y"), (F.avg("l_discount") * 20.0).alias("ig_spread"),
        (F.avg(F.when(n == 3, F.col("l_discount"))) * 100.0).alias("hy_spread"), (F.avg("l_extendedprice") / 500.0).alias("wti_crude"),
        (F.avg(F.when(n == 4, F.col("l_quantity"))) + 80.0).alias("dxy_broad"), (F.avg(F.when(n == 5, F.col("l_extendedprice"))) / 20.0).alias("gold_fix_am"),
        (F.avg("l_quantity") * 2.0).alias("ism_pmi"), (F.avg("l_extendedprice") / 400.0).alias("lei"),
        F.max((F.col("l_quantity") == 50).cast("long")).alias("fomc"),
    )


# --- derived inputs: SQL side ---------------------------------------------------

CTES: dict[str, tuple[str, str]] = {}


def cte(name: str, body: str, needs: str = "") -> None:
    CTES[name] = (body.strip(), needs)


def ctes(*names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        for dep in CTES[n][1].split():
            visit(dep)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    if not order:
        return ""
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][0]})" for n in order) + "\n"


cte("daily", """
SELECT o_orderstatus AS sym, CAST(o_orderdate AS DATE) AS d, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
  min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, count(*) AS volume FROM orders GROUP BY 1, 2
""")
cte("bars5", """
SELECT event_type AS sym, CAST(ts AS DATE) AS d, time_bucket(INTERVAL '5 minutes', ts) AS bar, arg_min(value + 100.0, ts) AS open,
  max(value + 100.0) AS high, min(value + 100.0) AS low, arg_max(value + 100.0, ts) AS close, count(*) AS volume FROM events GROUP BY 1, 2, 3
""")
cte("sess", """
SELECT *, date_trunc('minute', ts) AS datetime FROM events WHERE isodow(ts) <= 5 AND hour(ts) * 60 + minute(ts) BETWEEN 570 AND 959
""")
cte("mbars", """
SELECT datetime, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*) AS n FROM sess GROUP BY 1
""", "sess")
cte("spots", """
SELECT datetime, CAST(datetime AS DATE) AS date, 5000.0 + avg(close) OVER (PARTITION BY CAST(datetime AS DATE) ORDER BY datetime) AS spot, n FROM mbars
""", "mbars")
cte("vixb", """
SELECT datetime, 15.0 + arg_min(value, ts) / 50.0 AS vix_open, 15.0 + max(value) / 50.0 AS vix_high, 15.0 + min(value) / 50.0 AS vix_low,
  15.0 + arg_max(value, ts) / 50.0 AS vix_close FROM sess WHERE event_type = 'click' GROUP BY 1
""", "sess")
cte("vix1db", """
SELECT datetime, 12.0 + arg_min(value, ts) / 50.0 AS vix1d_open, 12.0 + max(value) / 50.0 AS vix1d_high, 12.0 + min(value) / 50.0 AS vix1d_low,
  12.0 + arg_max(value, ts) / 50.0 AS vix1d_close FROM sess WHERE event_type = 'view' GROUP BY 1
""", "sess")
cte("grid", """
SELECT date, datetime, spot, n, strike, CAST(strike / 5.0 AS BIGINT) AS step, hour(datetime) * 60 + minute(datetime) AS mins
FROM (SELECT *, round_even(spot / 5.0, 0) * 5.0 + 5.0 * k AS strike FROM (SELECT *, unnest(range(-30, 31)) AS k FROM spots))
""", "spots")
cte("grid2", """
SELECT *, spot * iv * sqrt((961 - mins) / (390.0 * 252.0)) AS srt FROM (SELECT *, 0.12 + 2.0 * abs(ln(strike / spot)) + 0.0005 * ((step + n) % 7) AS iv FROM grid)
""", "grid")
cte("grid3", """
SELECT *, 1.0 / (1.0 + exp(1.702 * x)) AS dc, 0.4 * srt * exp(-1.2 * abs(x)) AS tv FROM (SELECT *, (strike - spot) / srt AS x FROM grid2)
""", "grid2")
cte("chain", """
SELECT date, datetime AS timestamp, strike, "right", spot AS underlying_price, greatest(mid - 0.05, 0.0) AS bid, mid + 0.05 AS ask, mid,
  CASE WHEN "right" = 'call' THEN dc ELSE dc - 1.0 END AS delta, 1.702 * dc * (1.0 - dc) / srt AS gamma, mid * -0.1 AS theta, srt * 0.01 AS vega,
  CASE WHEN "right" = 'call' THEN 0.001 ELSE -0.001 END * strike AS rho, iv AS implied_vol, CASE WHEN (step + mins) % 97 = 0 THEN 1.0 ELSE 0.0 END AS iv_error
FROM (SELECT *, greatest(CASE WHEN "right" = 'call' THEN spot - strike ELSE strike - spot END, 0.0) + tv AS mid
      FROM (SELECT *, unnest(['call', 'put']) AS "right" FROM grid3))
""", "grid3")
_sides = ", ".join(
    f"max(CASE WHEN \"right\" = '{s}' THEN {c} END) AS {s}_{o}"
    for s in ("call", "put")
    for c, o in (("bid", "bid_close"), ("ask", "ask_close"), ("mid", "mid_close"), ("delta", "delta"), ("gamma", "gamma"), ("theta", "theta"),
                 ("vega", "vega"), ("rho", "rho"), ("implied_vol", "implied_vol"), ("iv_error", "iv_error"))
)
cte("state", f"""
SELECT CAST(timestamp + INTERVAL 1 MINUTE AS DATE) AS date, timestamp + INTERVAL 1 MINUTE AS decision_datetime, timestamp AS state_datetime, p.* EXCLUDE (timestamp),
  s.spot - 0.5 AS spx_open, s.spot + 1.0 AS spx_high, s.spot - 1.0 AS spx_low, s.spot AS spx_close,
  v.* EXCLUDE (datetime), w.* EXCLUDE (datetime)
FROM (SELECT timestamp, strike, {_sides} FROM chain GROUP BY 1, 2) p
LEFT JOIN spots s ON s.datetime = p.timestamp LEFT JOIN vixb v ON v.datetime = p.timestamp LEFT JOIN vix1db w ON w.datetime = p.timestamp
""", "chain spots vixb vix1db")
cte("dspot", "SELECT CAST(ts AS DATE) AS date, 5000.0 + avg(value) AS spot FROM events GROUP BY 1")
cte("oi", """
SELECT DATE '2024-01-01' + CAST(l_orderkey % 30 AS INTEGER) AS date, 4900.0 + 5.0 * (l_partkey % 61) AS strike,
  CASE WHEN l_linenumber % 2 = 1 THEN 'call' ELSE 'put' END AS "right", sum(l_quantity) AS open_interest FROM lineitem GROUP BY 1, 2, 3
""")
cte("contracts", """
SELECT date, strike, "right", open_interest, spot, iv, CASE WHEN "right" = 'call' THEN dc ELSE dc - 1.0 END AS delta, 1.702 * dc * (1.0 - dc) / srt AS gamma
FROM (SELECT *, 1.0 / (1.0 + exp(1.702 * ((strike - spot) / srt))) AS dc
      FROM (SELECT *, spot * iv * sqrt(1.0 / 252.0) AS srt
            FROM (SELECT oi.*, spot, 0.12 + 2.0 * abs(ln(strike / spot)) + 0.0005 * (CAST(strike / 5.0 AS BIGINT) % 7) AS iv FROM oi JOIN dspot USING (date))))
""", "oi dspot")
cte("ts", """
SELECT date, dte, strike, "right", spot AS spx_close, round_even(spot / 5.0, 0) * 5.0 AS atm_strike, (strike - spot) / spot AS moneyness, bid, bid + w AS ask, bid + w / 2.0 AS mid
FROM (SELECT DATE '2024-01-01' + CAST(l_orderkey % 30 AS INTEGER) AS date, [0, 1, 5, 7, 9, 14, 28, 45][l_suppkey % 8 + 1] AS dte,
        4950.0 + 5.0 * (l_partkey % 41) AS strike, CASE WHEN l_linenumber % 2 = 1 THEN 'call' ELSE 'put' END AS "right",
        avg(l_extendedprice) / 1000.0 AS bid, avg(l_discount) * 10.0 AS w FROM lineitem GROUP BY 1, 2, 3, 4) JOIN dspot USING (date)
""", "dspot")
_kinds = " ".join(f"WHEN '{p}' THEN '{e}'" for p, e in EVENT_OF.items())
cte("cal", f"SELECT CAST(o_orderdate AS DATE) AS date, CASE o_orderpriority {_kinds} END AS event FROM orders GROUP BY 1, 2 HAVING sum(CAST(round(o_totalprice * 100) AS BIGINT)) % 40 = 0")
cte("odates", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders")
cte("trades", """
SELECT 'S' || l_linenumber AS strategy, CAST(l_shipdate AS DATE) AS date, l_orderkey, l_quantity / 50.0 * 0.6 + l_discount * 4.0 AS prob,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, 1.0 + l_tax * 10.0 AS credit,
  CASE WHEN l_returnflag = 'R' THEN l_extendedprice / 10000.0 ELSE l_extendedprice / -20000.0 END AS pnl, l_returnflag || l_linestatus AS reason FROM lineitem
""")
_tick = ", ".join(f"avg(l_extendedprice) FILTER (l_linenumber = {i}) AS {t}" for t, i in TICKERS.items())
cte("closes", f"""
SELECT CAST(l_shipdate AS DATE) AS date, {_tick}, avg(l_extendedprice) AS rsp, avg(l_extendedprice) FILTER (l_linenumber <= 3) AS xle,
  avg(l_quantity) / 2.0 + 7.0 AS vix, avg(l_quantity) FILTER (l_linenumber <= 4) / 2.0 + 8.0 AS vix3m, avg(l_quantity) * 3.0 + 10.0 AS vvix,
  avg(l_tax) * 100.0 AS fed_funds_rate, avg(l_tax) FILTER (l_linenumber = 1) * 100.0 AS yield_2y, avg(l_tax) FILTER (l_linenumber = 2) * 100.0 AS yield_10y,
  avg(l_discount) * 20.0 AS ig_spread, avg(l_discount) FILTER (l_linenumber = 3) * 100.0 AS hy_spread, avg(l_extendedprice) / 500.0 AS wti_crude,
  avg(l_quantity) FILTER (l_linenumber = 4) + 80.0 AS dxy_broad, avg(l_extendedprice) FILTER (l_linenumber = 5) / 20.0 AS gold_fix_am,
  avg(l_quantity) * 2.0 AS ism_pmi, avg(l_extendedprice) / 400.0 AS lei, max(CASE WHEN l_quantity = 50 THEN 1 ELSE 0 END) AS fomc FROM lineitem GROUP BY 1
""")
