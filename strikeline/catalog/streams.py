"""Streaming queries run to completion over the events file, checked against batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strikeline.catalog.base import query, table
from strikeline.streaming import bars, sources


def ticks(spark, d, delay: str = "30 seconds"):
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return sources.event_time(sources.file_stream(spark, d, schema, "events.parquet"), "ts", delay)


_closed = "(SELECT max(ts) FROM events) - INTERVAL 30 SECOND"


@query("stream_minute_bars", "T1 T3 S12 H14", f"""
SELECT event_type, bar, bar + INTERVAL 1 MINUTE AS decision_datetime, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*) AS n
FROM (SELECT *, date_trunc('minute', ts) AS bar FROM events) GROUP BY 1, 2 HAVING bar + INTERVAL 1 MINUTE <= date_trunc('millisecond', {_closed})
""", num="open high low close", time="bar decision_datetime")
def _(spark, d):
    return sources.run_append(bars.minute_bars(ticks(spark, d), "ts", ["event_type"], "value"), "bars")


@query("stream_quote_bars", "T1", f"""
SELECT event_type, minute, arg_min(value, ts) AS bid_open, max(value) AS bid_high, min(value) AS bid_low, arg_max(value, ts) AS bid_close, arg_min(value + 0.1, ts) AS ask_open, max(value + 0.1) AS ask_high, min(value + 0.1) AS ask_low, arg_max(value + 0.1, ts) AS ask_close,
  arg_max(value + 0.05, ts) AS mid_close FROM (SELECT *, date_trunc('minute', ts) AS minute FROM events WHERE hour(ts) * 60 + minute(ts) BETWEEN 570 AND 959) GROUP BY 1, 2 HAVING minute + INTERVAL 1 MINUTE <= date_trunc('millisecond', {_closed})
""", num="bid_open bid_high bid_low bid_close ask_open ask_high ask_low ask_close mid_close", time="minute")
def _(spark, d):
    q = ticks(spark, d).withColumns({"bid": F.col("value"), "ask": F.col("value") + 0.1})
    return sources.run_append(bars.quote_bars(q, "ts", ["event_type"]), "quotes")


@query("stream_sliding_features", "T6", f"""
SELECT event_type, e AS decision_datetime, avg(value) AS mean, stddev_samp(value) AS std, arg_max(value, ts) / nullif(arg_min(value, ts), 0) - 1 AS ret, count(*) AS n
FROM (SELECT *, date_trunc('hour', ts) + INTERVAL 10 MINUTE * CAST(floor(minute(ts) / 10) AS INTEGER) + INTERVAL 10 MINUTE * unnest([1, 2, 3]) AS e FROM events) GROUP BY 1, 2 HAVING e <= date_trunc('millisecond', {_closed})
""", num="mean std ret", time="decision_datetime")
def _(spark, d):
    return sources.run_append(bars.sliding(ticks(spark, d), "ts", ["event_type"], "value", "30 minutes", "10 minutes"), "sliding")


@query("stream_session_state", "T4 T8", """
SELECT event_type, CAST(ts AS DATE) AS date, max(value) AS high, min(value) AS low, max(value) FILTER (hour(ts) < 10) AS orb_high, min(value) FILTER (hour(ts) < 10) AS orb_low, arg_max(value, ts) AS last, max(ts) AS last_ts, count(*) AS n FROM events GROUP BY 1, 2
""", num="high low orb_high orb_low last", day="date", time="last_ts")
def _(spark, d):
    s = bars.session_state(ticks(spark, d), "ts", ["event_type"], "value")
    return sources.run_latest(s, "session", ["event_type", "date"], ["n"])


@query("stream_last_copy_wins", "T2 K3", """
SELECT event_type, date_trunc('minute', ts) AS minute, arg_max(event_id, ts) AS event_id, arg_max(value, ts) AS value FROM events GROUP BY 1, 2
""", num="value", time="minute")
def _(spark, d):
    t = ticks(spark, d).select("event_type", F.date_trunc("minute", "ts").alias("minute"), "event_id", "value", "ts")
    x = sources.run_latest(t, "latest", ["event_type", "minute"], ["ts"], mode="append")
    return x.select("event_type", F.col("minute").cast("timestamp_ntz").alias("minute"), "event_id", "value")


@query("stream_static_enrichment", "T7", """
SELECT event_id, value / nullif(prev, 0) AS vs_prior FROM events e LEFT JOIN (SELECT event_type, CAST(ts AS DATE) + 1 AS date, avg(value) AS prev FROM events GROUP BY 1, 2) p ON p.event_type = e.event_type AND p.date = CAST(e.ts AS DATE)
""", num="vs_prior")
def _(spark, d):
    daily = table(spark, d, "events").groupBy("event_type", F.date_add(F.col("ts").cast("date"), 1).alias("date")).agg(F.avg("value").alias("prev"))
    t = ticks(spark, d).withColumn("date", F.to_date("ts"))
    x = bars.enrich(t, daily, ["event_type", "date"]).select("event_id", F.try_divide("value", "prev").alias("vs_prior"))
    return sources.run_append(x, "enriched")
