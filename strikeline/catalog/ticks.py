"""Recursions, runs and ranks over raw events: one key may hold any number of rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from strikeline.catalog import base
from strikeline.catalog.base import query
from strikeline.operators import scan
from strikeline.operators.picks import non_overlapping_sliced
from strikeline.operators.ranks import rank_over_ticks
from strikeline.operators.reach import first_touch_far
from strikeline.operators.slicing import time_width, with_time_slice
from strikeline.operators.windows import span

SLICE_ROWS = 4_000  # windows keep so many in memory; above 4,096 each takes pages of a sorter


def _events(spark, d):
    """Events in slices of a day, or narrower where a day holds more rows, ordered by (time, id) as one column.

    The windows of a slice buffer it once each, so its rows set the memory of a task.
    """
    e = base.table(spark, d, "events").select("event_id", "event_type", "ts", "value", F.struct("ts", "event_id").alias("at"))
    return with_time_slice(e, "ts", time_width(e, ["event_type"], "ts", rows=SLICE_ROWS))


_PAST = "OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"


@query("ewm_over_ticks", "W12", f"""
SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) >= 20 THEN list_reduce(list(value) {_PAST}, lambda a, x: a + 2.0 / 21 * (x - a)) END AS ema20,
  list_reduce(list(value) {_PAST}, lambda a, x: a + 0.002 * (x - a)) AS slow,
  list_reduce(list({{'y': x, 'w': 1.0::DOUBLE}}) {_PAST}, lambda a, v: CASE WHEN a.y IS NULL THEN v WHEN v.y IS NULL THEN {{'y': a.y, 'w': a.w * 0.7}}
    ELSE {{'y': (a.w * 0.7 * a.y + 0.3 * v.y) / (a.w * 0.7 + 0.3), 'w': 1.0::DOUBLE}} END).y AS gappy
FROM (SELECT *, CASE WHEN event_id % 5 = 0 OR day(ts) BETWEEN 10 AND 12 THEN NULL ELSE value END AS x FROM events)
""", num="ema20 slow gappy")
def _(spark, d):
    gone = (F.col("event_id") % 5 == 0) | F.dayofmonth("ts").between(10, 12)
    e = _events(spark, d).withColumn("x", F.when(~gone, F.col("value")))
    specs = {"ema20": span("value", 20), "slow": ("value", 0.002, 1), "gappy": ("x", 0.3, 1)}
    return scan.ewm_over_ticks(e, ["event_type"], "at", specs).select("event_id", *specs)


@query("cusum_over_ticks", "I26", f"""
SELECT event_id, list_reduce(list_prepend(0.0, list(value) {_PAST}), lambda a, x: greatest(0.0, a + x - 52.0)) AS cusum_up,
  list_reduce(list_prepend(0.0, list(value) {_PAST}), lambda a, x: greatest(0.0, a - x + 48.0)) AS cusum_down FROM events
""", num="cusum_up cusum_down", digits=4)
def _(spark, d):
    return scan.cusum_over_ticks(_events(spark, d), ["event_type"], "at", "value", F.lit(50.0), F.lit(4.0)).select("event_id", "cusum_up", "cusum_down")


@query("runs_over_ticks", "W16 W17", """
SELECT event_id, CAST(CASE WHEN low THEN row_number() OVER (PARTITION BY event_type, g, low ORDER BY ts, event_id) ELSE 0 END AS BIGINT) AS low_run,
  CAST(CASE WHEN low THEN 1 ELSE -1 END * row_number() OVER (PARTITION BY event_type, s ORDER BY ts, event_id) AS BIGINT) AS signed
FROM (SELECT *, sum(CASE WHEN low THEN 0 ELSE 1 END) OVER w AS g, sum(chg) OVER w AS s FROM (
  SELECT *, CASE WHEN low IS DISTINCT FROM lag(low) OVER (PARTITION BY event_type ORDER BY ts, event_id) THEN 1 ELSE 0 END AS chg FROM (SELECT *, value < 80 AS low FROM events))
  WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))
""")
def _(spark, d):
    e = _events(spark, d).withColumn("low", F.col("value") < 80)
    x = scan.run_of_true_over_ticks(e, ["event_type"], "at", "low", "low_run")
    return scan.signed_run_over_ticks(x, ["event_type"], "at", "low", "signed").select("event_id", "low_run", "signed")


@query("state_runs_over_ticks", "W19", """
SELECT event_id, st, CAST(row_number() OVER (PARTITION BY event_type, g ORDER BY ts, event_id) AS BIGINT) AS duration, chg AS switched
FROM (SELECT *, sum(chg) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS g FROM (
  SELECT *, CAST(CASE WHEN row_number() OVER w = 1 OR lag(st) OVER w IS NOT DISTINCT FROM st THEN 0 ELSE 1 END AS BIGINT) AS chg
  FROM (SELECT *, CAST(CASE WHEN value < 60 THEN 0 WHEN value < 120 THEN 1 END AS BIGINT) AS st FROM events)
  WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)))
""")
def _(spark, d):
    e = _events(spark, d).withColumn("st", F.when(F.col("value") < 60, 0).when(F.col("value") < 120, 1).cast("long"))
    return scan.run_of_state_over_ticks(e, ["event_type"], "at", "st", "duration", "switched").select("event_id", "st", "duration", "switched")


@query("streaks_over_ticks", "W18", """
SELECT event_id, CAST(lag(n - ll) OVER w AS BIGINT) AS wins, CAST(lag(n - lw) OVER w AS BIGINT) AS losses FROM (
  SELECT *, coalesce(max(n) FILTER (o = 0) OVER v, 0) AS ll, coalesce(max(n) FILTER (o = 1) OVER v, 0) AS lw FROM (
    SELECT *, count(o) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM (
      SELECT *, CASE WHEN event_id % 4 = 0 THEN NULL WHEN value < 70 THEN 1 ELSE 0 END AS o FROM events))
  WINDOW v AS (PARTITION BY event_type ORDER BY ts, event_id)) WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)
""")
def _(spark, d):
    e = _events(spark, d).withColumn("o", F.when(F.col("event_id") % 4 != 0, (F.col("value") < 70).cast("int")))
    return scan.streaks_over_ticks(e, ["event_type"], "at", "o", "wins", "losses").select("event_id", "wins", "losses")


def _ranks(frame: str) -> str:
    return f"""SELECT event_id, CASE WHEN len(l) >= 20 THEN (len(list_filter(l, lambda x: x < value)) + (len(list_filter(l, lambda x: x = value)) + 1) / 2.0) / len(l) END AS pct_rank,
  CASE WHEN len(l) >= 20 THEN len(list_filter(l, lambda x: x <= value)) / len(l) END AS share_le FROM (SELECT event_id, value, list(value) OVER ({frame}) AS l FROM events)"""


@query("percentile_rank_over_ticks", "W11", _ranks("PARTITION BY event_type ORDER BY ts, event_id ROWS 999 PRECEDING"), num="pct_rank share_le", digits=9)
def _(spark, d):
    return rank_over_ticks(_events(spark, d), ["event_type"], ["ts", "event_id"], "value", 1_000, 20).select("event_id", "pct_rank", "share_le")


@query("percentile_rank_long_frame", "W11", _ranks("ORDER BY ts, event_id ROWS 9999 PRECEDING"), num="pct_rank share_le", digits=9)
def _(spark, d):
    return rank_over_ticks(_events(spark, d), [], ["ts", "event_id"], "value", 10_000, 20).select("event_id", "pct_rank", "share_le")


@query("non_overlapping_over_ticks", "L8", """
WITH RECURSIVE t AS MATERIALIZED (SELECT event_id, event_type, ts, ts + to_minutes(CAST(floor(value) AS BIGINT)) AS done_at, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events),
w AS (SELECT event_type, CAST(0 AS BIGINT) AS k, TIMESTAMP '1900-01-01' AS free, CAST(NULL AS BIGINT) AS event_id, false AS pick FROM (SELECT DISTINCT event_type FROM t)
  UNION ALL SELECT n.event_type, n.k, CASE WHEN n.ts >= w.free AND n.event_id % 10 > 0 THEN n.done_at ELSE w.free END, n.event_id, n.ts >= w.free FROM w JOIN t n ON n.event_type = w.event_type AND n.k = w.k + 1)
SELECT event_id, event_type, CAST(event_id % 10 = 0 AS BIGINT) AS passive FROM w WHERE pick
""")
def _(spark, d):
    e = base.table(spark, d, "events").select("event_id", "event_type", "ts", F.expr("ts + make_dt_interval(0, 0, CAST(floor(value) AS INT), 0)").alias("done_at"))
    x = non_overlapping_sliced(e, ["event_type"], "ts", "done_at", ["event_id"], 86_400, passive=F.col("event_id") % 10 == 0)
    return x.select("event_id", "event_type", F.col("passive").cast("long").alias("passive"))


@query("barrier_race_long_horizon", "J20 L3", """
SELECT s.event_id, min(e.ts) FILTER (e.value >= s.value + 300) AS up_t, min(e.ts) FILTER (e.value <= s.value * 0.0005) AS down_t, max(e.ts) AS last_t, arg_max(e.value, e.ts) AS last_v
FROM events s JOIN events e ON e.event_type = s.event_type AND e.ts > s.ts AND e.ts <= s.ts + INTERVAL 20 DAY WHERE s.event_type IN ('signup', 'view') GROUP BY 1
""", num="last_v", time="up_t down_t last_t")
def _(spark, d):
    """Twenty days in slices of two minutes: 14,400 slices a horizon."""
    e = base.table(spark, d, "events").select("event_id", "ts", "event_type", "value")
    s = e.where(F.col("event_type").isin("signup", "view")).select(
        "event_id", "ts", "event_type", (F.col("value") + 300).alias("up"), (F.col("value") * 0.0005).alias("down"), (F.col("ts") + F.expr("INTERVAL 20 DAYS")).alias("z"))
    x = first_touch_far(s, e, ["event_type"], ["event_id"], "ts", "z", "ts", "value", [("up", ">=", "up"), ("down", "<=", "down")], 120)
    return x.select("event_id", "up_t", "down_t", "last_t", "last_v")
