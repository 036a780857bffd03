"""Metrics, sweeps, splits, gating and trade selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from strikeline.catalog import base
from strikeline.catalog.base import cte, query, table
from strikeline.functions.scalar import expected_value, half_kelly
from strikeline.operators import metrics as mt
from strikeline.operators import selection as sel
from strikeline.operators import splits
from strikeline.operators.radix import quantiles_long

# The threshold and skip-rate grids.
THRESHOLDS = [0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70]
RATES = [0.05, 0.10, 0.15, 0.20, 0.25, 0.30]
# linear interpolation between order statistics of a sorted list, in plain SQL
_q = "list_extract(l, CAST(floor(r * (len(l) - 1)) AS BIGINT) + 1) + (list_extract(l, CAST(ceil(r * (len(l) - 1)) AS BIGINT) + 1) - list_extract(l, CAST(floor(r * (len(l) - 1)) AS BIGINT) + 1)) * (r * (len(l) - 1) - floor(r * (len(l) - 1)))"
cte("cuts", f"""
SELECT strategy, r, {_q} AS cutoff FROM (SELECT strategy, list(prob ORDER BY prob) AS l FROM trades GROUP BY 1), (SELECT unnest([CAST(0.05 AS DOUBLE), 0.1, 0.15, 0.2, 0.25, 0.3]) AS r)
""", "trades")


@query("win_loss_profile", "A23", """
SELECT strategy, avg(pnl) FILTER (y = 1) AS avg_win, avg(pnl) FILTER (y = 0) AS avg_loss, avg(y) AS win_rate FROM trades GROUP BY 1 HAVING count(*) FILTER (y = 1) > 0 AND count(*) FILTER (y = 0) > 0
""", uses="trades", num="avg_win avg_loss win_rate", digits=8)
def _(spark, d):
    return mt.win_loss_profile(base.trades(spark, d), ["strategy"], "y", "pnl")


cte("auc", """
SELECT g, sum(p + q) AS rows, sum(p) AS positives, sum(p * (below + q / 2.0)) / nullif(sum(p) * sum(q), 0) AS auc FROM (
  SELECT *, coalesce(sum(q) OVER (PARTITION BY g ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT strategy AS g, prob AS s, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS q FROM trades GROUP BY 1, 2)) GROUP BY 1
""", "trades")


@query("strategy_auc_table", "A24 A26", "SELECT g AS strategy, CAST(rows AS BIGINT) AS rows, CAST(positives AS BIGINT) AS positives, auc, positives / rows AS win_rate FROM auc", uses="auc", num="auc win_rate", digits=8)
def _(spark, d):
    return mt.group_table(base.trades(spark, d), ["strategy"], "y", "prob")


@query("document_quality_auc", "A26", """
WITH x AS (SELECT lang, quality, n_chars AS s FROM labels JOIN documents USING (doc_id))
SELECT lang, (sum(rk) FILTER (quality = 1) - count(*) FILTER (quality = 1) * (count(*) FILTER (quality = 1) + 1) / 2.0) / nullif(count(*) FILTER (quality = 1) * count(*) FILTER (quality = 0), 0) AS auc
FROM (SELECT *, rank() OVER (PARTITION BY lang ORDER BY s) + (count(*) OVER (PARTITION BY lang, s) - 1) / 2.0 AS rk FROM x) GROUP BY 1
""", num="auc", digits=8)
def _(spark, d):
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return mt.roc_auc(x, ["lang"], "quality", "n_chars").select("lang", "auc")


@query("reward_risk_table", "A25", """
SELECT strategy, count(*) AS n, avg(credit) AS mean_credit, median(credit) AS median_credit, stddev_samp(credit) AS std_credit, avg(pnl) AS avg_pnl, avg(y) AS win_rate, avg(credit) / nullif(abs(min(pnl)), 0) AS reward_risk FROM trades GROUP BY 1
""", uses="trades", num="mean_credit median_credit std_credit avg_pnl win_rate reward_risk", digits=8)
def _(spark, d):
    from strikeline.operators.radix import exact_quantiles

    t = base.trades(spark, d)
    med = exact_quantiles(t, ["strategy"], "credit", [0.5]).select("strategy", F.col("quantiles")[0].alias("median_credit"))
    g = t.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("n"), F.avg("credit").alias("mean_credit"), F.stddev_samp("credit").alias("std_credit"), F.avg("pnl").alias("avg_pnl"), F.avg("y").alias("win_rate"),
        F.try_divide(F.avg("credit"), F.abs(F.min("pnl"))).alias("reward_risk"),
    )
    return g.join(med, "strategy")


@query("confusion_metrics", "A27", """
SELECT *, (tp + tn) / (tp + fp + fn + tn) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2.0 * tp / nullif(2.0 * tp + fp + fn, 0), 0) AS f1
FROM (SELECT strategy, count(*) FILTER (y = 1 AND prob >= 0.55) AS tp, count(*) FILTER (y = 0 AND prob >= 0.55) AS fp, count(*) FILTER (y = 1 AND prob < 0.55) AS fn, count(*) FILTER (y = 0 AND prob < 0.55) AS tn FROM trades GROUP BY 1)
""", uses="trades", num="accuracy precision recall f1", digits=8)
def _(spark, d):
    return mt.confusion(base.trades(spark, d), ["strategy"], "y", "prob", 0.55)


@query("threshold_sweep", "A28", """
SELECT t.threshold, count(*) FILTER (prob >= t.threshold) AS trades, avg(y) FILTER (prob >= t.threshold) AS win_rate, count(*) FILTER (prob >= t.threshold AND y = 1) / count(*) FILTER (y = 1) AS recall, 1 - count(*) FILTER (prob >= t.threshold) / count(*) AS skip_rate
FROM trades, (SELECT unnest([0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7]) AS threshold) t GROUP BY 1
""", uses="trades", num="threshold win_rate recall skip_rate", digits=8)
def _(spark, d):
    return mt.threshold_sweep(base.trades(spark, d), [], "y", "prob", THRESHOLDS)


@query("calibration_bins", "A29", """
SELECT least(CAST(floor(prob * 5) AS BIGINT), 4) AS bin, count(*) AS n, avg(prob) AS avg_score, avg(y) AS actual FROM trades WHERE prob >= 0 AND prob <= 1 GROUP BY 1
""", uses="trades", num="avg_score actual", digits=8)
def _(spark, d):
    return mt.calibration(base.trades(spark, d), [], "y", "prob")


@query("skip_rate_sweep", "A30 A32", """
SELECT c.strategy, c.r AS target_skip, c.cutoff, count(*) AS n_total, count(*) FILTER (prob >= cutoff) AS n_trades, 1 - count(*) FILTER (prob >= cutoff) / count(*) AS skip_rate, avg(y) FILTER (prob >= cutoff) AS win_rate, avg(y) FILTER (prob >= cutoff) - avg(y) AS win_rate_lift,
  avg(pnl) FILTER (prob >= cutoff) AS ev_per_trade, avg(pnl) FILTER (prob >= cutoff) - avg(pnl) AS ev_lift, sum(pnl) FILTER (prob >= cutoff) AS total_pnl
FROM trades t JOIN cuts c USING (strategy) GROUP BY ALL HAVING count(*) FILTER (prob >= cutoff) >= 50
""", uses="trades cuts", num="target_skip cutoff skip_rate win_rate win_rate_lift ev_per_trade ev_lift total_pnl", digits=9)
def _(spark, d):
    return mt.skip_rate_sweep(base.trades(spark, d), ["strategy"], "y", "prob", "pnl", RATES)


@query("quantile_cutoffs", "A31", """
SELECT strategy, unnest([0.05, 0.25, 0.5, 0.75, 0.95]) AS skip_rate, unnest(quantile_cont(pnl, [0.05, 0.25, 0.5, 0.75, 0.95])) AS cutoff, count(*) AS n FROM trades GROUP BY 1
""", uses="trades", num="skip_rate cutoff", digits=8)
def _(spark, d):
    return quantiles_long(base.trades(spark, d), ["strategy"], "pnl", [0.05, 0.25, 0.5, 0.75, 0.95], "cutoff", "skip_rate")


@query("strategy_by_exit_grid", "A32 O2", """
SELECT strategy, avg(pnl) FILTER (reason = 'AF') AS ev_af, avg(pnl) FILTER (reason = 'NO') AS ev_no, avg(pnl) FILTER (reason = 'RF') AS ev_rf FROM trades GROUP BY 1 ORDER BY ev_rf DESC LIMIT 5
""", uses="trades", num="ev_af ev_no ev_rf")
def _(spark, d):
    p = base.trades(spark, d).groupBy("strategy").pivot("reason", ["AF", "NO", "RF"]).agg(F.avg("pnl"))
    return p.withColumnsRenamed({r: f"ev_{r.lower()}" for r in ("AF", "NO", "RF")}).orderBy(F.desc("ev_rf")).limit(5)


cte("gridq", """
WITH r AS (SELECT * EXCLUDE (reason), rank() OVER (PARTITION BY strategy, quarter(date) ORDER BY prob) + (count(*) OVER (PARTITION BY strategy, quarter(date), prob) - 1) / 2.0 AS rk, 'Q' || quarter(date) AS reason FROM trades)
SELECT strategy, reason, count(*) AS n, avg(y) AS base_wr, avg(pnl) AS base_ev, count(*) FILTER (prob >= 0.5) AS trades, avg(y) FILTER (prob >= 0.5) AS model_wr, avg(pnl) FILTER (prob >= 0.5) AS model_ev,
  sum(pnl) FILTER (prob >= 0.5) AS total_pnl, (sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / nullif(count(*) FILTER (y = 1) * count(*) FILTER (y = 0), 0) AS auc,
  avg(y) FILTER (prob >= 0.5) - avg(y) AS wr_lift, avg(pnl) FILTER (prob >= 0.5) - avg(pnl) AS ev_lift
FROM r GROUP BY 1, 2 HAVING count(*) >= 30 AND count(*) FILTER (prob >= 0.5) >= 10
""", "trades")
GRID = "base_wr base_ev model_wr model_ev total_pnl auc wr_lift ev_lift"


def _graded(spark, d):
    """Trades per strategy and a level that is independent of their label: the quarter of the ship date."""
    return base.trades(spark, d).withColumn("reason", F.concat(F.lit("Q"), F.quarter("date")))


@query("strategy_level_grid", "A32", "SELECT * FROM gridq", uses="gridq", num=GRID, digits=7)
def _(spark, d):
    return mt.level_grid(_graded(spark, d), ["strategy", "reason"], "y", "prob", "pnl")


@query("strategy_level_auc_pivot", "A32", """
SELECT strategy, max(auc) FILTER (reason = 'Q1') AS "Q1", max(auc) FILTER (reason = 'Q2') AS "Q2", max(auc) FILTER (reason = 'Q3') AS "Q3", max(auc) FILTER (reason = 'Q4') AS "Q4" FROM gridq GROUP BY 1
""", uses="gridq", num="Q1 Q2 Q3 Q4", digits=7)
def _(spark, d):
    g = mt.level_grid(_graded(spark, d), ["strategy", "reason"], "y", "prob", "pnl")
    return g.groupBy("strategy").pivot("reason", ["Q1", "Q2", "Q3", "Q4"]).agg(F.max("auc"))


@query("strategy_level_extremes", "A32 O2", """
SELECT * FROM (SELECT strategy, reason, ev_lift, 'best' AS side FROM gridq ORDER BY ev_lift DESC, strategy, reason LIMIT 5)
UNION ALL SELECT * FROM (SELECT strategy, reason, ev_lift, 'worst' AS side FROM gridq ORDER BY ev_lift, strategy, reason LIMIT 5)
""", uses="gridq", num="ev_lift", digits=7)
def _(spark, d):
    g = mt.level_grid(_graded(spark, d), ["strategy", "reason"], "y", "prob", "pnl").select("strategy", "reason", "ev_lift")
    return mt.extremes(g, "ev_lift", ["strategy", "reason"])


@query("trade_log_stats", "A33", """
SELECT strategy, count(*) AS trades, count(*) FILTER (pnl > 0) / count(*) AS win_rate, avg(pnl) AS avg_pnl, max(pnl) AS max_pnl, min(pnl) AS min_pnl, sum(pnl) AS total_pnl, sum(pnl) FILTER (pnl > 0) / -sum(pnl) FILTER (pnl < 0) AS profit_factor,
  count(*) FILTER (reason = 'AF') AS "n_AF", count(*) FILTER (reason = 'RF') AS "n_RF", median(pnl) AS median_pnl FROM trades GROUP BY 1
""", uses="trades", num="win_rate avg_pnl max_pnl min_pnl total_pnl profit_factor median_pnl")
def _(spark, d):
    return mt.trade_stats(base.trades(spark, d), ["strategy"], "pnl", "reason", ["AF", "RF"])


@query("equity_curve_stats", "A34 W14", """
SELECT strategy, count(*) AS days, (arg_max(e, date) - 10000) / 10000 * 100 AS total_return_pct, max((peak - e) / peak) * 100 AS max_drawdown_pct, coalesce(avg(r) / nullif(stddev_pop(r), 0) * sqrt(252), 0) AS sharpe FROM (
  SELECT *, greatest(10000, max(e) OVER w) AS peak, CASE WHEN prev > 0 THEN (e - prev) / prev END AS r FROM (SELECT *, coalesce(lag(e) OVER (PARTITION BY strategy ORDER BY date), 10000) AS prev FROM (
    SELECT strategy, date, 10000 + sum(p) OVER (PARTITION BY strategy ORDER BY date) AS e FROM (SELECT strategy, date, sum(pnl) AS p FROM trades GROUP BY 1, 2))) WINDOW w AS (PARTITION BY strategy ORDER BY date)) GROUP BY 1
""", uses="trades", num="total_return_pct max_drawdown_pct sharpe")
def _(spark, d):
    day = base.trades(spark, d).groupBy("strategy", "date").agg(F.sum("pnl").alias("p"))
    return mt.equity_stats(day, ["strategy"], "date", "p")


@query("model_vote_signal", "A40 M7", """
SELECT date, count(prob) AS models, count(*) FILTER (prob >= CASE WHEN soft THEN 0.70 ELSE 0.55 END) AS votes, avg(prob) AS avg_score,
  CASE WHEN count(prob) = 0 THEN 'NO_MODEL' WHEN count(*) FILTER (prob >= CASE WHEN soft THEN 0.70 ELSE 0.55 END) < 3 THEN 'SKIP' WHEN bool_or(soft) THEN 'SIZE_DOWN' ELSE 'TRADE' END AS signal
FROM (SELECT date, prob, day(date) >= 28 AS soft FROM trades) GROUP BY 1
""", uses="trades", num="avg_score", day="date", digits=8)
def _(spark, d):
    t = base.trades(spark, d).select("date", "prob", (F.dayofmonth("date") >= 28).alias("soft"))
    return mt.model_vote(t, ["date"], "prob", "soft")


@query("class_weight", "A42", "SELECT strategy, count(*) FILTER (y = 0) / count(*) FILTER (y = 1) AS scale_pos_weight FROM trades GROUP BY 1", uses="trades", num="scale_pos_weight", digits=8)
def _(spark, d):
    return mt.class_weight(base.trades(spark, d), ["strategy"], "y")


@query("taken_vs_skipped", "A43", """
SELECT strategy, count(*) FILTER (prob >= 0.5) AS n_taken, count(*) FILTER (prob < 0.5) AS n_skipped, avg(pnl) FILTER (prob >= 0.5) AS avg_taken, sum(pnl) FILTER (prob >= 0.5) AS total_taken, count(*) FILTER (prob >= 0.5 AND pnl > 0) AS wins_taken,
  count(*) FILTER (prob >= 0.5 AND pnl <= 0) AS losses_taken, avg(pnl) FILTER (prob < 0.5) AS avg_skipped, count(*) FILTER (pnl > 0) AS base_wins, sum(pnl) AS base_total FROM trades GROUP BY 1
""", uses="trades", num="avg_taken total_taken avg_skipped base_total")
def _(spark, d):
    return mt.taken_vs_skipped(base.trades(spark, d), ["strategy"], "prob", "pnl", 0.5)


@query("daily_pnl_and_win_rate", "A44", """
SELECT strategy, count(*) AS days, count(*) FILTER (p > 0) / count(*) AS day_win_rate, max(n) AS busiest FROM (SELECT strategy, date, sum(pnl) AS p, count(*) AS n FROM trades GROUP BY 1, 2) GROUP BY 1
""", uses="trades", num="day_win_rate", digits=8)
def _(spark, d):
    day = base.trades(spark, d).groupBy("strategy", "date").agg(F.sum("pnl").alias("p"), F.count(F.lit(1)).alias("n"))
    return day.groupBy("strategy").agg(F.count(F.lit(1)).alias("days"), F.try_divide(F.count_if(F.col("p") > 0), F.count(F.lit(1))).alias("day_win_rate"), F.max("n").alias("busiest"))


cte("tcal", "SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM trades)", "trades")
cte("tfold", """
SELECT date, f AS fold, CASE WHEN i < 500 + f * sz THEN 'train' WHEN i < 500 + f * sz + sz THEN 'val' END AS role FROM (SELECT *, greatest(1, floor((n - 500) / 4)) AS sz FROM tcal), (SELECT unnest(range(0, 4)) AS f) WHERE 500 + f * sz + sz <= n
""", "tcal")


@query("walk_forward_folds", "W23", """
SELECT fold, role, count(*) AS rows, count(DISTINCT date) AS days, min(date) AS first_day, max(date) AS last_day FROM trades JOIN tfold USING (date) WHERE role IS NOT NULL GROUP BY 1, 2
""", uses="trades tfold", day="first_day last_day")
def _(spark, d):
    f = splits.walk_forward_folds(base.trades(spark, d), "date", 4, 500)
    per = f.withColumn("fold", F.col("fold").cast("long")).groupBy("fold", "role", "date").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("fold", "role").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("days"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))


@query("cross_fold_auc_summary", "A45 W23 A26", """
SELECT strategy, count(auc) AS folds, avg(auc) AS mean_auc, stddev_pop(auc) AS std_auc FROM (
  SELECT strategy, fold, sum(p * (below + q / 2.0)) / nullif(sum(p) * sum(q), 0) AS auc FROM (
    SELECT *, coalesce(sum(q) OVER (PARTITION BY strategy, fold ORDER BY prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (
      SELECT strategy, fold, prob, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS q FROM trades JOIN tfold USING (date) WHERE role = 'val' GROUP BY 1, 2, 3)) GROUP BY 1, 2) GROUP BY 1 HAVING avg(auc) >= 0.45
""", uses="trades tfold", num="mean_auc std_auc")
def _(spark, d):
    f = splits.walk_forward_folds(base.trades(spark, d), "date", 4, 500).where(F.col("role") == "val")
    return mt.fold_summary(mt.roc_auc(f, ["strategy", "fold"], "y", "prob"), ["strategy"], "auc", 0.45)


@query("three_way_time_split", "W24", """
SELECT coalesce(CASE WHEN i < a THEN 'train' WHEN i >= a + 7 AND i < a + 7 + floor((n - a - 14) / 2) THEN 'test' WHEN i >= a + 7 + floor((n - a - 14) / 2) + 7 THEN 'holdout' END, 'gap') AS split, count(*) AS rows, min(date) AS first_day, max(date) AS last_day
FROM trades JOIN (SELECT *, floor(n * 0.5) AS a FROM tcal) USING (date) GROUP BY 1
""", uses="trades tcal", day="first_day last_day")
def _(spark, d):
    s = splits.three_way_split(base.trades(spark, d), "date", 0.5, 7)
    return s.groupBy(F.coalesce("split", F.lit("gap")).alias("split")).agg(F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))


@query("recent_dates_test_set", "O3", """
SELECT 'last_20' AS part, count(*) AS rows, min(date) AS first_day FROM trades JOIN tcal USING (date) WHERE i >= n - 20 UNION ALL SELECT 'last_share', count(*), min(date) FROM trades JOIN tcal USING (date) WHERE i >= floor(n * CAST(0.8 AS DOUBLE))
""", uses="trades tcal", day="first_day")
def _(spark, d):
    t = base.trades(spark, d)

    def tally(x, name):
        return x.agg(F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_day")).select(F.lit(name).alias("part"), "rows", "first_day")

    return tally(splits.last_dates(t, "date", 20), "last_20").unionByName(tally(splits.last_share(t, "date", 0.2), "last_share"))


@query("expected_value_and_rank_score", "F21 A23", """
SELECT l_orderkey, t.strategy, prob * w + (1 - prob) * l - 0.35 AS ev, credit * prob AS rank_score FROM trades t JOIN (SELECT strategy, avg(pnl) FILTER (y = 1) AS w, avg(pnl) FILTER (y = 0) AS l FROM trades GROUP BY 1) p USING (strategy)
""", uses="trades", num="ev rank_score")
def _(spark, d):
    t = base.trades(spark, d)
    p = mt.win_loss_profile(t, ["strategy"], "y", "pnl")
    return t.join(p, "strategy").select("l_orderkey", "strategy", expected_value("prob", "avg_win", "avg_loss", 0.35).alias("ev"), (F.col("credit") * F.col("prob")).alias("rank_score"))


@query("half_kelly_size", "F22", """
SELECT l_orderkey, strategy, prob, CASE WHEN prob * 1.5 - (1 - prob) < 0.15 THEN 0 ELSE least(0.5 * (prob * 1.5 - (1 - prob)) / 1.5, 0.02) END AS size FROM trades
""", uses="trades", num="prob size")
def _(spark, d):
    return base.trades(spark, d).select("l_orderkey", "strategy", "prob", half_kelly("prob", F.lit(1.5), F.lit(1.0)).alias("size"))


# --- candidates and picks -----------------------------------------------------

cte("cand", """
SELECT event_id, event_type AS strategy, CAST(ts AS DATE) AS date, date_trunc('minute', ts) AS slot, date_trunc('minute', ts) + CAST(floor(value) AS INTEGER) * INTERVAL 1 MINUTE AS exit_time,
  CAST(user_id % 97 AS DOUBLE) / 97.0 + value / 10000.0 AS prob, 1.0 + value / 100.0 AS credit, CASE WHEN value > 120 THEN 'sl' WHEN value < 10 THEN 'close_loss' ELSE 'tp' END AS exit_reason, value / 50.0 AS exit_debit FROM events
""")


def candidates(spark, d):
    e = table(spark, d, "events")
    slot = F.window("ts", "1 minute").getField("start")
    v = F.col("value")
    return e.select(
        "event_id", F.col("event_type").alias("strategy"), F.col("ts").cast("date").alias("date"), slot.alias("slot"),
        (slot + F.make_dt_interval(mins=F.floor(v).cast("int"))).alias("exit_time"), ((F.col("user_id") % 97).cast("double") / 97.0 + v / 10000.0).alias("prob"),
        (1.0 + v / 100.0).alias("credit"), F.when(v > 120, "sl").when(v < 10, "close_loss").otherwise("tp").alias("exit_reason"), (v / 50.0).alias("exit_debit"),
    )


@query("top_score_per_slot", "W21 W22", """
SELECT date, slot, arg_max(event_id, (rank_score, -event_id)) AS event_id, max(rank_score) AS rank_score FROM (SELECT *, credit * prob AS rank_score FROM cand) GROUP BY 1, 2
""", uses="cand", num="rank_score", day="date", time="slot")
def _(spark, d):
    c = candidates(spark, d).withColumn("rank_score", F.col("credit") * F.col("prob"))
    return sel.top_per_slot(c, ["date", "slot"], "rank_score", "event_id", ["event_id"])


@query("best_level_per_strategy", "W22 O10", """
SELECT strategy, event_id, level, ev FROM (SELECT *, row_number() OVER (PARTITION BY strategy, event_id ORDER BY ev DESC, level) AS rn FROM (
  SELECT strategy, event_id, unnest(['tp10', 'tp25', 'tp50']) AS level, unnest([prob * 0.1 * credit - (1 - prob) * 0.05, prob * 0.25 * credit - (1 - prob) * 0.4, prob * 0.5 * credit - (1 - prob)]) AS ev FROM cand)) WHERE rn = 1
""", uses="cand", num="ev")
def _(spark, d):
    p, c = F.col("prob"), F.col("credit")
    x = candidates(spark, d).withColumns({"ev_tp10": p * 0.1 * c - (1 - p) * 0.05, "ev_tp25": p * 0.25 * c - (1 - p) * 0.4, "ev_tp50": p * 0.5 * c - (1 - p)})
    long = sel.explode_levels(x, ["strategy", "event_id"], ["tp10", "tp25", "tp50"], {"ev": "ev_{}"})
    return sel.top_per_slot(long, ["strategy", "event_id"], "ev", "level", ["level"])


cte("pool", """
SELECT c.*, coalesce(prob * w + (1 - prob) * l - 0.1, 0.0) AS ev, strategy = 'view' AS is_shadow FROM cand c LEFT JOIN (SELECT strategy, avg(credit - exit_debit) FILTER (exit_reason = 'tp') AS w, avg(credit - exit_debit) FILTER (exit_reason <> 'tp') AS l FROM cand GROUP BY 1) USING (strategy)
WHERE dayofweek(date) <> 1 AND (strategy = 'view' OR prob * w + (1 - prob) * l - 0.1 > 0)
""", "cand")


@query("candidate_pool", "L7 P14 O10", "SELECT event_id, strategy, ev, CAST(is_shadow AS BIGINT) AS is_shadow FROM pool", uses="pool", num="ev", digits=7)
def _(spark, d):
    c = candidates(spark, d).withColumn("y", (F.col("exit_reason") == "tp").cast("int")).withColumn("pnl", F.col("credit") - F.col("exit_debit"))
    prof = mt.win_loss_profile(c, ["strategy"], "y", "pnl")
    x = c.withColumn("blocked", F.dayofweek("date") == 2)
    return sel.candidate_pool(x, prof, ["strategy"], 0.1, F.col("strategy") == "view").select("event_id", "strategy", "ev", F.col("is_shadow").cast("long").alias("is_shadow"))


cte("gated", f"""
SELECT c.*, q.r AS skip_rate FROM cand c JOIN (SELECT strategy, r, {_q} AS cut FROM (SELECT strategy, list(prob ORDER BY prob) AS l FROM cand GROUP BY 1), (SELECT unnest([CAST(0.2 AS DOUBLE), 0.5, 0.8]) AS r)) q USING (strategy) WHERE c.prob >= q.cut
""", "cand")


@query("quantile_gate", "L9 A31", "SELECT skip_rate, strategy, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS checksum FROM gated GROUP BY 1, 2", uses="gated", num="skip_rate")
def _(spark, d):
    g = sel.gate_by_skip_rate(candidates(spark, d), ["strategy"], "prob", [0.2, 0.5, 0.8])
    return g.groupBy("skip_rate", "strategy").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("checksum"))


def picks(spark, d, locks: bool):
    g = sel.gate_by_skip_rate(candidates(spark, d), ["strategy"], "prob", [0.2, 0.5, 0.8]).withColumn("rank_score", F.col("credit") * F.col("prob"))
    top = sel.top_per_slot(g, ["skip_rate", "date", "slot"], "rank_score", "event_id", ["event_id", "strategy", "exit_time", "exit_reason", "credit", "exit_debit"])
    return sel.non_overlapping(
        top, ["skip_rate", "date"], "slot", "exit_time", ["slot", "event_id", "strategy", "exit_time", "exit_reason", "credit", "exit_debit"],
        F.col("exit_reason").isin("sl", "close_loss"), F.col("strategy") == "view", locks,
    )


def _walk(lock: bool) -> str:
    hold = "true" if lock else "n.strategy <> 'view'"
    return f"""
WITH RECURSIVE {{ctes}}
top AS (SELECT *, row_number() OVER (PARTITION BY skip_rate, date ORDER BY slot) AS k FROM (SELECT skip_rate, date, slot, unnest(arg_max(c, (credit * prob, -event_id))) FROM (
  SELECT skip_rate, date, slot, credit, prob, event_id, {{{{'event_id': event_id, 'strategy': strategy, 'exit_time': exit_time, 'exit_reason': exit_reason, 'credit': credit, 'exit_debit': exit_debit}}}} AS c FROM gated) GROUP BY 1, 2, 3)),
walk AS (
  SELECT skip_rate, date, CAST(0 AS BIGINT) AS k, TIMESTAMP '1900-01-01' AS free, false AS done, false AS pick FROM (SELECT DISTINCT skip_rate, date FROM top)
  UNION ALL SELECT n.skip_rate, n.date, n.k, CASE WHEN NOT w.done AND n.slot >= w.free AND {hold} THEN n.exit_time ELSE w.free END, w.done OR (n.slot >= w.free AND {hold} AND n.exit_reason IN ('sl', 'close_loss')), NOT w.done AND n.slot >= w.free
  FROM walk w JOIN top n ON n.skip_rate = w.skip_rate AND n.date = w.date AND n.k = w.k + 1)
"""


def _chain_sql(lock: bool, tail: str, num: list[str], digits: int = 6) -> str:
    """Recursive CTEs need their own WITH clause, so these queries are assembled whole."""
    parts = ",\n".join(f"{n} AS ({base.CTES[n][0]})" for n in ("cand", "gated")) + ","
    head = _walk(lock).replace("{ctes}", parts).replace("{{", "{").replace("}}", "}")
    swaps = ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in num)
    return f"{head} SELECT * REPLACE ({swaps}) FROM ({tail})"


_TAIL = "SELECT t.skip_rate, strftime(t.date, '%Y-%m-%d') AS date, strftime(t.slot, '%Y-%m-%d %H:%M:%S.%f') AS slot, t.event_id, t.strategy, CAST(t.strategy = 'view' AS BIGINT) AS passive FROM top t JOIN walk w USING (skip_rate, date, k) WHERE w.pick"


def _register_picks() -> None:
    for name, lock in (("non_overlapping_picks", False), ("non_overlapping_picks_locked", True)):
        def run(spark, d, lock=lock):
            return picks(spark, d, lock).select("skip_rate", "date", "slot", "event_id", "strategy", F.col("passive").cast("long").alias("passive"))

        query(name, "L8 W21", None, num="skip_rate", day="date", time="slot")(run)
        e = base.REGISTRY[name]
        base.REGISTRY[name] = base.Entry(name, e.ids, e.run, _chain_sql(lock, _TAIL, ["skip_rate"]))


_register_picks()

_PNL = """SELECT skip_rate, strftime(date, '%Y-%m-%d') AS date, p AS pnl, 10000 + sum(p) OVER (PARTITION BY skip_rate ORDER BY date) AS portfolio FROM (
  SELECT t.skip_rate, t.date, sum(CASE WHEN t.strategy = 'view' THEN 0 ELSE (t.credit - t.exit_debit - 0.1 - 0.0052) * 100 END) AS p FROM top t JOIN walk w USING (skip_rate, date, k) WHERE w.pick GROUP BY 1, 2)"""


@query("picked_trade_pnl", "L10 A44", None, num="skip_rate pnl portfolio", day="date")
def _(spark, d):
    p = picks(spark, d, False)
    _, total = sel.trade_pnl(F.col("credit"), F.col("exit_debit"), 0.1, 0.0052)
    day = p.groupBy("skip_rate", "date").agg(F.sum(F.when(F.col("passive"), 0.0).otherwise(total)).alias("pnl"))
    return sel.running_portfolio(day, ["skip_rate"], "date", "pnl", 10_000.0).select("skip_rate", "date", "pnl", "portfolio")


_e = base.REGISTRY["picked_trade_pnl"]
base.REGISTRY["picked_trade_pnl"] = base.Entry(_e.name, _e.ids, _e.run, _chain_sql(False, _PNL, ["skip_rate", "pnl", "portfolio"]))


@query("should_exit_now", "L6", """
SELECT p.sym, p.bar, CAST(160.0 - p.close > 160.0 - f.fin AS BIGINT) AS should_exit, CASE WHEN n.nxt IS NOT NULL THEN CAST(n.nxt - p.close > 0.15 * 160.0 AS BIGINT) END AS adverse_move
FROM bars5 p JOIN (SELECT sym, d, arg_max(close, bar) AS fin FROM bars5 GROUP BY 1, 2) f USING (sym, d)
LEFT JOIN (SELECT sym, bar, max(close) OVER (PARTITION BY sym, d ORDER BY bar RANGE BETWEEN INTERVAL 1 MICROSECOND FOLLOWING AND INTERVAL 15 MINUTE FOLLOWING) AS nxt FROM bars5) n USING (sym, bar)
""", uses="bars5", time="bar")
def _(spark, d):
    from strikeline.operators.exits import exit_labels

    b = base.bars5(spark, d).withColumn("credit", F.lit(160.0))
    return exit_labels(b, ["sym", "d"], "bar", "close", "credit", minutes=15).select("sym", "bar", "should_exit", "adverse_move")
