"""Evaluation metrics and threshold sweeps as mergeable aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strikeline.functions.scalar import div
from strikeline.operators.radix import exact_quantiles, with_value_slice
from strikeline.operators.slicing import exclusive_prefix


def _n(cond: Column) -> Column:
    return F.count_if(cond)


def roc_auc(df: DataFrame, keys: Sequence[str], label: str, score: str, most: int = 500_000, weight: str | None = None) -> DataFrame:
    """Area under the ROC curve per group, NULL when only one class is present. A row stands for ``weight`` rows.

    Scores are counted per distinct value, then negatives below each value come
    from running sums over slices of about ``most`` values, so no group is ranked in a single task.
    """
    y = F.col(label) == 1
    n = _n if weight is None else lambda cond: F.sum(F.when(cond, F.col(weight)).otherwise(0))
    counts = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*keys, score).agg(
        n(y).alias("_p"), n(~y).alias("_q")
    )
    ranked = exclusive_prefix(with_value_slice(counts, keys, score, most), keys, [score], {"_below": "_q"})
    return ranked.groupBy(*keys).agg(
        F.sum(F.col("_p") + F.col("_q")).alias("rows"), F.sum("_p").alias("positives"),
        div(F.sum(F.col("_p") * (F.col("_below") + F.col("_q") / 2.0)), F.sum("_p") * F.sum("_q")).alias("auc"),
    )


def group_table(df: DataFrame, keys: Sequence[str], label: str, score: str) -> DataFrame:
    a = roc_auc(df, keys, label, score)
    return a.withColumn("win_rate", div("positives", "rows"))


def level_grid(df: DataFrame, keys: Sequence[str], label: str, score: str, pnl: str, threshold: float = 0.5, min_rows: int = 30, min_trades: int = 10) -> DataFrame:
    """Per cell: AUC, win rate and EV of all rows and of those the model takes, lifts and total.

    Cells with fewer than ``min_rows`` rows or ``min_trades`` taken are left out, as the report this feeds does.
    """
    taken = F.col(score) >= threshold
    y, p = F.col(label).cast("double"), F.col(pnl)
    cells = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("base_wr"), F.avg(p).alias("base_ev"), _n(taken).alias("trades"),
        F.avg(F.when(taken, y)).alias("model_wr"), F.avg(F.when(taken, p)).alias("model_ev"), F.sum(F.when(taken, p)).alias("total_pnl"),
    ).where((F.col("n") >= min_rows) & (F.col("trades") >= min_trades))
    auc = roc_auc(df, keys, label, score).select(*[F.col(k).alias(f"_{k}") for k in keys], "auc")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    out = cells.join(auc, same, "left").drop(*[f"_{k}" for k in keys])
    return out.withColumns({"wr_lift": F.col("model_wr") - F.col("base_wr"), "ev_lift": F.col("model_ev") - F.col("base_ev")})


def extremes(df: DataFrame, by: str, ties: Sequence[str], n: int = 5) -> DataFrame:
    """The ``n`` best and worst rows of a small report."""
    best = df.orderBy(F.desc(by), *ties).limit(n).withColumn("side", F.lit("best"))
    return best.unionByName(df.orderBy(F.asc(by), *ties).limit(n).withColumn("side", F.lit("worst")))


def confusion(df: DataFrame, keys: Sequence[str], label: str, score: str, threshold: float) -> DataFrame:
    """Confusion counts with accuracy, precision, recall and F1 (0 when undefined)."""
    y, p = F.col(label) == 1, F.col(score) >= threshold
    c = df.groupBy(*keys).agg(
        _n(y & p).alias("tp"), _n(~y & p).alias("fp"), _n(y & ~p).alias("fn"), _n(~y & ~p).alias("tn")
    )
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))

    def zero(e: Column) -> Column:
        return F.coalesce(e, F.lit(0.0))

    return c.select(
        *keys, "tp", "fp", "fn", "tn", div(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        zero(div(tp, tp + fp)).alias("precision"), zero(div(tp, tp + fn)).alias("recall"),
        zero(div(2.0 * tp, 2.0 * tp + fp + fn)).alias("f1"),
    )


def threshold_sweep(df: DataFrame, keys: Sequence[str], label: str, score: str, thresholds: Sequence[float]) -> DataFrame:
    """Trades, win rate, recall and skip rate at each threshold, in one scan.

    Every threshold is a pair of conditional counts; rows are never multiplied.
    """
    y = F.col(label) == 1
    aggs = [F.count(F.lit(1)).alias("_n"), _n(y).alias("_y")]
    for i, t in enumerate(thresholds):
        hit = F.col(score) >= F.lit(float(t))
        aggs += [_n(hit).alias(f"_t{i}"), _n(hit & y).alias(f"_w{i}")]
    one = df.groupBy(*keys).agg(*aggs)
    points = F.array(
        *[
            F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_t{i}").alias("trades"), F.col(f"_w{i}").alias("_w"))
            for i, t in enumerate(thresholds)
        ]
    )
    x = one.select(*keys, "_n", "_y", F.explode(points).alias("_p")).where(F.col("_p.trades") > 0)
    return x.select(
        *keys, "_p.threshold", "_p.trades", div("_p._w", "_p.trades").alias("win_rate"),
        div("_p._w", "_y").alias("recall"), (1.0 - div("_p.trades", "_n")).alias("skip_rate"),
    )


def calibration(df: DataFrame, keys: Sequence[str], label: str, score: str, bins: int = 5) -> DataFrame:
    """Mean score against actual rate in equal-width bins of [0, 1]; a score of exactly 1 falls into the last bin."""
    b = F.least(F.floor(F.col(score) * bins).cast("long"), F.lit(bins - 1).cast("long"))
    return df.where((F.col(score) >= 0) & (F.col(score) <= 1)).groupBy(*keys, b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("avg_score"), F.avg(F.col(label).cast("double")).alias("actual")
    )


def skip_rate_sweep(
    df: DataFrame, keys: Sequence[str], label: str, score: str, pnl: str, rates: Sequence[float], min_trades: int = 50
) -> DataFrame:
    """Effect of skipping the lowest-scored share: win rate, EV and lift over taking all.

    Cutoffs are exact quantiles per group; the sweep is conditional aggregates
    over one scan. The cutoffs (a row per group) are sent to the rows, since a join by
    shuffle would put a group into one task.
    """
    on = list(keys)
    cuts = exact_quantiles(df, on, score, rates, out="_cuts").select(*on, "_cuts")
    x = df.join(F.broadcast(cuts), on, "left") if on else df.withColumn("_cuts", cuts.scalar())
    aggs = [F.count(F.lit(1)).alias("n_total"), F.avg(F.col(label).cast("double")).alias("_wr"), F.avg(pnl).alias("_ev"), F.first("_cuts").alias("_cuts")]
    for i in range(len(rates)):
        hit = F.col(score) >= F.col("_cuts")[i]
        aggs += [
            _n(hit).alias(f"_n{i}"), F.avg(F.when(hit, F.col(label).cast("double"))).alias(f"_w{i}"),
            F.avg(F.when(hit, F.col(pnl))).alias(f"_e{i}"), F.sum(F.when(hit, F.col(pnl))).alias(f"_s{i}"),
        ]
    one = x.groupBy(*on).agg(*aggs)
    points = F.array(
        *[
            F.struct(
                F.lit(float(r)).alias("target_skip"), F.col("_cuts")[i].alias("cutoff"), F.col(f"_n{i}").alias("n_trades"),
                F.col(f"_w{i}").alias("win_rate"), F.col(f"_e{i}").alias("ev_per_trade"), F.col(f"_s{i}").alias("total_pnl"),
            )
            for i, r in enumerate(rates)
        ]
    )
    y = one.select(*on, "n_total", "_wr", "_ev", F.explode(points).alias("_p")).where(F.col("_p.n_trades") >= min_trades)
    return y.select(
        *keys, "_p.target_skip", "_p.cutoff", "n_total", "_p.n_trades",
        (F.lit(1.0) - div("_p.n_trades", "n_total")).alias("skip_rate"), "_p.win_rate",
        (F.col("_p.win_rate") - F.col("_wr")).alias("win_rate_lift"), "_p.ev_per_trade",
        (F.col("_p.ev_per_trade") - F.col("_ev")).alias("ev_lift"), "_p.total_pnl",
    )


def win_loss_profile(df: DataFrame, keys: Sequence[str], label: str, pnl: str) -> DataFrame:
    """Mean win, mean loss and win rate; groups need both classes."""
    y = F.col(label)
    return df.groupBy(*keys).agg(
        F.avg(F.when(y == 1, F.col(pnl))).alias("avg_win"), F.avg(F.when(y == 0, F.col(pnl))).alias("avg_loss"),
        div(_n(y == 1), F.count(F.lit(1))).alias("win_rate"),
    ).where(F.col("avg_win").isNotNull() & F.col("avg_loss").isNotNull())


def trade_stats(df: DataFrame, keys: Sequence[str], pnl: str, reason: str, reasons: Sequence[str], median: bool = True) -> DataFrame:
    """Count, win share, mean, extremes, profit factor and exit mix per group."""
    p = F.col(pnl)
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"), div(_n(p > 0), F.count(F.lit(1))).alias("win_rate"),
        F.avg(p).alias("avg_pnl"), F.max(p).alias("max_pnl"), F.min(p).alias("min_pnl"), F.sum(p).alias("total_pnl"),
        div(F.sum(F.when(p > 0, p)), -F.sum(F.when(p < 0, p))).alias("profit_factor"),
        *[_n(F.col(reason) == r).alias(f"n_{r}") for r in reasons],
    )
    if not median:
        return out
    med = exact_quantiles(df, keys, pnl, [0.5]).select(*keys, F.col("quantiles")[0].alias("median_pnl"))
    return out.join(med, list(keys), "left")


def equity_stats(daily: DataFrame, keys: Sequence[str], date: str, pnl: str, start: float = 10_000.0) -> DataFrame:
    """Return, maximum drawdown and annualised Sharpe of a daily P&L series.

    Input holds one row per day, so the running windows are bounded by the calendar.
    """
    w = W.partitionBy(*keys).orderBy(date)
    cum = w.rowsBetween(W.unboundedPreceding, 0)
    eq = daily.withColumn("_e", F.lit(start) + F.sum(pnl).over(cum))
    eq = eq.withColumn("_peak", F.greatest(F.lit(start), F.max("_e").over(cum))).withColumn("_prev", F.lag("_e", 1, start).over(w))
    ret = F.when(F.col("_prev") > 0, div(F.col("_e") - F.col("_prev"), "_prev"))
    return eq.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("days"), ((F.max_by("_e", date) - start) / start * 100.0).alias("total_return_pct"),
        (F.max(div(F.col("_peak") - F.col("_e"), "_peak")) * 100.0).alias("max_drawdown_pct"),
        F.coalesce(div(F.avg(ret), F.stddev_pop(ret)) * F.sqrt(F.lit(252.0)), F.lit(0.0)).alias("sharpe"),
    )


def model_vote(df: DataFrame, keys: Sequence[str], score: str, soft: str, need: int = 3, hard: float = 0.55, softened: float = 0.70) -> DataFrame:
    """TRADE / SIZE_DOWN / SKIP / NO_MODEL from how many model scores pass the bar."""
    limit = F.when(F.col(soft), F.lit(softened)).otherwise(F.lit(hard))
    v = df.groupBy(*keys).agg(
        F.count(score).alias("models"), _n(F.col(score) >= limit).alias("votes"), F.max(soft).alias("_soft"), F.avg(score).alias("avg_score")
    )
    signal = F.when(F.col("models") == 0, "NO_MODEL").when(F.col("votes") < need, "SKIP").when(F.col("_soft"), "SIZE_DOWN").otherwise("TRADE")
    return v.select(*keys, "models", "votes", "avg_score", signal.alias("signal"))


def taken_vs_skipped(df: DataFrame, keys: Sequence[str], score: str, pnl: str, threshold: float) -> DataFrame:
    """P&L of the rows at or above the threshold, of the rest, and of everything."""
    taken = F.col(score) >= threshold
    p = F.col(pnl)
    return df.groupBy(*keys).agg(
        _n(taken).alias("n_taken"), _n(~taken).alias("n_skipped"),
        F.avg(F.when(taken, p)).alias("avg_taken"), F.sum(F.when(taken, p)).alias("total_taken"),
        _n(taken & (p > 0)).alias("wins_taken"), _n(taken & (p <= 0)).alias("losses_taken"),
        F.avg(F.when(~taken, p)).alias("avg_skipped"), _n(p > 0).alias("base_wins"), F.sum(p).alias("base_total"),
    )


def class_weight(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Negatives over positives."""
    return df.groupBy(*keys).agg(div(_n(F.col(label) == 0), _n(F.col(label) == 1)).alias("scale_pos_weight"))


def fold_summary(folds: DataFrame, keys: Sequence[str], auc: str, keep_from: float = 0.60) -> DataFrame:
    """Mean and spread of fold scores, kept only for models at or above the bar."""
    return folds.groupBy(*keys).agg(
        F.count(auc).alias("folds"), F.avg(auc).alias("mean_auc"), F.stddev_pop(auc).alias("std_auc")
    ).where(F.col("mean_auc") >= keep_from)
