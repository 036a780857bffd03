"""Candidate pools, gating and non-overlapping picks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strikeline.functions.scalar import expected_value
from strikeline.operators.radix import exact_quantiles


def explode_levels(df: DataFrame, keep: Sequence[str], levels: Sequence[str], fields: Mapping[str, str]) -> DataFrame:
    """Wide per-level columns to one row per level; ``fields`` maps output to a name pattern."""
    rows = [
        F.struct(F.lit(lv).alias("level"), *[F.col(pat.format(lv)).alias(out) for out, pat in fields.items()]) for lv in levels
    ]
    return df.select(*keep, F.explode(F.array(*rows)).alias("_r")).select(*keep, "_r.*")


def candidate_pool(scored: DataFrame, profile: DataFrame, keys: Sequence[str], cost: float, shadow: Column) -> DataFrame:
    """Unblocked candidates with positive expected value; shadow rows skip the value test.

    ``profile`` (a row per key from a grouped aggregate) is joined by key with no
    hint; the planner broadcasts it when it is small.
    """
    x = scored.where(~F.coalesce(F.col("blocked"), F.lit(False)) & F.col("credit").isNotNull() & F.col("prob").isNotNull() & F.col("exit_time").isNotNull() & F.col("exit_debit").isNotNull())
    x = x.join(profile.select(*keys, "avg_win", "avg_loss"), list(keys), "left")
    x = x.withColumn("ev", expected_value("prob", "avg_win", "avg_loss", cost)).withColumn("is_shadow", shadow)
    return x.where(F.col("is_shadow") | (F.col("ev") > 0)).withColumn("ev", F.coalesce("ev", F.lit(0.0))).drop("avg_win", "avg_loss")


def gate_by_skip_rate(df: DataFrame, keys: Sequence[str], score: str, rates: Sequence[float], cutoffs_from: DataFrame | None = None) -> DataFrame:
    """Rows that pass their group's quantile cutoff, once per skip rate.

    Cutoffs come from the rows themselves or from a training table.
    """
    cuts = exact_quantiles(df if cutoffs_from is None else cutoffs_from, keys, score, rates, out="_cuts").select(*keys, "_cuts")
    x = df.join(cuts, list(keys), "inner")
    passed = F.array_compact(F.array(*[F.when(F.col(score) >= F.col("_cuts")[i], F.lit(float(r))) for i, r in enumerate(rates)]))
    return x.withColumn("skip_rate", F.explode(passed)).drop("_cuts")


def top_per_slot(df: DataFrame, slot: Sequence[str], score: str, tie: str, take: Sequence[str]) -> DataFrame:
    """Highest score per slot, first by the tie column; reduced on the map side."""
    best = df.groupBy(*slot).agg(F.min(F.struct((-F.col(score)).alias("_s"), F.col(tie), *[F.col(c) for c in take if c != tie])).alias("_m"))
    return best.select(*slot, (-F.col("_m._s")).alias(score), F.col(f"_m.{tie}").alias(tie), *[F.col(f"_m.{c}").alias(c) for c in take if c != tie])


def non_overlapping(
    slots: DataFrame, group: Sequence[str], start: str, end: str, take: Sequence[str],
    stop_after: Column | None = None, passive: Column | None = None, passive_locks: bool = False,
) -> DataFrame:
    """Walk each group's slots in time, holding one position at a time.

    The next pick starts at or after the previous exit. A picked row for which
    ``stop_after`` holds ends the group. ``passive`` rows are recorded but not
    traded: they leave the position free, or hold it as well if ``passive_locks``.
    Input must hold one row per group and slot (see ``top_per_slot``), which
    bounds a group by the number of slots in a session.
    """
    no = F.lit(False)
    row = F.struct(
        F.col(start).alias("s"), F.col(end).alias("e"), F.coalesce(stop_after if stop_after is not None else no, no).alias("stop"),
        F.coalesce(passive if passive is not None else no, no).alias("idle"), F.struct(*[F.col(c) for c in take]).alias("row"),
    )
    days = slots.groupBy(*group).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    kind = slots.schema[start].dataType
    flags = F.transform(F.col("_rows"), lambda r: F.struct(r.s.alias("s"), r.e.alias("e"), r.stop.alias("stop"), r.idle.alias("idle")))
    zero = F.struct(F.lit(None).cast(kind).alias("free"), F.lit(False).alias("done"), F.array().cast("array<boolean>").alias("picks"))

    def step(acc: Column, r: Column) -> Column:
        ok = ~acc.done & (acc.free.isNull() | (r.s >= acc.free))
        holds = ok if passive_locks else ok & ~r.idle
        return F.struct(
            F.when(holds, r.e).otherwise(acc.free).alias("free"),
            (acc.done | (holds & r.stop)).alias("done"),
            F.concat(acc.picks, F.array(ok)).alias("picks"),
        )

    taken = days.withColumn("_p", F.aggregate(flags, zero, step, lambda a: a.picks))
    pairs = taken.select(*group, F.explode(F.arrays_zip(F.col("_rows").alias("r"), F.col("_p").alias("p"))).alias("_z"))
    return pairs.where(F.col("_z.p")).select(*group, "_z.r.row.*", F.col("_z.r.idle").alias("passive"))


def trade_pnl(credit: Column, debit: Column, slip: float, fees: float, qty: int = 1) -> tuple[Column, Column]:
    share = credit - debit - F.lit(slip) - F.lit(fees)
    return share, share * 100.0 * qty


def running_portfolio(daily: DataFrame, keys: Sequence[str], date: str, pnl: str, start: float) -> DataFrame:
    """Portfolio value and drawdown after each day."""
    w = W.partitionBy(*keys).orderBy(date).rowsBetween(W.unboundedPreceding, 0)
    x = daily.withColumn("portfolio", F.lit(start) + F.sum(pnl).over(w))
    peak = F.greatest(F.lit(start), F.max("portfolio").over(w))
    return x.withColumn("drawdown", F.try_divide(peak - F.col("portfolio"), peak))
