"""First-touch outcomes of every spine row for nine take-profit levels."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikeline.operators.barrier import race
from strikeline.operators.clean import minutes
from strikeline.functions.scalar import minute_of_day
from strikeline.plans.spine import LEGS
from strikeline.plans.strategies import STOP_MULTIPLE, TP_LEVELS

FIELDS = ("target", "exit_reason", "exit_time", "exit_debit", "pnl")
SIGNS = {"short_call": ("call", 1.0), "short_put": ("put", 1.0), "long_call": ("call", -1.0), "long_put": ("put", -1.0)}


def close_times(state: DataFrame, day: Sequence[str], close: str, fallback: bool = True) -> DataFrame:
    """The closing minute of each day; its last minute when that one is missing, if allowed."""
    t = F.col("decision_datetime")
    if not fallback:
        at = F.date_trunc("day", F.min(t)).cast("timestamp_ntz") + F.make_dt_interval(mins=F.lit(minutes(close)))
        return state.groupBy(*day).agg(at.alias("_close"))
    at = (minute_of_day(t) == minutes(close)) & (F.second(t) == 0)
    return state.groupBy(*day).agg(F.coalesce(F.max(F.when(at, t)), F.max(t)).alias("_close"))


def combo_paths(spine: DataFrame, state: DataFrame, day: Sequence[str]) -> DataFrame:
    """One row per day and distinct leg combination: its debits in time order, as an array.

    Entries sharing their four strikes share one path. A minute's mids are two maps from strike to
    value, so a leg is a look-up and not a join; minutes with a missing leg are left out. A path is at
    most one session of minutes.
    """
    def mids(s: str) -> Column:
        return F.map_from_entries(F.collect_list(F.when(F.col(f"{s}_mid_close").isNotNull(), F.struct("strike", f"{s}_mid_close")))).alias(f"_{s}")

    quotes = state.groupBy(*day, "decision_datetime").agg(mids("call"), mids("put"))
    debit = sum((F.col(f"_{s}")[F.col(c)] * F.lit(g) for c, (s, g) in SIGNS.items()), F.lit(0.0))
    points = spine.select(*day, *LEGS).distinct().join(quotes, day).select(*day, *LEGS, F.struct(F.col("decision_datetime").alias("t"), debit.alias("v")).alias("_p"))
    return points.where(F.col("_p.v").isNotNull()).groupBy(*day, *LEGS).agg(F.sort_array(F.collect_list("_p")).alias("_path"))


def build_outcomes(
    spine: DataFrame, state: DataFrame, keys: Sequence[str] = (), close: str = "15:00",
    levels: Sequence[float] = TP_LEVELS, stop: float = STOP_MULTIPLE, long_form: bool = False, fallback_close: bool = True,
) -> DataFrame:
    """Spine plus tp<level>_{target,exit_reason,exit_time,exit_debit,pnl}.

    Every entry meets its path once and resolves all its levels inside the row. Paths over
    raw ticks, which can be far longer than a session, go through ``barrier.first_touch``.
    """
    day = [*keys, "date"]
    tag = {lv: f"tp{round(lv * 100)}" for lv in levels}
    credit, t = F.col("credit"), F.col("decision_datetime")
    both = spine.join(close_times(state, day, close, fallback_close), day, "left").join(combo_paths(spine, state, day), [*day, *LEGS], "left")
    ahead = F.filter("_path", lambda p: (p["t"] > t) & (p["t"] <= F.col("_close")))
    both = both.select(*spine.columns, ahead.alias("_ahead"))

    def first(reached: Callable[[Column], Column]) -> Column:
        return F.get(F.filter("_ahead", lambda p: reached(p["v"])), 0)

    hit = {"_sl": first(lambda v: v >= credit * F.lit(stop))} | {f"_{n}": first(lambda v, lv=lv: v <= credit * F.lit(1.0 - lv)) for lv, n in tag.items()}
    both = both.select(*spine.columns, *[e.alias(n) for n, e in hit.items()], F.get("_ahead", F.size("_ahead") - 1).alias("_last"))

    def pair(c: str) -> tuple[Column, Column]:
        return F.col(f"{c}.t"), F.col(f"{c}.v")

    spare = F.timestamp_diff("MINUTE", t, F.col("_last.t")).alias("time_to_close_min")
    keep = [*spine.columns, spare] if not fallback_close else list(spine.columns)
    results = {n: race(credit, pair("_sl"), pair(f"_{n}"), pair("_last")) for n in tag.values()}
    if long_form:
        rows = [F.struct(F.lit(lv).alias("tp"), *[results[n][f].alias(f) for f in FIELDS]) for lv, n in tag.items()]
        return both.select(*keep, F.explode(F.array(*rows)).alias("_o")).select("*", "_o.*").drop("_o")
    return both.select(*keep, *[results[n][f].alias(f"{n}_{f}") for n in tag.values() for f in FIELDS])
