"""Four-leg selection for every decision minute and strategy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikeline.operators.clean import in_session
from strikeline.operators.dedup import keep_one
from strikeline.plans.strategies import STRATEGIES

LEGS = ("short_call", "short_put", "long_call", "long_put")


def _closest(ladder: Column, ok, dist, extra, prefer_higher: bool = False) -> Column:  # noqa: ANN001
    """Least-distance rung as a struct; ties go to the lower strike unless asked."""
    def row(x: Column) -> Column:
        side = -x.strike if prefer_higher else x.strike
        return F.struct(dist(x).alias("dist"), side.alias("side"), x.strike.alias("strike"), *extra(x))

    return F.array_min(F.transform(F.filter(ladder, ok), row))


def build_spine(
    state: DataFrame, keys: Sequence[str] = (), start: str = "10:00", end: str = "15:00",
    strategies: Sequence[tuple[str, float, float]] = STRATEGIES, wing_tolerance: float = 10.0, min_quotes: int = 0, dedup: bool = True,
) -> DataFrame:
    """Short legs nearest the target deltas, long legs nearest the wings, positive credit.

    A minute's ladder (at most the listed strikes) is gathered once, then every
    strategy is resolved inside the row: one shuffle of the state in total. Equal
    combinations of one minute keep the highest target delta unless ``dedup`` is off.
    ``min_quotes`` skips minutes with fewer call and put quotes.
    """
    x = state.where(in_session("decision_datetime", start, end) & F.col("spx_close").isNotNull())
    rung = F.struct(
        F.col("strike"), F.col("call_bid_close").alias("cb"), F.col("put_bid_close").alias("pb"),
        F.col("call_mid_close").alias("cm"), F.col("put_mid_close").alias("pm"), F.col("call_delta").alias("cd"),
        F.col("put_delta").alias("pd"), F.col("call_implied_vol").alias("civ"), F.col("put_implied_vol").alias("piv"),
    )
    minute = [*keys, "decision_datetime", "date"]
    rows = x.groupBy(*minute).agg(F.max("spx_close").alias("spx_prev_min_close"), F.array_sort(F.collect_list(rung)).alias("_l"), (F.count("call_mid_close") + F.count("put_mid_close")).alias("_q"))
    rows = rows.where(F.col("_q") >= min_quotes).drop("_q") if min_quotes else rows.drop("_q")
    grid = F.array(*[F.struct(F.lit(n).alias("strategy"), F.lit(d).alias("delta"), F.lit(w).alias("wing")) for n, d, w in strategies])
    ladder = F.col("_l")

    def shorts(st: Column) -> Column:
        call = _closest(ladder, lambda r: (r.cd > 0) & (r.cd < 1) & (r.cb > 0), lambda r: F.abs(r.cd - st.delta),
                        lambda r: [r.cm.alias("mid"), r.cd.alias("delta"), r.civ.alias("iv")])
        put = _closest(ladder, lambda r: (r.pd < 0) & (r.pd > -1) & (r.pb > 0), lambda r: F.abs(r.pd + st.delta),
                       lambda r: [r.pm.alias("mid"), r.pd.alias("delta"), r.piv.alias("iv")])
        return F.struct(st.strategy.alias("strategy"), st.delta.alias("delta"), st.wing.alias("wing"), call.alias("sc"), put.alias("sp"))

    # explode keeps each pick a plain attribute, so later filters do not evaluate the search again
    y = rows.select(*minute, "spx_prev_min_close", "_l", F.explode(F.transform(grid, shorts)).alias("_st"))
    y = y.where((F.col("_st.sp.strike") < F.col("spx_prev_min_close")) & (F.col("spx_prev_min_close") < F.col("_st.sc.strike")))
    long_call = _closest(ladder, lambda r: r.cb > 0, lambda r: F.abs(r.strike - (F.col("_st.sc.strike") + F.col("_st.wing"))), lambda r: [r.cm.alias("mid")], True)
    long_put = _closest(ladder, lambda r: r.pb > 0, lambda r: F.abs(r.strike - (F.col("_st.sp.strike") - F.col("_st.wing"))), lambda r: [r.pm.alias("mid")], True)
    y = y.select(*minute, "spx_prev_min_close", "_st", F.explode(F.array(F.struct(long_call.alias("lc"), long_put.alias("lp")))).alias("_w"))
    y = y.where((F.col("_w.lc.dist") <= wing_tolerance) & (F.col("_w.lp.dist") <= wing_tolerance))
    y = y.select(*minute, "spx_prev_min_close", "_st", F.col("_st.sc").alias("_sc"), F.col("_st.sp").alias("_sp"), F.col("_w.lc").alias("_lc"), F.col("_w.lp").alias("_lp"))
    credit = F.col("_sc.mid") + F.col("_sp.mid") - F.col("_lc.mid") - F.col("_lp.mid")
    z = y.select(
        *minute, F.col("_st.strategy").alias("strategy"), F.col("_st.delta").alias("_target"), "spx_prev_min_close",
        F.col("_sc.strike").alias("short_call"), F.col("_sp.strike").alias("short_put"),
        F.col("_lc.strike").alias("long_call"), F.col("_lp.strike").alias("long_put"),
        (F.col("_lc.strike") - F.col("_sc.strike")).alias("call_wing_width"), (F.col("_sp.strike") - F.col("_lp.strike")).alias("put_wing_width"),
        F.col("_sc.delta").alias("sc_delta"), F.col("_sp.delta").alias("sp_delta"), F.col("_sc.iv").alias("sc_iv"), F.col("_sp.iv").alias("sp_iv"),
        credit.alias("_credit"),
    ).where((F.col("call_wing_width") > 0) & (F.col("put_wing_width") > 0) & (F.col("_credit") > 0))
    z = z.withColumn("credit", F.round("_credit", 4)).drop("_credit")
    return (keep_one(z, [*minute, *LEGS], ["_target"], last=True) if dedup else z).drop("_target")
