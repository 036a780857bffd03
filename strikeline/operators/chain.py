"""Option-chain aggregations: pivots, open interest, exposure and surface."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strikeline.functions.bsm import bs_greeks
from strikeline.functions.scalar import div, div_pos, side_of
from strikeline.operators.nearest import closest_bucket

SIDES = ("call", "put")


def pivot_sides(df: DataFrame, keys: Sequence[str], right: str, cols: Sequence[str]) -> DataFrame:
    """call_<c> / put_<c> columns by conditional aggregation over the two fixed sides."""
    return df.groupBy(*keys).agg(
        *[F.max(F.when(F.col(right) == s, F.col(c))).alias(f"{s}_{c}") for s in SIDES for c in cols]
    )


def side_sum(value: str, side: str, right: str = "right") -> Column:
    return F.sum(F.when(side_of(right) == side, F.col(value)))


def open_interest_daily(oi: DataFrame, date: str = "date") -> DataFrame:
    """Totals, put/call ratio, concentration over strikes and the busiest strike.

    Strikes are summed first, so the second step sees one small row per strike.
    """
    per = oi.groupBy(date, "strike").agg(
        side_sum("open_interest", "call").alias("c"), side_sum("open_interest", "put").alias("p"),
        F.sum("open_interest").alias("oi"),
    )
    day = per.groupBy(date).agg(
        F.coalesce(F.sum("c"), F.lit(0.0)).alias("total_call_oi"), F.coalesce(F.sum("p"), F.lit(0.0)).alias("total_put_oi"),
        F.sum(F.pow("oi", F.lit(2.0))).alias("_sq"),
        F.max_by("strike", F.struct(F.col("oi"), -F.col("strike"))).alias("max_pain_strike"),
    )
    total = F.col("total_call_oi") + F.col("total_put_oi")
    return day.select(
        date, "total_call_oi", "total_put_oi",
        div_pos("total_put_oi", "total_call_oi").alias("pc_oi_ratio"),
        F.when(total > 0, div("_sq", total * total)).alias("oi_concentration"),
        "max_pain_strike",
    )


def concentration(df: DataFrame, keys: Sequence[str], item: str, value: str) -> DataFrame:
    """Sum of squared shares of the items of each group."""
    per = df.groupBy(*keys, item).agg(F.sum(value).alias("_v"))
    return per.groupBy(*keys).agg(
        F.when(F.sum("_v") > 0, div(F.sum(F.col("_v") * F.col("_v")), F.sum("_v") * F.sum("_v"))).alias("concentration")
    )


def max_pain(oi: DataFrame, keys: Sequence[str], legacy: bool = False) -> DataFrame:
    """Settlement strike with the least total payout, lowest strike on ties.

    Payout at each candidate strike comes from running sums of open interest and
    open interest times strike, so candidates are never paired with strikes.
    ``legacy`` swaps the two payout sides, as an older rule did.
    """
    per = oi.groupBy(*keys, "strike").agg(
        F.coalesce(side_sum("open_interest", "call"), F.lit(0.0)).alias("c"),
        F.coalesce(side_sum("open_interest", "put"), F.lit(0.0)).alias("p"),
    )
    w = W.partitionBy(*keys).orderBy("strike")
    below, above = w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(1, W.unboundedFollowing)
    k = F.col("strike")

    def under(x: str) -> Column:
        return F.coalesce(k * F.sum(x).over(below) - F.sum(F.col(x) * k).over(below), F.lit(0.0))

    def over(x: str) -> Column:
        return F.coalesce(F.sum(F.col(x) * k).over(above) - k * F.sum(x).over(above), F.lit(0.0))

    payout = (over("c") + under("p")) if legacy else (under("c") + over("p"))
    return per.select(*keys, "strike", payout.alias("payout")).groupBy(*keys).agg(
        F.min_by("strike", F.struct("payout", "strike")).alias("max_pain_strike"), F.min("payout").alias("min_payout")
    )


def sign_of(right: str = "right") -> Column:
    return F.when(F.col(right) == "call", 1.0).otherwise(-1.0)


def gamma_exposure(contracts: DataFrame, spot: str = "spot") -> DataFrame:
    """Signed dollar gamma per contract row: +-gamma * OI * 100 * S^2 * 0.01."""
    s = F.col(spot)
    usable = F.col("gamma").isNotNull() & (F.col("open_interest") > 0) & (s > 0)
    return contracts.where(usable).withColumn("gex", sign_of() * F.col("gamma") * F.col("open_interest") * 100.0 * s * s * 0.01)


def zero_crossing(df: DataFrame, keys: Sequence[str], level: str, value: str) -> DataFrame:
    """First level where the running sum changes sign, linearly interpolated."""
    w = W.partitionBy(*keys).orderBy(level)
    cum = df.withColumn("_c", F.sum(value).over(w.rowsBetween(W.unboundedPreceding, 0)))
    prev = cum.withColumn("_p", F.lag("_c").over(w)).withColumn("_pl", F.lag(level).over(w))
    crossed = (F.signum("_p") != F.signum("_c")) & (F.col("_p") != 0)
    at = F.col("_pl") + (F.col(level) - F.col("_pl")) * div(-F.col("_p"), F.col("_c") - F.col("_p"))
    return prev.groupBy(*keys).agg(F.min_by(at, F.when(crossed, F.col(level))).alias("zero_level"))


def gex_daily(contracts: DataFrame, keys: Sequence[str], spot: str = "spot") -> DataFrame:
    """Net exposure, imbalance, walls with distances, and the zero-gamma level."""
    g = gamma_exposure(contracts, spot)
    call, put = F.col("right") == "call", F.col("right") == "put"
    day = g.groupBy(*keys).agg(
        F.max(spot).alias("_s"), F.sum("gex").alias("net_gex"),
        F.coalesce(F.sum(F.when(call, F.col("gex"))), F.lit(0.0)).alias("_cg"),
        F.coalesce(F.sum(F.when(put, F.abs("gex"))), F.lit(0.0)).alias("_pg"),
        F.max_by("strike", F.when(call, F.struct("gex", -F.col("strike")))).alias("call_wall"),
        F.max_by("strike", F.when(put, F.struct(F.abs("gex"), -F.col("strike")))).alias("put_wall"),
    )
    strikes = g.groupBy(*keys, "strike").agg(F.sum("gex").alias("_v"))
    zero = zero_crossing(strikes, keys, "strike", "_v").withColumnRenamed("zero_level", "zero_gamma_level")
    return day.join(zero, list(keys), "left").select(
        *keys, "net_gex", div("net_gex", "_s").alias("net_gex_normalized"),
        F.when(F.col("_cg") + F.col("_pg") > 0, div("_cg", F.col("_cg") + F.col("_pg"))).alias("gex_imbalance"),
        "zero_gamma_level", "call_wall", "put_wall",
        (div(F.col("call_wall") - F.col("_s"), "_s") * 100.0).alias("call_wall_distance"),
        (div(F.col("_s") - F.col("put_wall"), "_s") * 100.0).alias("put_wall_distance"),
    )


def gex_profile(contracts: DataFrame, keys: Sequence[str], spot: str = "spot") -> DataFrame:
    g = gamma_exposure(contracts, spot)
    p = g.groupBy(*keys, "strike").agg(
        F.coalesce(F.sum(F.when(F.col("right") == "call", F.col("gex"))), F.lit(0.0)).alias("call_gex"),
        F.coalesce(F.sum(F.when(F.col("right") == "put", F.col("gex"))), F.lit(0.0)).alias("put_gex"),
    )
    return p.withColumn("net_gex", F.col("call_gex") + F.col("put_gex"))


def vanna_charm_daily(contracts: DataFrame, keys: Sequence[str], spot: str = "spot", years: float = 0.5 / 365.0, rate: float = 0.05) -> DataFrame:
    """Signed vanna and charm exposure totals; needs at least two usable contracts."""
    ok = (F.col("open_interest") > 0) & (F.col("iv") > 0.01) & (F.col("iv") < 5.0) & (F.col(spot) > 0)
    g = bs_greeks(spot, "strike", F.lit(years), F.lit(rate), "iv", F.col("right") == "call")
    size = sign_of() * F.col("open_interest") * 100.0
    x = contracts.where(ok).select(*keys, "right", F.col(spot).alias("_s"), (g["vanna"] * size).alias("vanna"), (g["charm"] * size).alias("charm"))
    call, put = F.col("right") == "call", F.col("right") == "put"

    def split(c: str) -> tuple[Column, Column]:
        return (
            F.abs(F.coalesce(F.sum(F.when(call, F.col(c))), F.lit(0.0))).alias(f"_c_{c}"),
            F.coalesce(F.sum(F.when(put, F.abs(c))), F.lit(0.0)).alias(f"_p_{c}"),
        )

    day = x.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.max("_s").alias("_s"),
        F.sum("vanna").alias("nv"), F.sum("charm").alias("nc"), *split("vanna"), *split("charm"),
    ).where(F.col("_n") >= 2)

    def share(a: Column, b: Column) -> Column:
        return F.when(a + b > 0, div(a, a + b))

    return day.select(
        *keys,
        F.col("nv").alias("net_vanna_exposure"), div("nv", "_s").alias("net_vanna_normalized"),
        share(F.col("_c_vanna"), F.col("_p_vanna")).alias("vanna_imbalance"),
        F.col("nc").alias("net_charm_exposure"), div("nc", "_s").alias("net_charm_normalized"),
        share(F.col("_c_charm"), F.col("_p_charm")).alias("charm_imbalance"),
        share(F.abs("nv"), F.abs("nc")).alias("vanna_charm_ratio"),
    )


def iv_surface(contracts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """ATM volatility, 25 and 10 delta volatilities, skews and smile curvature.

    Input is long: right, delta, iv, strike. Six nearest-delta picks, one aggregation.
    """
    valid = (F.col("iv") > 0.01) & (F.col("iv") < 5.0)

    aggs = []
    for side, name, target in (
        ("call", "atm_call", 0.50), ("put", "atm_put", -0.50), ("call", "c25", 0.25),
        ("put", "p25", -0.25), ("call", "c10", 0.10), ("put", "p10", -0.10),
    ):
        ok = valid & (F.col("right") == side) & F.col("delta").isNotNull()
        aggs.append(F.min(F.when(ok, F.struct(F.abs(F.col("delta") - target).alias("d"), F.col("strike"), F.col("iv")))).alias(name))
    best = contracts.groupBy(*keys).agg(*aggs)

    def iv(name: str, tol: float) -> Column:
        return F.when(F.col(f"{name}.d") <= tol, F.col(f"{name}.iv"))

    ac, ap = iv("atm_call", 0.15), iv("atm_put", 0.15)
    base = best.select(
        *keys, F.coalesce((ac + ap) / 2.0, ac, ap).alias("atm_iv"),
        iv("c25", 0.10).alias("iv_25d_call"), iv("p25", 0.10).alias("iv_25d_put"),
        iv("c10", 0.10).alias("iv_10d_call"), iv("p10", 0.10).alias("iv_10d_put"),
    )
    return base.select(
        "*", (F.col("iv_25d_put") - F.col("iv_25d_call")).alias("skew_25d"),
        (F.col("iv_10d_put") - F.col("iv_10d_call")).alias("skew_10d"),
        ((F.col("iv_25d_put") + F.col("iv_25d_call")) / 2.0 - F.col("atm_iv")).alias("iv_smile_curve"),
    )


def long_sides(state: DataFrame, keys: Sequence[str], cols: dict[str, str]) -> DataFrame:
    """Wide call/put state back to one row per side; ``cols`` maps output to suffix."""
    def row(s: str) -> Column:
        return F.struct(F.lit(s).alias("right"), *[F.col(f"{s}_{src}").alias(out) for out, src in cols.items()])

    return state.select(*keys, F.explode(F.array(row("call"), row("put"))).alias("_r")).select(*keys, "_r.*")


def atm_straddle(ts: DataFrame, date: str, targets: dict[str, int], max_distance: int = 5) -> DataFrame:
    """Mean call/put mid at the money for each tenor bucket of a date.

    The exact tenor if listed, else the closest within ``max_distance``. Strikes
    equal to the ATM strike, or the two rows nearest the spot when it is missing.
    """
    out = ts.select(date).distinct()
    side = side_of("right")
    for name, dte in targets.items():
        bucket = closest_bucket(ts, [date], "dte", float(dte), float(max_distance))
        exact = F.col("strike") == F.col("atm_strike")
        near = F.struct(F.abs(F.col("strike") - F.col("spx_close")).alias("d"), F.col("strike").alias("k"), F.col("right").alias("r"))
        rank = F.row_number().over(W.partitionBy(date).orderBy(near))
        has = F.max(exact.cast("int")).over(W.partitionBy(date))
        rows = bucket.withColumn("_has", has).withColumn("_rank", rank)
        rows = rows.where(F.when(F.col("_has") == 1, exact).otherwise(F.col("_rank") <= 2))
        c, p = F.avg(F.when(side == "call", F.col("mid"))), F.avg(F.when(side == "put", F.col("mid")))
        mids = rows.groupBy(date).agg(c.alias("_c"), p.alias("_p"))
        mids = mids.select(date, F.coalesce((F.col("_c") + F.col("_p")) / 2.0, F.col("_c"), F.col("_p")).alias(name))
        out = out.join(mids, date, "left")
    return out


def condor_credit(keys: Sequence[str], state: DataFrame, atm: str, short: int, wing: int, name: str) -> DataFrame:
    """Credit of a fixed-offset condor per snapshot, NULL unless all four mids are positive."""
    aggs, label = [], {}
    for tag, side, off in (("sc", "call", short), ("lc", "call", wing), ("sp", "put", -short), ("lp", "put", -wing)):
        mid = F.col(f"{side}_mid_close")
        aggs.append(F.max(F.when((F.col("strike") == F.col(atm) + off) & (mid > 0), mid)).alias(tag))
    got = state.groupBy(*keys).agg(*aggs)
    credit = F.col("sc") + F.col("sp") - F.col("lc") - F.col("lp")
    return got.select(*keys, F.when(credit > 0, credit).alias(name))


def expiry_payoff(df: DataFrame, spot_open: str, spot_close: str, legs: dict[str, str], short: float, wing: float) -> dict[str, Column]:
    """Condor settled at intrinsic value: credit, P&L with the loss capped, win flags."""
    o, c = F.col(spot_open), F.col(spot_close)
    credit = F.col(legs["short_call"]) + F.col(legs["short_put"]) - F.col(legs["long_call"]) - F.col(legs["long_put"])
    zero = F.lit(0.0)
    debit = (
        F.greatest(zero, c - (o + short)) + F.greatest(zero, (o - short) - c)
        - F.greatest(zero, c - (o + wing)) - F.greatest(zero, (o - wing) - c)
    )
    pnl = F.greatest(credit - debit, credit - F.lit(wing - short))
    ok = credit > 0
    pct = div(pnl, credit) * 100.0
    return {
        "ic_credit": F.when(ok, F.round(credit, 2)),
        "ic_pnl_per_share": F.when(ok, F.round(pnl, 2)),
        "ic_pnl_pct": F.when(ok, F.round(pct, 2)),
        "ic_profitable": F.when(ok, (pnl > 0).cast("long")),
        "ic_tp25_hit": F.when(ok, (pct >= 25).cast("long")),
    }


def strike_grid(df: DataFrame, spot: str, width: int = 250, step: int = 5) -> DataFrame:
    """ATM +- width strikes times both sides for every input row."""
    atm = F.bround(F.col(spot) / step) * step
    return df.withColumn("atm_strike", atm).withColumn(
        "strike", F.explode(F.sequence((atm - width).cast("long"), (atm + width).cast("long"), F.lit(step).cast("long")))
    ).withColumn("strike", F.col("strike").cast("double")).withColumn("right", F.explode(F.array(F.lit("call"), F.lit("put"))))
