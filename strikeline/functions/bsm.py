"""Black-Scholes prices, greeks and implied volatility as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from strikeline.functions.scalar import ColumnLike, col, div

# Zelen-Severo coefficients of the normal tail (absolute error below 7.5e-8).
CDF_P = 0.2316419
CDF_B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def norm_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2.0) / F.sqrt(F.lit(2.0) * F.pi())


def norm_cdf(x: Column) -> Column:
    """Normal distribution function as one expression, so it stays in codegen."""
    z = F.abs(x)
    k = F.lit(1.0) / (F.lit(1.0) + F.lit(CDF_P) * z)
    poly = F.lit(0.0)
    for b in reversed(CDF_B):
        poly = (poly + F.lit(b)) * k
    tail = norm_pdf(z) * poly
    return F.when(x >= 0, F.lit(1.0) - tail).otherwise(tail)


def _d1_d2(S: Column, K: Column, T: Column, r: Column, q: Column, sigma: Column) -> tuple[Column, Column]:
    root = sigma * F.sqrt(T)
    d1 = (F.ln(S / K) + (r - q + sigma * sigma / 2.0) * T) / root
    return d1, d1 - root


def _usable(*parts: Column) -> Column:
    ok = F.lit(True)
    for p in parts:
        ok = ok & (p > 0)
    return ok


def bs_price(S: ColumnLike, K: ColumnLike, T: ColumnLike, r: Column, sigma: ColumnLike, is_call: Column, q: Column | None = None) -> Column:
    S, K, T, sigma = col(S), col(K), col(T), col(sigma)
    q = F.lit(0.0) if q is None else q
    d1, d2 = _d1_d2(S, K, T, r, q, sigma)
    sign = F.when(is_call, 1.0).otherwise(-1.0)
    live = sign * (S * F.exp(-q * T) * norm_cdf(sign * d1) - K * F.exp(-r * T) * norm_cdf(sign * d2))
    return F.when(_usable(T, sigma), live).otherwise(F.greatest(sign * (S - K), F.lit(0.0)))


def bs_greeks(S: ColumnLike, K: ColumnLike, T: ColumnLike, r: Column, sigma: ColumnLike, is_call: Column, q: Column | None = None) -> dict[str, Column]:
    """Delta, gamma, vega per vol point, theta per trading day, vanna and charm per share."""
    S, K, T, sigma = col(S), col(K), col(T), col(sigma)
    q = F.lit(0.0) if q is None else q
    d1, d2 = _d1_d2(S, K, T, r, q, sigma)
    sign = F.when(is_call, 1.0).otherwise(-1.0)
    root = F.sqrt(T)
    eq, er, pdf = F.exp(-q * T), F.exp(-r * T), norm_pdf(d1)
    decay = -S * eq * pdf * sigma / (2.0 * root)
    carry = -sign * r * K * er * norm_cdf(sign * d2) + sign * q * S * eq * norm_cdf(sign * d1)
    drift = eq * pdf * (2.0 * (r - q) * T - d2 * sigma * root) / (2.0 * T * sigma * root)
    charm = drift - q * eq * norm_cdf(d1) + F.when(is_call, 0.0).otherwise(q * eq)
    out = {
        "delta": sign * eq * norm_cdf(sign * d1),
        "gamma": eq * pdf / (S * sigma * root),
        "vega": S * eq * pdf * root / 100.0,
        "theta": (decay + carry) / 252.0,
        "vanna": -eq * pdf * d2 / sigma,
        "charm": charm,
    }
    ok = _usable(S, K, T, sigma)
    return {name: F.when(ok, e) for name, e in out.items()}


def _named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _first_vol(price: Column, S: Column, X: Column, T: Column, is_call: Column) -> Column:
    """Closed-form rational estimate from a price near the money; NULL where it has no real root. X is the discounted strike."""
    call, gap = F.when(is_call, price).otherwise(price + S - X), S - X
    over = call - gap / 2.0
    square = over * over - gap * gap / F.pi()
    return F.when(square >= 0, F.sqrt(2.0 * F.pi() / T) * (over + F.sqrt(square)) / (S + X))


def implied_vol(
    price: ColumnLike, spot: ColumnLike, strike: ColumnLike, years: ColumnLike, rate: Column, is_call: Column,
    low: float = 0.01, high: float = 5.0, slack: float = 0.01, steps: int = 60, near: float = 1e-12,
) -> Column:
    """Implied volatility as one JVM expression: a rational estimate, third-order steps and a bracket around them.

    A step that leaves the bracket, or after which the price error has not halved, is replaced by the middle of
    the bracket, so every price ends; a row is left alone from the step that moves it by less than ``near`` on
    (a few steps for most). NULL where an input is NULL, NaN or not positive, where the price is at or below
    intrinsic value plus ``slack``, or where there is no root in ``[low, high]``.
    """
    p, S, K, T = (col(c).cast("double") for c in (price, spot, strike, years))
    r, sign = rate.cast("double"), F.when(is_call, 1.0).otherwise(-1.0)

    def error(at: Column, vol: Column) -> Column:
        """Price error, its slope, and d1 times d2 at a volatility."""
        root = vol * at["root_t"]
        return _named(F.struct((at["logm"] / root + root / 2.0).alias("d1"), root.alias("root")), lambda d: F.struct(
            (at["sign"] * (at["S"] * norm_cdf(at["sign"] * d["d1"]) - at["X"] * norm_cdf(at["sign"] * (d["d1"] - d["root"]))) - at["p"]).alias("g"),
            (at["S"] * norm_pdf(d["d1"]) * at["root_t"]).alias("slope"), (d["d1"] * (d["d1"] - d["root"])).alias("dd"),
        ))

    def moved(was: Column, e: Column) -> Column:
        """State after a step from ``was`` with the errors ``e`` at its volatility."""
        under, vol = e["g"] < 0, was["vol"]
        lo, hi = F.when(under, vol).otherwise(was["lo"]), F.when(under, was["hi"]).otherwise(vol)
        newton = F.try_divide(e["g"], e["slope"])
        third = vol - F.try_divide(newton, F.lit(1.0) - newton * e["dd"] / (vol * 2.0))
        slow = F.abs(e["g"]) * 2.0 > was["g"]

        def placed(x: Column) -> Column:
            inside = (third > x["lo"]) & (third < x["hi"]) & ~slow & ~F.isnan(third)
            goal = F.when(F.coalesce(inside, F.lit(False)), third).otherwise((x["lo"] + x["hi"]) / 2.0)
            return _named(goal, lambda v: F.struct(
                x["lo"].alias("lo"), x["hi"].alias("hi"), F.when(e["g"] == 0, vol).otherwise(v).alias("vol"), F.abs(e["g"]).alias("g"),
                ((e["g"] == 0) | (F.abs(v - vol) <= near)).alias("done"),
            ))

        return _named(F.struct(lo.alias("lo"), hi.alias("hi")), placed)

    def search(at: Column) -> Column:
        first = F.least(F.greatest(F.coalesce(at["first"], F.lit((low * high) ** 0.5)), F.lit(low)), F.lit(high))
        start = F.struct(F.lit(low).alias("lo"), F.lit(high).alias("hi"), first.alias("vol"), F.lit(float("inf")).alias("g"), F.lit(False).alias("done"))
        end = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda was, _: F.when(was["done"], was).otherwise(
            _named(error(at, was["vol"]), lambda e: moved(was, e))
        ))
        bounded = (error(at, F.lit(low))["g"] <= 0) & (error(at, F.lit(high))["g"] >= 0)
        return F.when(bounded, end["vol"])

    usable = _usable(p, S, K, T) & (p > F.greatest(sign * (S - K), F.lit(0.0)) + slack)
    for c in (p, S, K, T, r):
        usable = usable & ~F.isnan(c)
    X = K * F.exp(-r * T)
    at = F.struct(
        p.alias("p"), S.alias("S"), X.alias("X"), F.sqrt(T).alias("root_t"), F.ln(F.try_divide(S, X)).alias("logm"), sign.alias("sign"),
        _first_vol(p, S, X, F.nullif(T, F.lit(0.0)), is_call).alias("first"),
    )
    return F.when(usable & is_call.isNotNull(), _named(at, search))


def lognormal_strikes(spot: ColumnLike, vix: ColumnLike, z: float = 1.036, years: float = 1.0 / 252.0) -> dict[str, Column]:
    """Rough 15-delta strikes and wing width from spot and an index volatility."""
    s, move = col(spot), F.lit(z) * col(vix) / 100.0 * F.lit(years ** 0.5)
    put = F.least(F.bround(s * F.exp(-move) / 5) * 5, F.floor(s) - 10)
    call = F.greatest(F.bround(s * F.exp(move) / 5) * 5, F.floor(s) + 10)
    width = F.greatest(F.lit(50.0), F.bround(s * 0.01 / 25) * 25)
    return {
        "short_put": put.cast("double"), "short_call": call.cast("double"),
        "long_put": (put - width).cast("double"), "long_call": (call + width).cast("double"), "spread_width": width,
    }


def estimated_credit(width: ColumnLike, vix: ColumnLike) -> Column:
    """Credit as a share of the wing width, rising with volatility, between 8 and 20 percent."""
    ratio = F.greatest(F.lit(0.08), F.least(F.lit(0.20), F.lit(0.10) + (col(vix) - 15.0) / 100.0))
    return col(width) * ratio


def close_pnl(close: ColumnLike, short_put: ColumnLike, short_call: ColumnLike, long_put: ColumnLike, long_call: ColumnLike, width: ColumnLike, credit: ColumnLike) -> Column:
    """Condor P&L at the close: full credit inside, linear on a breach, capped past the wings."""
    c = col(close)
    breach = F.when(c < col(short_put), col(short_put) - c).when(c > col(short_call), c - col(short_call))
    beyond = (c <= col(long_put)) | (c >= col(long_call))
    return F.when(breach.isNull(), col(credit)).when(beyond, col(credit) - col(width)).otherwise(col(credit) - breach)


def adaptive_stop(credit: ColumnLike, atr: ColumnLike, session_atr: ColumnLike, p_low: ColumnLike, p_mid: ColumnLike, p_high: ColumnLike) -> Column:
    """Stop debit: regime-weighted multiple, tightened as volatility rises over the session's."""
    base = col(p_low) * 2.5 + col(p_mid) * 2.0 + col(p_high) * 1.5
    ratio = div(atr, session_atr)
    adjust = F.greatest(F.lit(0.8), F.least(F.lit(1.2), div(F.lit(1.0), ratio)))
    return col(credit) * base * adjust


def decaying_target(base: float, minutes_left: ColumnLike) -> Column:
    """Take-profit share that shrinks towards the close."""
    m = col(minutes_left)
    noon = F.lit(base) - (F.lit(base) - 0.15) * ((F.lit(180.0) - m) / 120.0)
    late = F.lit(0.15) - F.lit(0.10) * ((F.lit(60.0) - m) / 60.0)
    return F.when(m > 180, F.lit(base)).when(m > 60, noon).otherwise(late)


def delta_emergency(call_delta: ColumnLike, put_delta: ColumnLike, limit: float = 0.25) -> Column:
    return F.coalesce((F.abs(col(call_delta)) > limit) | (F.abs(col(put_delta)) > limit), F.lit(False))


def adaptive_ratchet(p_low: ColumnLike, p_mid: ColumnLike, p_high: ColumnLike) -> dict[str, Column]:
    """Regime-weighted activation, step and floor offset of the profit lock."""
    # Fixed values per parameter: low, neutral and high volatility regime.
    table = {"activate_pct": (0.40, 0.30, 0.20), "ratchet_step": (0.08, 0.05, 0.03), "floor_offset": (0.10, 0.05, 0.03)}
    return {n: col(p_low) * a + col(p_mid) * b + col(p_high) * c for n, (a, b, c) in table.items()}
