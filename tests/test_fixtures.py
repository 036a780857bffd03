"""Hand-computed cases for the chain, surface, run and barrier operators."""

import datetime as dt
import math

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strikeline.functions import bsm
from strikeline.functions import scalar as sc
from strikeline.operators import barrier, chain, runs
from strikeline.operators import indicators as ind


def contracts(spark, rows):
    return spark.createDataFrame([(1, *r, 5000.0) for r in rows], "k int, strike double, right string, gamma double, open_interest double, spot double")


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_single_call_exposure(spark):
    r = one(chain.gex_daily(contracts(spark, [(5000.0, "call", 0.001, 1000.0)]), ["k"]))
    assert r.net_gex == pytest.approx(0.001 * 1000 * 100 * 5000**2 * 0.01)
    assert (r.gex_imbalance, r.call_wall, r.put_wall) == (1.0, 5000.0, None)


def test_single_put_and_balanced(spark):
    r = one(chain.gex_daily(contracts(spark, [(4900.0, "put", 0.001, 1000.0)]), ["k"]))
    assert r.net_gex < 0 and r.gex_imbalance == 0 and r.call_wall is None and r.put_wall == 4900
    r = one(chain.gex_daily(contracts(spark, [(5000.0, "call", 0.001, 10.0), (5000.0, "put", 0.001, 10.0)]), ["k"]))
    assert abs(r.net_gex) < 1e-9 and r.gex_imbalance == 0.5


def test_walls_and_distances(spark):
    rows = [(s, "call", g, 500.0) for s, g in ((5000.0, 0.001), (5050.0, 0.003), (5100.0, 0.001))]
    rows += [(s, "put", g, 500.0) for s, g in ((4900.0, 0.001), (4950.0, 0.005), (4800.0, 0.002))]
    r = one(chain.gex_daily(contracts(spark, rows), ["k"]))
    assert (r.call_wall, r.put_wall) == (5050.0, 4950.0)
    assert r.call_wall_distance == pytest.approx(1.0) and r.put_wall_distance == pytest.approx(1.0)


def test_zero_open_interest_is_dropped(spark):
    assert chain.gex_daily(contracts(spark, [(5000.0, "call", 0.001, 0.0)]), ["k"]).count() == 0


@pytest.mark.parametrize(
    "values, expected", [([10.0, -30.0], 4950 + 50 / 3), ([1.0, 2.0, 3.0], None), ([5.0], None), ([10.0, -30.0, 40.0, -20.0], 4950 + 50 / 3)]
)
def test_zero_crossing(spark, values, expected):
    df = spark.createDataFrame([(1, 4950.0 + 50 * i, v) for i, v in enumerate(values)], "k int, strike double, v double")
    got = one(chain.zero_crossing(df, ["k"], "strike", "v")).zero_level
    assert got == (None if expected is None else pytest.approx(expected))


def test_exposure_profile(spark):
    rows = [(4900.0, "put", 0.001, 1.0), (5000.0, "call", 0.001, 1.0), (5000.0, "put", 0.001, 1.0), (5100.0, "call", 0.001, 1.0)]
    p = {r.strike: r for r in chain.gex_profile(contracts(spark, rows), ["k"]).collect()}
    assert len(p) == 3 and p[4900.0].call_gex == 0 and p[5100.0].put_gex == 0 and p[5000.0].net_gex == pytest.approx(0)


SNAP = [(4800.0, "put", -0.10, 0.30), (4900.0, "put", -0.25, 0.26), (5000.0, "call", 0.50, 0.20), (5000.0, "put", -0.50, 0.21), (5100.0, "call", 0.25, 0.22), (5200.0, "call", 0.10, 0.28)]


def test_iv_surface(spark):
    df = spark.createDataFrame([(1, *r) for r in SNAP], "k int, strike double, right string, delta double, iv double")
    r = one(chain.iv_surface(df, ["k"]))
    assert (r.atm_iv, r.skew_25d, r.skew_10d, r.iv_smile_curve) == tuple(pytest.approx(v) for v in (0.205, 0.04, 0.02, 0.035))
    r = one(chain.iv_surface(df.where(F.col("right") == "call"), ["k"]))
    assert r.atm_iv == pytest.approx(0.20) and r.skew_25d is None


def test_run_lengths(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate([0, 0, 1, 1, 1, 0])], "k int, i int, st int")
    out = runs.run_of_state(df, "st", W.partitionBy("k").orderBy("i"), "dur", "sw").orderBy("i").collect()
    assert [r.dur for r in out] == [1, 2, 1, 2, 3, 1] and [r.sw for r in out] == [0, 0, 1, 0, 0, 1]
    assert runs.run_of_state(df.limit(0), "st", W.partitionBy("k").orderBy("i"), "dur").count() == 0


def test_streaks_pass_over_nulls(spark):
    df = spark.createDataFrame([(1, i, o) for i, o in enumerate([1, 1, None, 1, 0, 0])], "k int, i int, o int")
    out = runs.streaks(df, ["k"], "i", "o", "w", "l").orderBy("i").collect()
    assert [r.w for r in out] == [None, 1, 2, 2, 3, 0] and [r.l for r in out] == [None, 0, 0, 0, 0, 1]


def test_vanna_charm_invariants(spark):
    rows = [(1, 5000.0 + 50 * i, s, 0.20, 1000.0, 5000.0) for i in range(-4, 5) for s in ("call", "put")]
    df = spark.createDataFrame(rows, "k int, strike double, right string, iv double, open_interest double, spot double")
    r = one(chain.vanna_charm_daily(df, ["k"]))
    assert 0 <= r.vanna_imbalance <= 1 and 0 <= r.charm_imbalance <= 1
    assert r.vanna_charm_ratio is None or 0 <= r.vanna_charm_ratio <= 1
    assert r.net_vanna_normalized == pytest.approx(r.net_vanna_exposure / 5000.0)
    assert chain.vanna_charm_daily(df.limit(1), ["k"]).count() == 0


def exact_price(s, k, t, r, v, call):
    d1 = (math.log(s / k) + (r + v * v / 2) * t) / (v * math.sqrt(t))
    d2 = d1 - v * math.sqrt(t)
    n = lambda x: 0.5 * (1 + math.erf(x / math.sqrt(2)))
    sign = 1 if call else -1
    return sign * (s * n(sign * d1) - k * math.exp(-r * t) * n(sign * d2))


def test_black_scholes_parity_and_inversion(spark):
    rows = [(5000.0, 4800.0 + 50 * i, 7 / 365, 0.05, 0.15 + 0.02 * i, c) for i in range(9) for c in (True, False)]
    df = spark.createDataFrame([(*r, exact_price(*r)) for r in rows], "s double, k double, t double, r double, v double, c boolean, p double")
    out = df.select("*", bsm.bs_price("s", "k", "t", F.col("r"), "v", F.col("c")).alias("mine"), bsm.implied_vol("p", "s", "k", "t", F.col("r"), F.col("c")).alias("iv")).collect()
    for r in out:
        assert r.mine == pytest.approx(r.p, abs=2e-3)
        assert r.iv == pytest.approx(r.v, abs=1e-4)
    bad = spark.createDataFrame([(0.0, 1.0), (100.005, 0.0), (1e6, 1.0)], "p double, x double")
    null = bad.select(bsm.implied_vol("p", F.lit(5000.0), F.lit(4900.0), F.lit(0.1), F.lit(0.0), F.lit(True)).alias("iv")).collect()
    assert all(r.iv is None for r in null)


def minutes(*debits, start=600):
    base = dt.datetime(2024, 1, 2)
    return [(1, base + dt.timedelta(minutes=start + 1 + i), v) for i, v in enumerate(debits)]


@pytest.mark.parametrize(
    "debits, reason, target, debit",
    [
        ((1.8, 1.5, 4.0), "tp", 1, 1.5), ((3.6, 1.0), "sl", 0, 3.6), ((1.7, 1.72), "close_win", 1, 1.72), ((1.8, 1.75), "close_loss", 0, 1.75), ((1.8, None, 1.9), "close_loss", 0, 1.9),
    ],
)
def test_barrier_race(spark, debits, reason, target, debit):
    path = spark.createDataFrame(minutes(*debits), "k int, t timestamp_ntz, v double")
    e = spark.createDataFrame([(1, dt.datetime(2024, 1, 2, 10, 0), dt.datetime(2024, 1, 2, 15, 0), 1.75, 3.5, 1.75 * 0.9)], "k int, a timestamp_ntz, z timestamp_ntz, credit double, sl double, tp double")
    hits = barrier.first_touch(e, path, ["k"], ["k", "a"], "a", "z", "t", "v", [("sl", ">=", "sl"), ("tp", "<=", "tp")], 1800)
    o = barrier.race(F.col("credit"), (F.col("sl_t"), F.col("sl_v")), (F.col("tp_t"), F.col("tp_v")), (F.col("last_t"), F.col("last_v")))
    r = one(e.join(hits, ["k", "a"]).select(*[c.alias(n) for n, c in o.items()]))
    assert (r.exit_reason, r.target, r.exit_debit) == (reason, target, debit)
    assert r.pnl == pytest.approx(round(1.75 - debit, 4))


def test_stop_wins_when_both_levels_meet(spark):
    t = F.lit(dt.datetime(2024, 1, 2, 11))
    o = barrier.race(F.lit(1.0), (t, F.lit(1.0)), (t, F.lit(1.0)), (t, F.lit(1.0)))
    assert one(spark.range(1).select(o["exit_reason"].alias("x"))).x == "sl"


def test_ratchet_gives_back_locked_profit(spark):
    path = spark.createDataFrame([(1, i, v, 10.0) for i, v in enumerate([9.0, 7.0, 6.4, 7.1])], "k int, t int, v double, credit double")
    r = one(barrier.ratchet_exit(path, ["k"], "t", "v", "credit"))
    assert (r.lock_time, r.lock_debit, r.lock_floor, r.best_debit) == (3, 7.1, 7.0, 6.4)


def test_half_even_rounding_and_symbols(spark):
    df = spark.createDataFrame([(12.5,), (17.5,), (5002.5,)], "x double")
    assert [r.s for r in df.select(sc.to_step("x").alias("s")).collect()] == [10.0, 20.0, 5000.0]
    r = one(spark.range(1).select(sc.parse_occ(F.lit("SPXW240105C05010000")).alias("o")))
    assert (r.o.root, str(r.o.expiry), r.o.right, r.o.strike) == ("SPXW", "2024-01-05", "call", 5010.0)


def test_max_pain_matches_brute_force(spark):
    rows = [(1, 100.0, "call", 10.0), (1, 105.0, "call", 30.0), (1, 105.0, "put", 5.0), (1, 110.0, "put", 40.0), (1, 95.0, "put", 7.0)]
    oi = spark.createDataFrame(rows, "k int, strike double, right string, open_interest double")
    strikes = sorted({r[1] for r in rows})

    def pain(s):
        return sum(o * (max(0, s - k) if side == "call" else max(0, k - s)) for _, k, side, o in rows)

    r = one(chain.max_pain(oi, ["k"]))
    assert r.max_pain_strike == min(strikes, key=lambda s: (pain(s), s)) and r.min_payout == min(map(pain, strikes))


def test_term_slope_and_policy_parameters(spark):
    df = spark.createDataFrame([(0.25, 0.20, 0.18)], "a double, b double, c double")
    s = ind.term_slopes("a", "b", "c")
    r = one(df.select(s["slope_ratio"].alias("r"), s["inverted"].alias("i")))
    assert (r.r, r.i) == (pytest.approx(1.25), 1.0)


def test_normal_distribution_against_the_error_function(spark):
    """The price and delta of the library against ``math.erf``, which shares no constants with it."""
    def cdf(x):
        return (1 + math.erf(x / math.sqrt(2))) / 2

    rows = [(float(k), vol, days / 365.0, call) for k in (3500, 4400, 5000, 5600, 6500) for vol in (0.05, 0.2, 1.5) for days in (1, 30, 365) for call in (True, False)]
    df = spark.createDataFrame(rows, "k double, vol double, t double, call boolean")
    r = F.lit(0.05)
    got = df.withColumns({"price": bsm.bs_price(F.lit(5000.0), "k", "t", r, "vol", F.col("call")), "delta": bsm.bs_greeks(F.lit(5000.0), "k", "t", r, "vol", F.col("call"))["delta"]})
    for x in got.collect():
        d1 = (math.log(5000.0 / x.k) + (0.05 + x.vol**2 / 2) * x.t) / (x.vol * math.sqrt(x.t))
        d2, sign = d1 - x.vol * math.sqrt(x.t), 1 if x.call else -1
        price = sign * (5000.0 * cdf(sign * d1) - x.k * math.exp(-0.05 * x.t) * cdf(sign * d2))
        assert abs(x.price - price) < 2e-3 and abs(x.delta - sign * cdf(sign * d1)) < 1e-6
