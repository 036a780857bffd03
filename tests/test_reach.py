"""Races over long horizons against the form that visits every slice, and against plain search."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strikeline.operators.barrier import first_touch
from strikeline.operators.reach import covering, first_touch_far, range_extremes

RNG = np.random.default_rng(41)
T0 = pd.Timestamp("2024-01-01")
LEVELS = [("up", ">=", "up"), ("down", "<=", "down"), ("far", ">=", "far")]


def test_ranges_cover_each_slice_once_in_order(spark):
    pairs = [(a, b) for a in range(-9, 20) for b in range(-9, 40, 3)]
    rows = spark.createDataFrame(pairs, "p long, q long").select("p", "q", covering(F.col("p"), F.col("q"), 7).alias("r")).collect()
    for r in rows:
        got = sorted(x for n in r.r for x in range(n._b << n._l, (n._b + 1) << n._l))
        assert got == list(range(r.p, r.q)) and len(r.r) <= 2 * max(1, (r.q - r.p).bit_length())


def test_extremes_of_ranges(spark):
    x = spark.createDataFrame([("a", s, float(s % 5), float(s % 7)) for s in range(-6, 13) if s % 4], "k string, _s long, _lo double, _hi double")
    for r in range_extremes(x, ["k"], 3).collect():
        inside = [s for s in range(-6, 13) if s % 4 and s >> r._l == r._b]
        assert r._lo == min(s % 5 for s in inside) and r._hi == max(s % 7 for s in inside)


@pytest.mark.parametrize("seconds", [120, 3_000])
def test_equal_to_the_form_over_all_slices(spark, seconds):
    n = 500
    p = pd.DataFrame({"k": np.where(RNG.random(n) < 0.7, 0, RNG.integers(1, 4, n)), "t": T0 + pd.to_timedelta(RNG.permutation(150_000)[:n], unit="s"), "v": 50 + RNG.normal(0, 1, n).cumsum().round(2)})
    e = p.sample(150, random_state=1).rename(columns={"v": "v0"}).assign(eid=range(150))
    e["z"] = e.t + pd.to_timedelta(RNG.integers(0, 90_000, 150), unit="s")
    e["up"], e["down"], e["far"] = e.v0 + 3, e.v0 - 4, e.v0 + 1_000
    ntz = lambda d, cols: spark.createDataFrame(d).withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})
    args = (ntz(e, ["t", "z"]), ntz(p, ["t"]), ["k"], ["eid"], "t", "z", "t", "v", LEVELS)
    got = first_touch_far(*args, seconds).toPandas().set_index("eid").sort_index()
    want = first_touch(*args, 20_000).toPandas().set_index("eid").sort_index()
    assert list(got.index) == list(want.index) and got.up_t.notna().sum() > 20 and got.down_t.notna().sum() > 20 and got.far_t.isna().all()
    for c in want.columns:
        assert (got[c].isna() == want[c].isna()).all() and (got[c].dropna() == want[c].dropna()).all(), c


def test_no_path_no_entries(spark):
    p = spark.createDataFrame([], "k int, t timestamp, v double")
    e = spark.createDataFrame([(0, 1, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 5), 1.0)], "k int, eid int, t timestamp, z timestamp, up double")
    lv = [("up", ">=", "up")]
    assert first_touch_far(e, p, ["k"], ["eid"], "t", "z", "t", "v", lv, 60).count() == 0
    assert first_touch_far(e.limit(0), p, ["k"], ["eid"], "t", "z", "t", "v", lv, 60).count() == 0


def test_slices_get_narrower_where_points_are_dense_and_races_stay_the_same(spark, monkeypatch):
    from pyspark.sql import functions as F

    from strikeline.operators import reach

    p = spark.range(3000).select(F.lit("a").alias("k"), F.timestamp_seconds(F.lit(1_600_000_000) + F.col("id") % 600).alias("t"), (F.col("id") * 37 % 1000).cast("double").alias("v"))
    e = p.where("v < 50").select("k", F.monotonically_increasing_id().alias("eid"), "t", (F.col("v") + 900).alias("up"), (F.col("t") + F.expr("INTERVAL 5 MINUTES")).alias("z"))
    args = (e, p, ["k"], ["eid"], "t", "z", "t", "v", [("up", ">=", "up")], 120)
    widths, width_of = [], reach.time_width
    monkeypatch.setattr(reach, "time_width", lambda *a: widths.append(width_of(*a)) or widths[-1])
    narrow, wide = (sorted(map(str, first_touch_far(*args, most).collect())) for most in (32, 10**9))
    assert narrow == wide and len(narrow) == e.count()
    assert widths[0] * 5 <= 2 * 32 and widths[1] == 120
