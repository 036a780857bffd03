"""Sliced scans against the one-window forms and against plain recursions, with one key of most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strikeline.operators import runs, scan
from strikeline.operators import windows as wn

RNG = np.random.default_rng(17)


def ticks(spark, n=700, nulls=0.3):
    pdf = pd.DataFrame({"i": range(n), "k": np.where(RNG.random(n) < 0.7, 0, RNG.integers(1, 4, n)), "v": RNG.normal(0, 1, n).round(3)})
    pdf["v"] = pdf.v.where(RNG.random(n) >= nulls)
    pdf.loc[(pdf.i > 200) & (pdf.i < 330), "v"] = np.nan  # whole slices without a value
    pdf["st"] = np.where(pdf.v.isna(), 2, np.where(RNG.random(n) < 0.9, 1, 0))
    x = spark.createDataFrame(pdf)
    x = x.withColumns({"k": F.when(F.col("k") == 3, None).otherwise(F.col("k")), "v": F.when(~F.isnan("v"), F.col("v")), "st": F.when(F.col("st") == 2, None).otherwise(F.col("st"))})
    return x.withColumn("_slice", F.floor(F.col("i") / 20).cast("long"))


def same(a, b, cols):
    a, b = a.orderBy("i").select("i", *cols).toPandas(), b.orderBy("i").select("i", *cols).toPandas()
    assert list(a.i) == list(b.i)
    for c in cols:
        x, y = a[c].astype(float), b[c].astype(float)
        assert (x.isna() == y.isna()).all(), c
        assert np.allclose(x.fillna(0), y.fillna(0), atol=1e-9), c


@pytest.mark.parametrize("ignore_null", [False, True])
@pytest.mark.parametrize("nulls", [0.0, 0.3, 0.97])
def test_ewm(spark, ignore_null, nulls):
    x = ticks(spark, nulls=nulls)
    specs = {"fast": ("v", 0.4, 1), "slow": ("v", 0.01, 5), "whole": ("v", 1.0, 1), "sharp": ("v", 0.999999, 3)}
    same(scan.ewm_over_ticks(x, ["k"], "i", specs, ignore_null=ignore_null), wn.with_ewm(x, ["k"], "i", specs, ignore_null), list(specs))


def test_ewm_against_pandas_over_the_whole_frame(spark):
    x = ticks(spark).withColumn("v", F.col("v").cast("double"))
    got = scan.ewm_over_ticks(x, [], "i", {"y": ("v", 0.1, 4)}).orderBy("i").toPandas()
    want = x.orderBy("i").toPandas().v.ewm(alpha=0.1, adjust=False, min_periods=4).mean()
    assert np.allclose(got.y.fillna(-9), want.fillna(-9))


def test_cusum(spark):
    x = ticks(spark)
    got = scan.cusum_over_ticks(x, ["k"], "i", "v", F.lit(0.02), F.lit(0.3))
    same(got, wn.with_cusum(x, W.partitionBy("k").orderBy("i"), "v", F.lit(0.02), F.lit(0.3)), ["cusum_up", "cusum_down"])
    s, want = 0.0, []
    for v in x.where("k = 0").orderBy("i").toPandas().v:
        s = max(0.0, s + (0 if pd.isna(v) else v - 0.02 - 0.15))
        want.append(s)
    assert np.allclose(got.where("k = 0").orderBy("i").toPandas().cusum_up, want)


def test_runs_streaks_and_switches(spark):
    x = ticks(spark).withColumns({"up": F.col("v") > -1.2, "hi": F.coalesce(F.col("v") > 0.5, F.lit(False))})
    w = W.partitionBy("k").orderBy("i")
    same(scan.run_of_true_over_ticks(x, ["k"], "i", "up", "run"), runs.run_of_true(x, "up", w, "run"), ["run"])
    same(scan.run_of_state_over_ticks(x, ["k"], "i", "st", "dur", "sw"), runs.run_of_state(x, "st", w, "dur", "sw"), ["dur", "sw"])
    same(scan.signed_run_over_ticks(x, ["k"], "i", "hi", "run"), runs.signed_run(x, "hi", w, "run"), ["run"])
    same(scan.streaks_over_ticks(x, ["k"], "i", "st", "wins", "losses"), runs.streaks(x, ["k"], "i", "st", "wins", "losses"), ["wins", "losses"])


def test_one_state_over_all_slices_one_row_and_none(spark):
    x = ticks(spark).withColumn("on", F.lit(True))
    got = scan.run_of_true_over_ticks(x, ["k"], "i", "on", "run").where("k = 0").agg(F.max("run"), F.count("*")).first()
    assert got[0] == got[1]
    one = scan.ewm_over_ticks(x.where("i = 0"), ["k"], "i", {"y": ("v", 0.5, 1)}).collect()
    assert len(one) == 1
    assert scan.streaks_over_ticks(x.limit(0), ["k"], "i", "st", "a", "b").count() == 0


def test_a_key_of_a_million_rows_in_many_slices(spark):
    n = 1_000_000
    x = spark.range(n).select(F.lit("hot").alias("k"), F.col("id").alias("i"), F.sin(F.col("id") * 0.7).alias("v"), F.floor(F.col("id") / 25_000).cast("long").alias("_slice"))
    y = scan.ewm_over_ticks(x, ["k"], "i", {"y": ("v", 0.001, 1)})
    got = y.where(F.col("i") % 99_999 == 0).orderBy("i").toPandas()
    want = pd.Series(np.sin(np.arange(n) * 0.7)).ewm(alpha=0.001, adjust=False).mean()
    assert np.allclose(got.y, want[got.i])
    r = scan.run_of_true_over_ticks(x, ["k"], "i", F.col("i") != 123_456, "run").agg(F.max("run")).first()[0]
    assert r == n - 123_457
