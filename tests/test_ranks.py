"""Ranks in long frames against lists per row, and against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strikeline.operators import ranks
from strikeline.operators import windows as wn

RNG = np.random.default_rng(23)


def test_counts_in_frames():
    for n in (1, 2, 7, 64, 501):
        v = RNG.integers(0, max(2, n // 3), n).astype(float)
        v[RNG.random(n) < 0.1] = np.nan
        start = RNG.integers(0, n, n)
        stop = np.minimum(n, start + RNG.integers(0, n + 1, n))
        below, equal = ranks.counts_in_frames(v, start, stop, np.arange(n))
        w = np.where(np.isnan(v), np.inf, v)
        for i in range(n):
            frame = w[start[i] : stop[i]]
            assert (below[i], equal[i]) == ((frame < w[i]).sum(), (frame == w[i]).sum())


@pytest.mark.parametrize("rows,chunk", [(1, 50), (20, 20), (60, 100), (500, 64), (5000, 100)])
def test_equal_to_lists_per_row(spark, rows, chunk):
    n = 900
    pdf = pd.DataFrame({"i": range(n), "k": np.where(RNG.random(n) < 0.7, 0, RNG.integers(1, 3, n)), "v": RNG.integers(0, 40, n).astype(float)})
    x = spark.createDataFrame(pdf).withColumns({"k": F.when(F.col("k") != 2, F.col("k")), "v": F.when(F.rand(3) < 0.8, F.col("v")), "_slice": F.floor(F.col("i") / 37).cast("long")})
    w = W.partitionBy("k").orderBy("i")
    got = ranks.rank_over_ticks(x, ["k"], ["i"], "v", rows, 5, "p", "s", chunk_rows=chunk, scale=100.0).orderBy("i").toPandas()
    want = x.select("i", wn.pct_rank_of_last("v", w, rows, 5, 100.0).alias("p"), wn.share_at_or_below("v", w, rows, 5).alias("s")).orderBy("i").toPandas()
    assert list(got.columns) == ["i", "k", "v", "_slice", "p", "s"] and list(got.i) == list(want.i)
    for c in "ps":
        assert np.allclose(got[c].astype(float).fillna(-1), want[c].astype(float).fillna(-1))


def test_no_keys_no_rows_and_only_nulls(spark):
    x = spark.range(300).select(F.col("id").alias("i"), (F.col("id") % 7).alias("v"), F.floor(F.col("id") / 50).cast("long").alias("_slice"))
    got = ranks.rank_over_ticks(x, [], ["i"], "v", 100, 1, "p", None).orderBy("i").toPandas()
    assert np.allclose(got.p, pd.Series(np.arange(300) % 7).rolling(100, min_periods=1).rank(pct=True))
    assert ranks.rank_over_ticks(x.limit(0), [], ["i"], "v", 100, 1).count() == 0
    none = ranks.rank_over_ticks(x.withColumn("v", F.lit(None).cast("double")), [], ["i"], "v", 100, 1).toPandas()
    assert len(none) == 300 and none.pct_rank.isna().all() and none.share_le.isna().all()


def test_a_frame_of_ten_thousand_over_a_hot_key(spark):
    n = 200_000
    x = spark.range(n).select(F.lit("hot").alias("k"), F.col("id").alias("i"), F.round(F.sin(F.col("id") * 0.37) * 1000).alias("v"), F.floor(F.col("id") / 20_000).cast("long").alias("_slice"))
    got = ranks.rank_over_ticks(x, ["k"], ["i"], "v", 10_000, 1, "p", None, chunk_rows=20_000).orderBy("i").toPandas()
    assert np.allclose(got.p, got.v.rolling(10_000, min_periods=1).rank(pct=True))
