"""Bit order, selection and slices against NumPy, down to the last level."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strikeline.operators import radix
from strikeline.operators.metrics import roc_auc

RNG = np.random.default_rng(5)


def odd_values() -> np.ndarray:
    powers = np.ldexp(1.0, np.arange(-1074, 1024, 7))
    near = np.concatenate([powers, np.nextafter(powers, 0), np.nextafter(powers, np.inf)])
    raw = RNG.integers(0, 2**63, 3000).astype(np.uint64).view(np.float64)
    x = np.concatenate([near, raw[np.isfinite(raw)], [0.0, np.inf, np.finfo(float).max, np.finfo(float).tiny]])
    return np.concatenate([x, -x])


def test_order_bits_are_the_bits_of_the_format(spark):
    x = odd_values()
    got = radix.with_order_bits(spark.createDataFrame(pd.DataFrame({"v": x})), "v").toPandas()
    raw = np.abs(got.v.to_numpy()).view(np.int64)
    assert (got._bits.to_numpy() == np.where(got.v < 0, -raw, raw)).all()


def test_order_bits_of_missing_and_odd_numbers(spark):
    df = spark.sql("SELECT * FROM VALUES (1, CAST('NaN' AS DOUBLE)), (2, CAST('inf' AS DOUBLE)), (3, 0.0D), (4, -0.0D), (5, CAST(NULL AS DOUBLE)), (6, CAST('-inf' AS DOUBLE)) AS t(i, v)")
    bits = {r.i: r._bits for r in radix.with_order_bits(df, "v").collect()}
    assert bits[1] > bits[2] > bits[3] == bits[4] == 0 > bits[6] and bits[5] is None


@pytest.mark.parametrize("most", [3, 50, 1_000_000])
def test_quantiles_at_every_depth(spark, most):
    n = 4000
    parts = {
        "close": 1.0 + RNG.integers(0, 500, n) * 2.0**-52,  # differ in the last bits only
        "equal": np.full(n, 7.25),
        "heavy": np.exp(RNG.normal(0, 60, n)) * RNG.choice([-1, 1], n),
        "ties": RNG.integers(-3, 4, n).astype(float),
        "one": np.array([2.5]),
    }
    pdf = pd.concat([pd.DataFrame({"k": k, "v": v}) for k, v in parts.items()], ignore_index=True)
    probs = [0.0, 0.013, 0.5, 0.77, 1.0]
    df = spark.createDataFrame(pdf).unionByName(spark.sql("SELECT 'none' AS k, CAST(NULL AS DOUBLE) AS v"))
    got = {r.k: r for r in radix.exact_quantiles(df, ["k"], "v", probs, most=most).collect()}
    assert set(got) == set(parts)
    for k, v in parts.items():
        assert got[k].n == len(v)
        np.testing.assert_allclose(got[k].quantiles, np.quantile(v, probs), rtol=1e-12)
    whole = radix.exact_quantiles(df, [], "v", probs, most=most).first()
    np.testing.assert_allclose(whole.quantiles, np.quantile(pdf.v, probs), rtol=1e-12)


def test_quantiles_of_nothing_and_of_whole_numbers(spark):
    none = spark.createDataFrame([], "k int, v double")
    assert radix.exact_quantiles(none, ["k"], "v", [0.5]).collect() == []
    assert radix.exact_quantiles(none, [], "v", [0.5]).first().n is None
    whole = spark.range(11).select(F.col("id").alias("v"))
    assert radix.exact_quantiles(whole, [], "v", [0.25]).first().quantiles == [2.5]


@pytest.mark.parametrize("most", [7, 100])
def test_slices_are_small_and_in_order(spark, most):
    v = np.concatenate([1.0 + np.arange(900) * 2.0**-52, RNG.normal(0, 1000, 900), -np.exp(RNG.normal(0, 50, 300))])
    pdf = pd.DataFrame({"k": RNG.integers(0, 2, len(v)), "v": v}).drop_duplicates()
    df = spark.createDataFrame(pdf).unionByName(spark.sql("SELECT 0 AS k, CAST(NULL AS DOUBLE) AS v"))
    cut = radix.with_value_slice(df, ["k"], "v", most)
    assert [r["_slice"] for r in cut.where("v IS NULL").collect()] == [None]
    got = cut.where("v IS NOT NULL").toPandas()  # with a NULL, the longs would turn into doubles
    assert len(got) == len(pdf)
    assert got.groupby(["k", "_slice"]).size().max() <= 2 * most
    for _, g in got.groupby("k"):
        assert g.sort_values("v")["_slice"].is_monotonic_increasing
        assert g["_slice"].nunique() >= len(g) / (2 * most)


def test_auc_over_deep_slices(spark):
    s = np.concatenate([1.0 + RNG.integers(0, 300, 600) * 2.0**-52, RNG.random(600)])
    pdf = pd.DataFrame({"y": (RNG.random(1200) < 0.3).astype(int), "s": s})
    pos, neg = pdf[pdf.y == 1].s.to_numpy(), pdf[pdf.y == 0].s.to_numpy()
    expected = (pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean()
    assert roc_auc(spark.createDataFrame(pdf), [], "y", "s", most=9).first().auc == pytest.approx(expected)
