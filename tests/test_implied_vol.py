"""Implied volatility as a column expression: repricing, wings, ends and unusable rows."""

import itertools

from pyspark.sql import functions as F

from strikeline.functions import bsm


def test_repricing_over_the_whole_surface(spark):
    rows = [
        (5000.0, 5000.0 * m, t, r, v, c)
        for m, t, r, v, c in itertools.product((0.6, 0.9, 0.99, 1.0, 1.03, 1.5), (1 / 8760, 1 / 365, 0.1, 2.0), (0.0, 0.05), (0.011, 0.1, 0.35, 1.2, 4.9), (True, False))
    ]
    x = spark.createDataFrame(rows, "s double, k double, t double, r double, v double, c boolean")
    x = x.withColumn("p", bsm.bs_price("s", "k", "t", F.col("r"), "v", F.col("c")))
    x = x.withColumn("iv", bsm.implied_vol("p", "s", "k", "t", F.col("r"), F.col("c")))
    x = x.withColumn("again", bsm.bs_price("s", "k", "t", F.col("r"), "iv", F.col("c")))
    # a price that no volatility moves says nothing of it
    x = x.withColumn("base", bsm.bs_price("s", "k", "t", F.col("r"), F.lit(0.01), F.col("c")))
    assert "Python" not in x._jdf.queryExecution().toString() and "Arrow" not in x._jdf.queryExecution().toString()
    known = 0
    for r in x.collect():
        if r.p <= max((r.s - r.k) if r.c else (r.k - r.s), 0.0) + 0.01:
            assert r.iv is None, r
        elif r.p > r.base + 1e-6 or r.iv is not None:
            known += 1
            assert r.iv is not None and abs(r.again - r.p) < 1e-8, r
    assert known > 100


def test_unusable_rows_are_null(spark):
    x = spark.sql("""SELECT * FROM VALUES (1, 0.0D, 5000.0D, 5000.0D, 0.1D), (2, 10.0D, 5000.0D, 5000.0D, -1.0D), (3, 50.0D, 5000.0D, 4900.0D, 0.1D),
        (4, CAST('NaN' AS DOUBLE), 5000.0D, 5000.0D, 0.1D), (5, CAST(NULL AS DOUBLE), 5000.0D, 5000.0D, 0.1D), (6, 10.0D, 5000.0D, 0.0D, 0.1D), (7, 10.0D, 5000.0D, 5000.0D, 0.0D),
        (8, 6000.0D, 5000.0D, 5000.0D, 0.1D), (9, 100.0D, CAST('NaN' AS DOUBLE), 5000.0D, 0.1D), (10, 100.0D, 5000.0D, 5000.0D, 0.1D) AS t(i, p, s, k, t)""")
    got = {r.i: r.iv for r in x.select("i", bsm.implied_vol("p", "s", "k", "t", F.lit(0.0), F.lit(True)).alias("iv")).collect()}
    assert [i for i, v in got.items() if v is not None] == [10]
    unknown = x.where("i = 10").select(bsm.implied_vol("p", "s", "k", "t", F.lit(0.0), F.lit(None).cast("boolean")).alias("iv"))
    assert unknown.first().iv is None
