"""Sliced picks against the fold over whole groups, and against a plain loop."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strikeline.operators.picks import links_of, non_overlapping_sliced
from strikeline.operators.selection import non_overlapping

RNG = np.random.default_rng(31)
T0 = pd.Timestamp("2024-01-01")


def slots(spark, n=400, longest=9_000):
    pdf = pd.DataFrame({"id": range(n), "g": np.where(RNG.random(n) < 0.7, 0, RNG.integers(1, 4, n)), "s": T0 + pd.to_timedelta(np.arange(n) * 700 + RNG.integers(0, 699, n), unit="s")})
    pdf["e"] = pdf.s + pd.to_timedelta(RNG.integers(0, longest, n), unit="s")
    pdf.loc[RNG.random(n) < 0.1, "e"] = pdf.s
    pdf["reason"] = RNG.choice(["tp", "sl", "x"], n, p=[0.6, 0.02, 0.38])
    pdf["kind"] = RNG.choice(["a", "view"], n, p=[0.8, 0.2])
    x = spark.createDataFrame(pdf).withColumns({"g": F.when(F.col("g") != 3, F.col("g")), "e": F.when(F.col("id") % 37 != 0, F.col("e"))})
    return x


@pytest.mark.parametrize("seconds", [3_600, 40_000, 10_000_000])
@pytest.mark.parametrize("locks,stops", [(False, True), (True, False)])
def test_equal_to_the_fold(spark, seconds, locks, stops):
    x = slots(spark)
    args = (["g"], "s", "e", ["s", "id", "kind"])
    stop = F.col("reason") == "sl" if stops else None
    got = non_overlapping_sliced(x, *args, seconds, stop, F.col("kind") == "view", locks).toPandas()
    want = non_overlapping(x, *args, stop, F.col("kind") == "view", locks).toPandas()
    key = lambda d: sorted((str(r.g), r.id, bool(r.passive)) for r in d.itertuples())
    assert key(got) == key(want) and len(want) > 20
    assert set(got.columns) == {"g", "s", "id", "kind", "passive"}


def test_long_positions_over_many_slices_and_gaps(spark):
    x = slots(spark, longest=400_000)
    got = non_overlapping_sliced(x, ["g"], "s", "e", ["s", "id"], 600).toPandas()
    want = non_overlapping(x, ["g"], "s", "e", ["s", "id"]).toPandas()
    assert sorted(got.id) == sorted(want.id)


def test_no_rows_one_row_and_rows_without_a_start(spark):
    x = slots(spark, 30)
    assert non_overlapping_sliced(x.limit(0), ["g"], "s", "e", ["id"], 600).count() == 0
    assert [r.id for r in non_overlapping_sliced(x.where("id = 4"), ["g"], "s", "e", ["id"], 600).collect()] == [4]
    assert non_overlapping_sliced(x.withColumn("s", F.lit(None).cast("timestamp")), ["g"], "s", "e", ["id"], 600).count() == 0


def test_links():
    s, e = np.array([0, 5, 10, 15]), np.array([7, 5, 100, 15])
    assert links_of(s, e, np.zeros(4, bool), np.array([0, 0, 0, 1], bool)).tolist() == [2, 2, 4, -1]
    assert links_of(s, e, np.ones(4, bool), np.ones(4, bool)).tolist() == [1, 2, 3, 4]


def test_a_group_of_a_million_intervals(spark):
    n = 1_000_000
    x = spark.range(n).select(F.lit("hot").alias("g"), F.col("id"), F.timestamp_seconds(F.col("id")).alias("s"), F.timestamp_seconds(F.col("id") + 1 + F.pmod(F.xxhash64("id"), F.lit(50))).alias("e"))
    got = non_overlapping_sliced(x, ["g"], "s", "e", ["id"], 30_000).orderBy("id").toPandas().id.tolist()
    ends = x.orderBy("id").select(F.unix_seconds("e").alias("e")).toPandas().e.tolist()
    want, free = [], 0
    while free < n:
        want.append(free)
        free = ends[free]
    assert got == want
