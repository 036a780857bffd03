"""The split-key operators against brute force, with one key holding most rows."""

import datetime as dt
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strikeline.operators import windows as wn
from strikeline.operators.asof import asof_join
from strikeline.operators.barrier import first_touch
from strikeline.operators.dedup import keep_one
from strikeline.operators.metrics import roc_auc
from strikeline.operators.radix import exact_quantiles
from strikeline.operators.slicing import rolling_over_ticks, row_index, with_time_slice

RNG = np.random.default_rng(5)
T0 = pd.Timestamp("2024-01-01")


def hot(n=600):
    """Two thirds of the rows share one key; several days; repeated times."""
    return pd.DataFrame(
        {"id": range(n), "k": np.where(RNG.random(n) < 0.66, 0, RNG.integers(1, 4, n)), "t": T0 + pd.to_timedelta(RNG.integers(0, 4 * 86_400, n), unit="s"), "v": RNG.normal(50, 10, n).round(2)}
    )


def frame(spark, pdf):
    return spark.createDataFrame(pdf).withColumn("t", F.col("t").cast("timestamp_ntz"))


@pytest.mark.parametrize("direction, strict", [("backward", False), ("backward", True), ("forward", False), ("forward", True)])
def test_asof_join(spark, direction, strict):
    a, b = hot(), hot(300)
    out = asof_join(frame(spark, a), frame(spark, b), ["k"], "t", "t", {"bt": "t", "bid": "id"}, direction, strict, slice_seconds=6 * 3600).toPandas()
    got = dict(zip(out["id"], out["bt"]))
    for r in a.itertuples():
        c = b[b.k == r.k].t
        if direction == "backward":
            c = c[c < r.t] if strict else c[c <= r.t]
            want = c.max() if len(c) else None
        else:
            c = c[c > r.t] if strict else c[c >= r.t]
            want = c.min() if len(c) else None
        assert (pd.isna(got[r.id]) and want is None) or got[r.id] == want


@pytest.mark.parametrize("slice_seconds, dense", [(900, False), (7200, False), (40_000, False), (7200, True), (40_000, True)])
def test_first_touch(spark, slice_seconds, dense):
    p = hot(500).drop_duplicates(["k", "t"])
    e = hot(120).rename(columns={"id": "eid"})
    e["z"], e["up"], e["down"] = e.t + pd.Timedelta(hours=20), e.v + 12, e.v - 12
    ed = frame(spark, e).withColumn("z", F.col("z").cast("timestamp_ntz"))
    out = first_touch(ed, frame(spark, p), ["k"], ["eid"], "t", "z", "t", "v", [("up", ">=", "up"), ("down", "<=", "down")], slice_seconds, dense).toPandas().set_index("eid")
    for r in e.itertuples():
        c = p[(p.k == r.k) & (p.t > r.t) & (p.t <= r.z)].sort_values("t")
        if c.empty:
            assert r.eid not in out.index
            continue
        for name, hits in (("up", c[c.v >= r.up]), ("down", c[c.v <= r.down])):
            got = out.loc[r.eid, f"{name}_t"]
            assert (pd.isna(got) and hits.empty) or got == hits.t.iloc[0]
        assert out.loc[r.eid, "last_v"] == c.v.iloc[-1]


def test_exact_quantiles_and_median_of_one(spark):
    pdf = hot()
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    out = exact_quantiles(frame(spark, pdf), ["k"], "v", probs, most=40).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        assert np.allclose(out.loc[k, "quantiles"], np.quantile(g.v, probs))
    whole = exact_quantiles(frame(spark, pdf), [], "v", probs, most=40).first()
    assert np.allclose(whole["quantiles"], np.quantile(pdf.v, probs))
    one = spark.createDataFrame([(1, 3.0)], "k int, v double")
    assert exact_quantiles(one, ["k"], "v", [0.5]).first()["quantiles"] == [3.0]


def test_auc_with_ties_and_single_class(spark):
    pdf = hot()
    pdf["y"], pdf["s"] = (RNG.random(len(pdf)) < 0.4).astype(int), pdf.v.round(-1)
    pdf.loc[pdf.k == 3, "y"] = 1
    out = roc_auc(frame(spark, pdf), ["k"], "y", "s", most=40).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        pos, neg = g[g.y == 1].s.to_numpy(), g[g.y == 0].s.to_numpy()
        if len(neg) == 0:
            assert pd.isna(out.loc[k, "auc"])
            continue
        pairs = (pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean()
        assert out.loc[k, "auc"] == pytest.approx(pairs)


def test_row_index_and_rolling(spark):
    pdf = hot()
    s = with_time_slice(frame(spark, pdf), "t", 5 * 3600)
    idx = row_index(s, ["k"], ["t", "id"]).toPandas()
    for _, g in idx.sort_values(["t", "id"]).groupby("k"):
        assert list(g["_rn"]) == list(range(len(g)))
    out = rolling_over_ticks(s, ["k"], ["t", "id"], "_slice", 7, lambda w: {"m": wn.rolling_mean("v", w, 7, 3), "sd": wn.rolling_std("v", w, 7)}, chunk_rows=20).toPandas()
    assert len(out) == len(pdf)
    for _, g in out.sort_values(["t", "id"]).groupby("k"):
        assert np.allclose(g.m, g.v.rolling(7, min_periods=3).mean(), equal_nan=True)
        assert np.allclose(g.sd, g.v.rolling(7).std(), equal_nan=True)


def test_ewm_matches_pandas(spark):
    pdf = pd.DataFrame({"k": 1, "i": range(300), "v": RNG.normal(100, 5, 300)})
    out = wn.with_ewm(spark.createDataFrame(pdf), ["k"], "i", {"a": wn.span("v", 5), "b": ("v", 0.4, 3)}).toPandas().sort_values("i")
    assert np.allclose(out.a, pdf.v.ewm(span=5, adjust=False, min_periods=5).mean(), equal_nan=True)
    assert np.allclose(out.b, pdf.v.ewm(alpha=0.4, adjust=False, min_periods=3).mean(), equal_nan=True)


def test_keep_one(spark):
    pdf = hot()
    got = keep_one(frame(spark, pdf), ["k"], ["t", "id"]).toPandas().set_index("k")["id"].to_dict()
    want = pdf.sort_values(["t", "id"]).groupby("k").id.last().to_dict()
    assert got == want


def test_isotonic_matches_pooling(spark):
    from strikeline.ml.models import calibrate, fit_calibrator

    pdf = pd.DataFrame({"p": RNG.random(200).round(2)})
    pdf["y"] = (RNG.random(200) < pdf.p).astype(int)
    df = spark.createDataFrame(pdf)
    out = calibrate(df, fit_calibrator(df, "p", "y"), "p", "c", 0.0, 1.0).toPandas().sort_values("p")
    blocks = []
    for x, g in pdf.groupby("p"):
        blocks.append([g.y.mean(), len(g), [x]])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, n, xs = blocks.pop()
            a, b, ys = blocks.pop()
            blocks.append([(m * n + a * b) / (n + b), n + b, ys + xs])
    want = {x: m for m, _, xs in blocks for x in xs}
    assert np.allclose(out.c, out.p.map(want))


def test_ewm_over_gaps_matches_pandas(spark):
    """A value in six rows, a long silence, and a series far longer than any weight lasts."""
    from strikeline.operators import windows as wn

    rng = np.random.default_rng(3)
    x = rng.normal(100, 10, 3000)
    x[rng.random(3000) < 0.8] = np.nan
    x[500:700] = np.nan
    x[:7] = np.nan
    df = spark.createDataFrame([("a", i, None if np.isnan(v) else float(v)) for i, v in enumerate(x)], "k string, t int, x double")
    for alpha in (0.02, 0.4, 0.97, 1.0):
        got = wn.with_ewm(df, ["k"], "t", {"aged": ("x", alpha, 1), "later": ("x", alpha, 20)})
        got = wn.with_ewm(got, ["k"], "t", {"skipped": ("x", alpha, 1)}, ignore_null=True).orderBy("t").toPandas()
        s = pd.Series(x)
        for out, kw in (("aged", {}), ("skipped", {"ignore_na": True}), ("later", {"min_periods": 20})):
            np.testing.assert_allclose(got[out].to_numpy(float), s.ewm(alpha=alpha, adjust=False, **kw).mean(), rtol=1e-9, err_msg=f"{out} {alpha}")


def test_cusum_matches_the_recursion(spark):
    from strikeline.operators import windows as wn

    rng = np.random.default_rng(4)
    r = rng.normal(0, 1, 500)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(r)], "t int, r double")
    got = wn.with_cusum(df, wn.series([], "t"), "r", F.lit(0.1), F.lit(0.5)).orderBy("t").toPandas()
    up = down = 0.0
    for i, v in enumerate(r):
        up, down = max(0.0, up + v - 0.1 - 0.25), max(0.0, down - (v - 0.1 + 0.25))
        assert abs(got.cusum_up[i] - up) < 1e-9 and abs(got.cusum_down[i] - down) < 1e-9


def test_null_keys_are_a_group_of_their_own(spark):
    from strikeline.operators import metrics as mt
    from strikeline.operators.asof import asof_join
    from strikeline.operators.radix import exact_quantiles

    df = spark.createDataFrame([(k, float(v), v % 2) for k in (None, "a") for v in range(11)], "k string, v double, y int")
    got = {r.k: (r.n, list(r.q)) for r in exact_quantiles(df, ["k"], "v", [0.25, 0.5], out="q").collect()}
    assert got == {None: (11, [2.5, 5.0]), "a": (11, [2.5, 5.0])}
    auc = {r.k: r.auc for r in mt.roc_auc(df, ["k"], "y", "v").collect()}
    assert set(auc) == {None, "a"} and auc[None] == auc["a"] is not None
    t = spark.createDataFrame([(None, 5.0), ("a", 5.0)], "k string, t double").withColumn("t", F.timestamp_seconds("t"))
    r = df.withColumn("t", F.timestamp_seconds("v"))
    assert {x.k: x.seen for x in asof_join(t, r, ["k"], "t", "t", {"seen": "v"}).collect()} == {None: 5.0, "a": 5.0}


def test_impute_uses_one_row_of_medians(spark):
    from strikeline.operators.clean import impute

    df = spark.createDataFrame([(i, float(i) if i % 3 else None, None) for i in range(9)], "i int, a double, b double")
    got = impute(df, ["a", "b"]).orderBy("i").collect()
    assert got[0].a == 4.5 and got[1].a == 1.0 and got[0].b is None


def test_incremental_keeps_every_key_of_a_date(spark, tmp_path):
    from strikeline.sources import writers

    old = spark.createDataFrame([("2024-01-01", "x", 1, 0), ("2024-01-01", "y", 2, 0), ("2024-01-02", "x", 3, 0)], "date string, k string, v int, at int")
    writers.overwrite(old, str(tmp_path / "a"))
    new = spark.createDataFrame([("2024-01-02", "x", 4, 1), ("2024-01-02", "x", 5, 2), ("2024-01-02", "z", 6, 1)], old.schema)
    got = writers.write_incremental(spark, new, str(tmp_path / "a"), str(tmp_path / "b"), "date", ["date", "k"], ["at"])
    assert sorted((r.date[-2:], r.k, r.v) for r in got.collect()) == [("01", "x", 1), ("01", "y", 2), ("02", "x", 5), ("02", "z", 6)]


def test_no_leakage_from_later_rows(spark, sf_dir):
    """Changing everything after a minute or date leaves earlier features untouched."""
    from strikeline.catalog import base
    from strikeline.operators import indicators as ind

    bars = base.bars5(spark, sf_dir).where(F.col("sym") == "view")
    cut = F.lit("2024-01-10 12:00:00").cast("timestamp_ntz")
    later = F.col("bar") >= cut
    changed = bars.withColumns({c: F.when(later, F.col(c) * 3).otherwise(F.col(c)) for c in ("open", "high", "low", "close")})

    def before(df):
        x = ind.session_features(df, ["sym"], "d", "bar").where(~later).select("bar", *[c for c in ind.SESSION if not c.startswith("orb")])
        return x.orderBy("bar").toPandas()

    pd.testing.assert_frame_equal(before(bars), before(changed))
    daily = base.daily(spark, sf_dir).withColumnRenamed("d", "date")
    day = F.lit("1998-01-01").cast("date")
    moved = daily.withColumn("close", F.when(F.col("date") >= day, F.col("close") * 2).otherwise(F.col("close")))

    def prior(df):
        from strikeline.plans.daily import technicals_prior

        return technicals_prior(df, ["sym"]).where(F.col("date") <= day).orderBy("sym", "date").toPandas()

    pd.testing.assert_frame_equal(prior(daily), prior(moved))


def test_shared_dir_is_read_from_the_session(spark):
    from strikeline.session import shared_dir

    assert os.path.isdir(shared_dir(spark)) and spark.conf.get("spark.checkpoint.dir") == shared_dir(spark)


def test_upsert_touches_only_the_partitions_of_new_rows(spark, tmp_path):
    from strikeline.sources import writers

    path = str(tmp_path / "t")
    old = spark.createDataFrame([(k, 1, k % 4) for k in range(40)], "k long, v int, part long")
    writers.write_upsert(spark, old, path, ["k"], ["v"], ["part"])
    before = {p: sorted(os.listdir(f"{path}/part={p}")) for p in range(4)}
    got = writers.write_upsert(spark, spark.createDataFrame([(5, 2, 1), (5, 3, 1), (101, 9, 1)], old.schema), path, ["k"], ["v"], ["part"])
    rows = {r.k: r.v for r in got.collect()}
    assert len(rows) == got.count() == 41 and rows[5] == 3 and rows[101] == 9 and rows[9] == 1
    after = {p: sorted(os.listdir(f"{path}/part={p}")) for p in range(4)}
    assert [p for p in range(4) if before[p] != after[p]] == [1]


def _with_shuffled_joins(spark, build):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return build()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_splits_and_folds_send_the_calendar_to_the_rows(spark):
    from strikeline.operators import splits

    x = spark.range(400).select(F.expr("date_add(DATE'2020-01-01', CAST(id % 100 AS INT))").alias("date"), "id")
    for build in (
        lambda: splits.three_way_split(x, "date", 0.5, 7), lambda: splits.walk_forward_folds(x, "date", 2, 50),
        lambda: splits.last_dates(x, "date", 9), lambda: splits.last_share(x, "date", 0.2),
    ):
        assert "SortMergeJoin" not in _with_shuffled_joins(spark, build)


def test_quantiles_are_sent_to_the_rows(spark):
    from strikeline.operators import audit, metrics

    x = spark.range(300).select((F.col("id") % 2).alias("k"), F.col("id").cast("double").alias("v"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    for build in (lambda: metrics.skip_rate_sweep(x, ["k"], "y", "v", "v", [0.1, 0.5]), lambda: audit.outlier_counts(x, ["v", "y"])):
        assert "BroadcastHashJoin" in _with_shuffled_joins(spark, build)


def test_rows_of_large_partitions_are_dealt_out_before_a_fit(spark):
    from strikeline.ml import models

    x = spark.range(0, 1000, 1, 2).select("id")
    assert models.in_small_tasks(x, 600).rdd.getNumPartitions() == 2
    y = models.in_small_tasks(x, 100)
    assert y.rdd.getNumPartitions() == 10 and y.distinct().count() == 1000
    assert max(len(p) for p in y.rdd.glom().collect()) < 200


def test_permutation_writes_scores_and_not_rows(spark, monkeypatch):
    from strikeline.ml import models

    x = spark.range(4000).select((F.col("id") * 7919 % 1000).cast("double").alias("a"), (F.col("id") * 104729 % 997).cast("double").alias("b"), "id")
    x = x.withColumn("y", (F.col("a") > 500).cast("int"))
    m = models.fit_classifier(x, ["a", "b"], "y", maxIter=2, maxDepth=2)
    written, settle = [], models.settle
    monkeypatch.setattr(models, "settle", lambda df, label: written.append(df.columns) or settle(df, label))
    drops = {r.feature: r.auc_drop for r in models.permutation_importance(x, m, ["a", "b"], "y").collect()}
    assert written == [["which", "prob", "label", "n"]]
    assert drops["a"] > 0.3 and abs(drops["b"]) < 0.01


def test_slices_of_ticks_hold_few_rows(spark, tmp_path):
    from strikeline.catalog import ticks

    spark.range(20_000).select(F.col("id").alias("event_id"), F.lit("a").alias("event_type"), F.timestamp_seconds(F.col("id") * 4).alias("ts"), F.lit(1.0).alias("value")).write.parquet(f"{tmp_path}/events.parquet")
    assert ticks._events(spark, str(tmp_path)).groupBy("_slice").count().agg(F.max("count")).first()[0] <= 4_000
