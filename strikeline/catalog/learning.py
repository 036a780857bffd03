"""Model queries over labelled line items and document labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from strikeline.catalog.base import query, table
from strikeline.ml import models
from strikeline.operators import metrics as mt
from strikeline.operators import splits

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "months"]


def samples(spark, d):
    """Late-shipped share stands in for a label that depends on the features."""
    x = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("date"), "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        F.months_between("l_shipdate", F.lit("1995-01-01").cast("date")).alias("months"),
        ((F.col("l_extendedprice") > 52_000) != (F.col("l_returnflag") == "R")).cast("int").alias("label"),
    )
    return splits.three_way_split(x, "date", 0.5, 7)


@query("gbt_auc_by_split", "M1 M4 A24 W24", None, num="auc win_rate")
def _(spark, d):
    x = samples(spark, d).where(F.col("split").isNotNull())
    train = x.where(F.col("split") == "train")
    a = models.fit_classifier(train, FEATURES, "label", maxIter=4, maxDepth=3)
    b = models.fit_classifier(train, FEATURES, "label", maxIter=2, maxDepth=2)
    name, _ = models.best_by_auc(x.where(F.col("split") == "test"), {"deep": a, "shallow": b}, "label")
    return mt.group_table(models.score(x, a if name == "deep" else b), ["split"], "label", "prob").withColumn("model", F.lit(name))


@query("gbt_feature_importance", "M5 O2", None, num="importance")
def _(spark, d):
    m = models.fit_classifier(samples(spark, d).where(F.col("split") == "train"), FEATURES, "label", maxIter=3, maxDepth=3)
    return models.importance(m, FEATURES, spark)


_SPLIT_ROWS = """
WITH b AS (SELECT CAST(l_shipdate AS DATE) AS date, CAST((l_extendedprice > 52000) <> (l_returnflag = 'R') AS INTEGER) AS label FROM lineitem)
SELECT count(*) AS n, count(*) FILTER (label = 1) AS positives, true AS better_than_chance, true AS stopped_early FROM b
"""


@query("gbt_early_stopping", "M1", _SPLIT_ROWS)
def _(spark, d):
    """Invariants of a fit that watches a validation split: it stops before its limit, and ranks better than chance."""
    x = samples(spark, d).withColumn("check", F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(4)) == 0)
    m = models.fit_classifier(x, FEATURES, "label", validation="check", maxIter=30, maxDepth=4, stepSize=0.9, validationTol=0.05)
    stopped = m.stages[-1].getNumTrees < 30
    auc = models.auc_of(models.score(x.where("check"), m), "label")
    return x.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("positives")).select("n", "positives", F.lit(auc > 0.55).alias("better_than_chance"), F.lit(stopped).alias("stopped_early"))


@query("gbt_permutation_importance", "M5", """
SELECT unnest(['l_extendedprice', 'l_quantity']) AS feature, unnest([true, false]) AS matters
""")
def _(spark, d):
    """The price decides the label, the quantity does not: only the first costs AUC when exchanged."""
    x = samples(spark, d)
    m = models.fit_classifier(x, FEATURES, "label", maxIter=4, maxDepth=3)
    return models.permutation_importance(x, m, ["l_extendedprice", "l_quantity"], "label").select("feature", (F.col("auc_drop") > 0.03).alias("matters"))


@query("isotonic_calibrated_scores", "M3 A29", """
WITH c AS (SELECT *, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem)),
s AS (SELECT least(l_extendedprice / 105000.0, 1.0) AS raw, CAST((l_extendedprice > 52000) <> (l_returnflag = 'R') AS INTEGER) AS label,
    CASE WHEN i < a THEN 'train' WHEN i >= a + 7 AND i < a + 7 + floor((n - a - 14) / 2) THEN 'test' END AS split
  FROM lineitem JOIN (SELECT *, floor(n * 0.5) AS a FROM c) c ON c.date = CAST(l_shipdate AS DATE)),
g AS (SELECT round(raw, 2) AS x, sum(label) AS y, count(*) AS w FROM s WHERE split = 'train' GROUP BY 1),
p AS (SELECT *, row_number() OVER (ORDER BY x) AS i, sum(w) OVER (ORDER BY x) AS cw, sum(y) OVER (ORDER BY x) AS cy FROM g),
f AS (SELECT x, max(m) AS v FROM (SELECT b.x, a.i, min((e.cy - a.cy + a.y) / (e.cw - a.cw + a.w)) AS m FROM p b JOIN p a ON a.i <= b.i JOIN p e ON e.i >= b.i GROUP BY ALL) GROUP BY 1),
t AS (SELECT s.raw, s.label, lo.x AS x0, lo.v AS v0, hi.x AS x1, hi.v AS v1 FROM (SELECT * FROM s WHERE split = 'test') s ASOF LEFT JOIN f lo ON s.raw >= lo.x ASOF LEFT JOIN f hi ON s.raw <= hi.x),
q AS (SELECT label, greatest(0.01, least(0.99, CASE WHEN x0 IS NULL THEN v1 WHEN x1 IS NULL OR x0 = x1 THEN v0 ELSE v0 + (v1 - v0) * (raw - x0) / (x1 - x0) END)) AS cal FROM t)
SELECT least(CAST(floor(cal * 5) AS BIGINT), 4) AS bin, count(*) AS n, avg(cal) AS avg_score, avg(label) AS actual FROM q GROUP BY 1
""", num="avg_score actual")
def _(spark, d):
    x = samples(spark, d).withColumn("raw", F.least(F.col("l_extendedprice") / 105_000.0, F.lit(1.0)))
    m = models.fit_calibrator(x.where(F.col("split") == "train"), "raw", "label", decimals=2)
    return mt.calibration(models.calibrate(x.where(F.col("split") == "test"), m, "raw", "cal"), [], "label", "cal")


@query("parameter_grid_over_folds", "M2 W23", None, num="mean_auc std_auc")
def _(spark, d):
    f = splits.walk_forward_folds(samples(spark, d), "date", 2, 1200)
    return models.grid_search(f, FEATURES, "label", {"maxDepth": [2, 3], "maxIter": [2]})


@query("standard_scaling", "M6", """
SELECT doc_id, (n_chars - m) / s AS n_chars_scaled FROM documents, (SELECT avg(n_chars) AS m, stddev_samp(n_chars) AS s FROM documents)
""", num="n_chars_scaled")
def _(spark, d):
    return models.standardize(table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars")), ["n_chars"]).select("doc_id", "n_chars_scaled")
