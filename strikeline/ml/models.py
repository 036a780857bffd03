"""Tree models, scoring, calibration and tuning with Spark ML."""

from __future__ import annotations

import itertools
import math
from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.pipeline import Pipeline
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strikeline.operators.metrics import roc_auc
from strikeline.plans.tables import settle

FIT_ROWS = 500_000  # rows of a task while trees are fitted; they are kept as objects of some 200 bytes
PAIR_ROWS = 4_000  # rows of a bucket within which values are exchanged; windows keep so many in memory


def assembler(features: Sequence[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep")


def with_class_weight(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Weight positives by negatives over positives, a single number read as a subquery."""
    ratio = df.agg(F.try_divide(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1))).scalar()
    return df.withColumn("_r", ratio).withColumn(out, F.when(F.col(label) == 1, F.coalesce("_r", F.lit(1.0))).otherwise(1.0)).drop("_r")


def in_small_tasks(df: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """The same rows, dealt out anew where a partition holds more than ``2 * most`` (two numbers reach the driver)."""
    busiest, n = df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
    return df.repartition(math.ceil(n / most), F.monotonically_increasing_id()) if (busiest or 0) > 2 * most else df


def fit_classifier(df: DataFrame, features: Sequence[str], label: str, validation: str | None = None, **params) -> PipelineModel:  # noqa: ANN003
    """Boosted trees with class weights; ``validation`` marks rows for early stopping."""
    df = in_small_tasks(df.select(*dict.fromkeys([*features, label, *([validation] if validation else [])])))
    gbt = GBTClassifier(featuresCol="features", labelCol=label, weightCol="weight", **{"maxIter": 20, "maxDepth": 4, "seed": 7, **params})
    if validation:
        gbt = gbt.setValidationIndicatorCol(validation)
    return Pipeline(stages=[assembler(features), gbt]).fit(with_class_weight(df, label))


def score(df: DataFrame, model: PipelineModel, out: str = "prob") -> DataFrame:
    x = model.transform(df)
    return x.withColumn(out, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def score_levels(df: DataFrame, models: Mapping[str, PipelineModel]) -> DataFrame:
    """One probability column per level."""
    for level, model in models.items():
        df = score(df, model, f"prob_{level}")
    return df


def auc_of(scored: DataFrame, label: str, prob: str = "prob") -> float:
    """Overall area under the curve as a number (a single value reaches the driver)."""
    row = roc_auc(scored, [], label, prob).first()
    return float(row["auc"]) if row and row["auc"] is not None else float("nan")


def best_by_auc(df: DataFrame, candidates: Mapping[str, PipelineModel], label: str) -> tuple[str, dict[str, float]]:
    scores = {name: auc_of(score(df, m), label) for name, m in candidates.items()}
    return max(scores, key=lambda n: scores[n]), scores


def grid_search(folds: DataFrame, features: Sequence[str], label: str, grid: Mapping[str, Sequence]) -> DataFrame:
    """Mean validation score of every parameter combination over time-ordered folds.

    ``folds`` carries fold and role columns. Fold ids and combinations are a
    handful of driver values; every fit runs distributed.
    """
    ids = [r["fold"] for r in folds.select("fold").distinct().orderBy("fold").collect()]
    names = list(grid)
    rows = []
    for combo in itertools.product(*grid.values()):
        params = dict(zip(names, combo))
        for f in ids:
            part = folds.where(F.col("fold") == f)
            model = fit_classifier(part.where(F.col("role") == "train"), features, label, **params)
            rows.append((", ".join(f"{k}={v}" for k, v in params.items()), int(f), auc_of(score(part.where(F.col("role") == "val"), model), label)))
    table = folds.sparkSession.createDataFrame(rows, "params string, fold int, auc double")
    return table.groupBy("params").agg(F.count("auc").alias("folds"), F.avg("auc").alias("mean_auc"), F.stddev_pop("auc").alias("std_auc"))


def importance(model: PipelineModel, features: Sequence[str], spark) -> DataFrame:  # noqa: ANN001
    """Feature importances, highest first."""
    values = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, values)], "feature string, importance double").orderBy(F.desc("importance"), "feature")


def permutation_importance(df: DataFrame, model: PipelineModel, features: Sequence[str], label: str, seed: int = 7) -> DataFrame:
    """Loss of AUC when one feature is replaced by values of other rows.

    Values are exchanged within pairs of rows that a hash brings together, in buckets of
    about ``PAIR_ROWS`` rows, so no global sort or collection is needed. All features are exchanged in the
    same pairs, each for itself, and all scores come from one pass over the paired rows. The
    last row of a bucket of odd size keeps its values.
    """
    inputs = next(s.getInputCols() for s in model.stages if hasattr(s, "getInputCols"))
    key = F.xxhash64(F.lit(seed), *[F.col(c) for c in df.columns])
    rows = df.select(*dict.fromkeys([*inputs, *features, label]), key.alias("_key"))
    by = W.partitionBy(F.pmod("_key", F.lit(max(1, df.count() // PAIR_ROWS)))).orderBy("_key")
    first = F.row_number().over(by) % 2 == 1
    mates = {f"_v{i}": F.when(first, F.coalesce(F.lead(f).over(by), F.col(f))).otherwise(F.lag(f).over(by)) for i, f in enumerate(features)}
    x = rows.withColumns(mates).drop("_key")
    kept = [f"_f{i}" for i in range(len(features))]
    x = score(x.withColumns({k: F.col(f) for k, f in zip(kept, features)}), model, "_p")
    for i, f in enumerate(features):
        x = score(x.withColumn(f, F.col(f"_v{i}")), model, f"_p{i}").withColumn(f, F.col(kept[i]))
    variants = F.array(*[F.struct(F.lit(i).alias("which"), F.col(c).alias("prob")) for i, c in enumerate(["_p", *[f"_p{i}" for i in range(len(features))]])])
    scored = x.select(F.col(label).alias("label"), F.explode(variants).alias("_e")).select("label", "_e.which", "_e.prob")
    # equal scores are counted before they are ranked, and written once
    counts = settle(scored.groupBy("which", "prob", "label").agg(F.count(F.lit(1)).alias("n")), "scores")
    aucs = {r["which"]: r["auc"] for r in roc_auc(counts, ["which"], "label", "prob", weight="n").collect()}
    nan = float("nan")
    drops = [(f, (nan if aucs.get(0) is None else aucs[0]) - (nan if aucs.get(i + 1) is None else aucs[i + 1])) for i, f in enumerate(features)]
    return df.sparkSession.createDataFrame(drops, "feature string, auc_drop double")


def fit_calibrator(scored: DataFrame, prob: str, label: str, decimals: int = 5) -> IsotonicRegressionModel:
    """Isotonic fit on one weighted row per score, rounded to ``decimals``.

    Scores lie in [0, 1], so at most 10**decimals + 1 rows reach the step that pools them in one
    place, whatever the input. All rows count, through their weights.
    """
    scored = scored.withColumn(prob, F.round(F.col(prob).cast("double"), decimals))
    per = scored.groupBy(F.col(prob).alias("x")).agg(F.avg(F.col(label).cast("double")).alias("y"), F.count(F.lit(1)).cast("double").alias("w"))
    return IsotonicRegression(featuresCol="x", labelCol="y", weightCol="w").fit(per)


def calibrate(scored: DataFrame, model: IsotonicRegressionModel, prob: str, out: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    x = model.transform(scored.withColumn(model.getFeaturesCol(), F.col(prob)))
    return x.withColumn(out, F.greatest(F.lit(low), F.least(F.lit(high), "prediction"))).drop("prediction", model.getFeaturesCol())


def standardize(df: DataFrame, cols: Sequence[str], suffix: str = "_scaled") -> DataFrame:
    """Zero mean and unit sample spread per column."""
    stage = Pipeline(stages=[assembler(cols, "_raw"), StandardScaler(inputCol="_raw", outputCol="_std", withMean=True, withStd=True)])
    x = stage.fit(df).transform(df).withColumn("_a", vector_to_array("_std"))
    return x.select(*df.columns, *[F.col("_a")[i].alias(f"{c}{suffix}") for i, c in enumerate(cols)])
