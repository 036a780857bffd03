"""Data-quality audits in single passes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strikeline.operators.radix import exact_quantiles


def column_profile(df: DataFrame, cols: Sequence[str], distinct: bool = True) -> DataFrame:
    """Nulls, zeros, infinities, range, mean and spread, one row per column, one scan."""
    inf = float("inf")
    aggs: list[Column] = [F.count(F.lit(1)).alias("_n")]
    for c in cols:
        x = F.col(c).cast("double")
        good = F.when(~F.isnan(x) & (F.abs(x) != inf), x)
        aggs += [
            F.count(c).alias(f"_v_{c}"), F.count_if(x == 0).alias(f"_z_{c}"), F.count_if(F.abs(x) == inf).alias(f"_i_{c}"),
            F.min(good).alias(f"_lo_{c}"), F.max(good).alias(f"_hi_{c}"), F.avg(good).alias(f"_m_{c}"), F.stddev_samp(good).alias(f"_s_{c}"),
        ]
    one = df.agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"), F.col("_n").alias("rows"), (F.col("_n") - F.col(f"_v_{c}")).alias("nulls"),
                F.col(f"_z_{c}").alias("zeros"), F.col(f"_i_{c}").alias("infs"), F.col(f"_lo_{c}").alias("min"),
                F.col(f"_hi_{c}").alias("max"), F.col(f"_m_{c}").alias("mean"), F.col(f"_s_{c}").alias("std"),
            )
            for c in cols
        ]
    )
    out = one.select(F.explode(rows).alias("_r")).select("_r.*")
    if not distinct:
        return out
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("v")) for c in cols])).alias("_p"))
    # distinct values first, then a count: the second step has no per-group buffer
    uniq = long.select("_p.feature", "_p.v").where(F.col("v").isNotNull()).distinct().groupBy("feature").agg(F.count(F.lit(1)).alias("distinct_values"))
    return out.join(uniq, "feature", "left").withColumn("distinct_values", F.coalesce("distinct_values", F.lit(0)))


def rule_counts(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """How many rows break each rule; one row per rule, one scan."""
    one = df.agg(*[F.count_if(r).alias(n) for n, r in rules.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])
    return one.select(F.explode(pairs).alias("_p")).select("_p.*")


def chain_rules() -> dict[str, Column]:
    """Sanity rules for an intraday chain with greeks. The thresholds below."""
    c = F.col
    call, put = c("right") == "call", c("right") == "put"
    return {
        "call_delta_range": call & ((c("delta") < -0.01) | (c("delta") > 1.01)),
        "put_delta_range": put & ((c("delta") < -1.01) | (c("delta") > 0.01)),
        "gamma_negative": c("gamma") < -0.0001,
        "gamma_over_05": c("gamma") > 0.05,
        "gamma_zero": c("gamma") == 0,
        "theta_positive": c("theta") > 0.01,
        "vega_negative": c("vega") < -0.01,
        "iv_range": (c("implied_vol") < 0) | (c("implied_vol") > 5.0),
        "rho_call_negative": call & (c("rho") < -0.01),
        "rho_put_positive": put & (c("rho") > 0.01),
        "bid_over_ask": c("bid") > c("ask") + 0.01,
        "bid_negative": c("bid") < -0.001,
        "mid_mismatch": F.abs(c("mid") - (c("bid") + c("ask")) / 2.0) > 0.01,
        "strike_range": (c("strike") < 2000) | (c("strike") > 7000),
        "side_unknown": ~(call | put),
    }


def rows_per_day(df: DataFrame, date: str) -> DataFrame:
    """Row count per day with sparse (<10 % of median) and dense (>3x median) flags."""
    day = df.groupBy(date).agg(F.count(F.lit(1)).alias("rows"))
    median = exact_quantiles(day, [], "rows", [0.5]).select(F.col("quantiles")[0]).scalar()
    x = day.withColumn("median_rows", median)
    return x.withColumns({"sparse": (F.col("rows") < F.col("median_rows") * 0.1).cast("long"), "dense": (F.col("rows") > F.col("median_rows") * 3).cast("long")})


def rows_per_month(df: DataFrame, date: str) -> DataFrame:
    day = df.groupBy(date).agg(F.count(F.lit(1)).alias("_n"))
    return day.groupBy(F.date_format(date, "yyyy-MM").alias("month")).agg(
        F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("days"), F.avg("_n").alias("avg_per_day")
    )


def outlier_counts(df: DataFrame, cols: Sequence[str], low: float = 0.001, high: float = 0.999) -> DataFrame:
    """Rows beyond the extreme quantiles of each column; the quantiles, a row per column, are sent to the rows."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in cols])).alias("_p")).select("_p.*")
    long = long.where(F.col("v").isNotNull())
    q = exact_quantiles(long, ["feature"], "v", [low, high]).select("feature", F.col("quantiles")[0].alias("q_low"), F.col("quantiles")[1].alias("q_high"))
    return long.join(F.broadcast(q), "feature").groupBy("feature").agg(
        F.max("q_low").alias("q_low"), F.max("q_high").alias("q_high"),
        F.count_if(F.col("v") < F.col("q_low")).alias("below"), F.count_if(F.col("v") > F.col("q_high")).alias("above"),
    )


def freshness(tables: Mapping[str, tuple[DataFrame | None, str]], expected: str) -> DataFrame:
    """OK / STALE / MISSING per table against the expected last date."""
    parts = []
    for name, (df, date) in tables.items():
        if df is None:
            continue
        parts.append(df.agg(F.max(F.col(date).cast("date")).alias("last_date")).select(F.lit(name).alias("table"), "last_date"))
    absent = [n for n, (df, _) in tables.items() if df is None]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if absent:
        names = F.explode(F.array(*[F.lit(n) for n in absent]))
        out = out.unionByName(parts[0].select(names.alias("table"), F.lit(None).cast("date").alias("last_date")))
    status = F.when(F.col("last_date").isNull(), "MISSING").when(F.col("last_date") >= F.lit(expected).cast("date"), "OK").otherwise("STALE")
    return out.withColumn("status", status)


def parity(left: DataFrame, right: DataFrame, keys: Sequence[str], features: Sequence[str], abs_tol: float = 1e-6, rel_tol: float = 1e-4) -> DataFrame:
    """Feature-by-feature comparison of two tables on a key.

    One full outer join on the key; features become rows only after the join.
    """
    a = left.select(*keys, F.struct(*[F.col(f).cast("double").alias(f) for f in features]).alias("_a"))
    b = right.select(*keys, F.struct(*[F.col(f).cast("double").alias(f) for f in features]).alias("_b"))
    both = a.join(b, list(keys), "full_outer")
    checks = []
    for f in features:
        x, y = F.col(f"_a.{f}"), F.col(f"_b.{f}")
        diff = F.abs(x - y)
        same = (x.isNull() & y.isNull()) | F.coalesce((diff < abs_tol) | (diff < rel_tol * F.abs(x)), F.lit(False))
        checks.append(F.struct(F.lit(f).alias("feature"), same.alias("same"), diff.alias("diff"), (x.isNull() != y.isNull()).alias("one_sided")))
    rows = both.select(*keys, F.explode(F.array(*checks)).alias("_c"))
    return rows.groupBy("_c.feature").agg(
        F.count(F.lit(1)).alias("compared"), F.count_if(F.col("_c.same")).alias("matched"),
        F.count_if(F.col("_c.one_sided")).alias("one_sided"), F.max("_c.diff").alias("max_abs_diff"),
    )


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.IntegerType, T.LongType, T.ShortType))]
