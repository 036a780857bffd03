"""Nearest-match selection with tolerance and explicit tie rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nearest_per_target(
    df: DataFrame, keys: Sequence[str], value: str, targets: Mapping[str, float], take: Sequence[str],
    valid: Column | None = None, ties: Sequence[str] = (), tolerance: float | None = None,
) -> DataFrame:
    """For every group, the row closest to each fixed target.

    One mergeable minimum per target, so nothing is crossed or collected. Output
    has a struct column per target, NULL beyond the tolerance.
    """
    ok = F.lit(True) if valid is None else valid
    ok = ok & F.col(value).isNotNull()
    aggs = []
    for name, target in targets.items():
        dist = F.abs(F.col(value) - F.lit(float(target)))
        body = F.struct(dist.alias("dist"), *[F.col(t).alias(f"_t{i}") for i, t in enumerate(ties)], *[F.col(c) for c in take])
        aggs.append(F.min(F.when(ok, body)).alias(name))
    out = df.groupBy(*keys).agg(*aggs)
    if tolerance is None:
        return out
    return out.select(*keys, *[F.when(F.col(f"{n}.dist") <= tolerance, F.col(n)).alias(n) for n in targets])


def nearest_in_band(
    asks: DataFrame, ladder: DataFrame, on: Sequence[str], ask_key: Sequence[str], target: str, level: str,
    take: Sequence[str], tolerance: float, prefer_higher: bool = True,
) -> DataFrame:
    """Nearest ladder level within a tolerance, by equi-join on tolerance-wide bands.

    Equal distances go to the higher level by default. Asks without a level in
    range are kept with NULLs.
    """
    band = F.floor(F.col(level) / F.lit(tolerance)).cast("long")
    goal = F.floor(F.col(target) / F.lit(tolerance)).cast("long")
    spread = asks.withColumn("_band", F.explode(F.sequence(goal - 1, goal + 1)))
    steps = ladder.select(*on, F.col(level).alias("_lvl"), band.alias("_band"), *[F.col(c).alias(f"_v_{c}") for c in take])
    dist = F.abs(F.col("_lvl") - F.col(target))
    pairs = spread.join(steps, [*on, "_band"], "inner").where(dist <= tolerance)
    side = -F.col("_lvl") if prefer_higher else F.col("_lvl")
    best = pairs.groupBy(*ask_key).agg(
        F.min(F.struct(dist.alias("_d"), side.alias("_s"), F.col("_lvl"), *[F.col(f"_v_{c}") for c in take])).alias("_m")
    )
    found = best.select(*ask_key, F.col("_m._lvl").alias(f"near_{level}"), *[F.col(f"_m._v_{c}").alias(f"near_{c}") for c in take])
    return asks.join(found, list(ask_key), "left")


def first_available(df: DataFrame, keys: Sequence[str], tier: Column) -> DataFrame:
    """Rows of the best (lowest) fallback tier present in each group."""
    best = df.groupBy(*keys).agg(F.min(tier).alias("_best"))
    return df.join(best, list(keys), "inner").where(tier == F.col("_best")).drop("_best")


def closest_bucket(df: DataFrame, keys: Sequence[str], bucket: str, target: float, max_distance: float, ties: str | None = None) -> DataFrame:
    """Rows of the bucket value closest to the target, none if it is too far.

    Equal distances go to the smaller value unless another order column is given.
    """
    dist = F.abs(F.col(bucket) - F.lit(target))
    best = df.groupBy(*keys).agg(F.min(F.struct(dist.alias("d"), F.col(ties or bucket).alias("o"), F.col(bucket).alias("b"))).alias("_m"))
    best = best.where(F.col("_m.d") <= max_distance).select(*keys, F.col("_m.b").alias(bucket))
    return df.join(best, [*keys, bucket], "left_semi")
