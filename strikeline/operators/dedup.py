"""Deduplication and upserts built on mergeable aggregates.

``max_by``/``min_by`` combine on the map side, so a key with very many copies is
reduced before the shuffle and never lies whole in one task. Over structs Spark plans
them as sort aggregates: each map task sorts its own rows, and what is left per key is sorted again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool = True) -> DataFrame:
    """The row with the greatest (or smallest) order tuple per key."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    body = F.struct(*rest) if rest else F.lit(1)
    rank = F.struct(*order)
    out = df.groupBy(*keys).agg(pick(body, rank).alias("_b"))
    cols = [F.col(c) if c in keys else F.col(f"_b.{c}") for c in df.columns]
    return out.select(*[e.alias(n) for e, n in zip(cols, df.columns)])


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows whose key is not in ``new``, plus ``new``."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def replace_overlap(old: DataFrame, new: DataFrame, date: str) -> DataFrame:
    """Keep old rows strictly before the first new date, then append the new rows."""
    first = new.agg(F.min(date)).scalar()
    kept = old.where((F.col(date) < first) | first.isNull())
    return kept.unionByName(new, allowMissingColumns=True)


def only_missing(todo: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work items whose key has not been processed yet."""
    return todo.join(done.select(*keys).distinct(), list(keys), "left_anti")


def key_duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Row count, distinct keys and surplus rows, counted by partial aggregation."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.count(F.lit(1)).alias("keys"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("key_dupes"),
    )
