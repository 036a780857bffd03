"""Sinks: overwrite, partition replace, upsert, compaction, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeline.operators.dedup import keep_one, only_missing, replace_overlap, upsert
from strikeline.plans.tables import settle
from strikeline.sources.readers import path_exists


def overwrite(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_partitions(df: DataFrame, path: str, by: Sequence[str], rows_per_file: int = 2_000_000, sort: Sequence[str] = ()) -> None:
    """Replace only the partitions present in ``df``.

    Rebalancing splits a partition value that holds most of the rows over several
    files instead of sending it to one task.
    """
    out = df.hint("rebalance", *by)
    if sort:
        out = out.sortWithinPartitions(*by, *sort)
    (
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", rows_per_file)
        .partitionBy(*by).parquet(path)
    )


def write_upsert(spark: SparkSession, new: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Upsert into a table partitioned by ``by``: the newest copy per key of old and new rows.

    The keys decide the partition (a date among them, or a bucket of them), so only partitions that new
    rows fall into are read, written aside, and replaced; all others stay as they are.
    """
    fresh = keep_one(new, keys, order)
    if path_exists(spark, path):
        old = spark.read.parquet(path)
        touched = old.join(fresh.select(*by).distinct(), list(by), "left_semi").select(*fresh.columns)
        fresh = settle(upsert(touched, fresh, keys), "upsert")
    write_partitions(fresh, path, by)
    return spark.read.parquet(path).select(*fresh.columns)


def compact(spark: SparkSession, chunks: Sequence[str], out: str) -> DataFrame:
    """Merge chunk tables whose schemas may differ by missing columns, in one scan of all of them."""
    overwrite(spark.read.option("mergeSchema", True).parquet(*chunks), out)
    return spark.read.parquet(out)


def write_incremental(spark: SparkSession, new: DataFrame, path: str, out: str, date: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Old rows before the first new date plus the new rows, of which the last by ``order`` stays per key.

    ``keys`` name a row, the date among them. Old rows are kept as they are: their dates are not in
    ``new``, so no key can meet there.
    """
    if date not in keys:
        raise ValueError("the date belongs to the keys")
    fresh = keep_one(new, keys, order)
    overwrite(replace_overlap(spark.read.parquet(path), fresh, date) if path_exists(spark, path) else fresh, out)
    return spark.read.parquet(out)


def pending(spark: SparkSession, todo: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """Work items not yet present in the output table."""
    return only_missing(todo, spark.read.parquet(path), keys) if path_exists(spark, path) else todo


def write_report(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Small summary tables as CSV or JSON."""
    w = df.write.mode("overwrite")
    if kind == "csv":
        w.option("header", True).csv(path)
    elif kind == "json":
        w.json(path)
    else:
        raise ValueError(kind)


def freshness_of(df: DataFrame, date: str) -> DataFrame:
    return df.agg(F.max(F.col(date).cast("date")).alias("last_date"))
