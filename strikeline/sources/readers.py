"""Batch readers: columnar tables, landed CSV, and nested vendor JSON."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strikeline.functions.scalar import div, side_of

NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None, schema: T.StructType | None = None, where: Column | None = None) -> DataFrame:
    """Parquet scan with column pruning and predicate pushdown."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.parquet(path)
    if where is not None:
        df = df.where(where)
    return df.select(*columns) if columns else df


def path_exists(spark: SparkSession, path: str) -> bool:
    """Look a path up on whatever file system it names."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_optional(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table, or an empty one of the declared schema when it is absent."""
    if path_exists(spark, path):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def register_views(spark: SparkSession, paths: Mapping[str, str], allowed: Sequence[str]) -> list[str]:
    """Register tables as temporary views; names must be on the allow-list."""
    done = []
    for name, path in paths.items():
        if name not in allowed or not NAME.match(name):
            raise ValueError(f"view name not allowed: {name}")
        spark.read.parquet(path).createOrReplaceTempView(name)
        done.append(name)
    return done


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Landed CSV with a header; malformed numbers become NULL rather than failing."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


CHAIN_RESPONSE = "struct<response:array<struct<contract:struct<strike:double,expiration:string,right:string>,data:array<struct<bid:double,ask:double,volume:bigint>>>>>"


def explode_chain(df: DataFrame, body: str, keep: Sequence[str], date: str, spot: str) -> DataFrame:
    """Nested chain response to one row per quote, with tenor, mid and moneyness.

    Rows whose expiration lies before the trade date are dropped.
    """
    parsed = df.select(*keep, F.from_json(body, CHAIN_RESPONSE).alias("_j"))
    c = parsed.select(*keep, F.explode("_j.response").alias("_c"))
    r = c.select(*keep, "_c.contract", F.explode("_c.data").alias("_d"))
    exp = F.try_to_date("contract.expiration", "yyyy-MM-dd")
    out = r.select(
        *keep, exp.alias("expiration"), F.datediff(exp, F.col(date)).alias("dte"), F.col("contract.strike").alias("strike"),
        side_of("contract.right").alias("right"), F.col("_d.bid").alias("bid"), F.col("_d.ask").alias("ask"),
        ((F.col("_d.bid") + F.col("_d.ask")) / 2.0).alias("mid"), F.col("_d.volume").alias("volume"),
        div(F.col("contract.strike") - F.col(spot), spot).alias("moneyness"),
    )
    return out.where(F.col("dte") >= 0)


CHAIN_MAP = "map<string,map<string,array<struct<bid:double,ask:double,delta:double>>>>"


def flatten_chain_map(df: DataFrame, body: str, keep: Sequence[str]) -> DataFrame:
    """Map of expiry to map of strike to contract list: first expiry, first contract."""
    parsed = df.select(*keep, F.from_json(body, CHAIN_MAP).alias("_m"))
    first = F.array_min(F.map_keys("_m"))
    one = parsed.select(*keep, first.alias("expiry"), F.try_element_at("_m", first).alias("_s"))
    rows = one.select(*keep, "expiry", F.explode("_s").alias("_k", "_v"))
    q = F.try_element_at("_v", F.lit(1))
    return rows.select(*keep, "expiry", F.col("_k").try_cast("double").alias("strike"), q["bid"].alias("bid"), q["ask"].alias("ask"), q["delta"].alias("delta"))


OBSERVATIONS = "struct<observations:array<struct<date:string,value:string>>>"


def explode_observations(df: DataFrame, body: str, keep: Sequence[str]) -> DataFrame:
    """Series observations; blank and "." values are dropped."""
    x = df.select(*keep, F.explode(F.from_json(body, OBSERVATIONS)["observations"]).alias("_o"))
    return x.where(~F.trim("_o.value").isin(".", "")).select(
        *keep, F.try_to_date("_o.date", "yyyy-MM-dd").alias("date"), F.col("_o.value").try_cast("double").alias("value")
    )


def json_number(c: str, path: str) -> Column:
    return F.get_json_object(c, path).try_cast("double")
