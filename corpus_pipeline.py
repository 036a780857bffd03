"""The corpus pipeline: quality rules, line dedup, near-duplicates, decontamination, packing.

Each stage takes the documents its predecessor kept, as written to and read from
Parquet. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from strikeline.llm import decontaminate, lines, packing, quality, simhash
from strikeline.llm.common import ship, table
from strikeline.llm.queries import vocabulary
from strikeline.session import shared_dir


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-first rules keep, without their failing lines."""
    ship(spark)
    return quality.keep_good(docs)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat, or nearly repeat, an earlier line of the corpus."""
    ship(spark)
    return lines.drop_repeated(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    ship(spark)
    return simhash.keep_first(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    ship(spark)
    return decontaminate.drop_leaked(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in training sequences, with their token ids."""
    ship(spark)
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("quality", clean), ("line_dedup", without_repeated_lines), ("near_dedup", distinct), ("decontamination", uncontaminated), ("packing", packed)]

#: Edit distances, fingerprints and token ids have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``, each written to the shared folder and read back."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
