"""Intermediate tables in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame

from strikeline.session import shared_dir


def settle(df: DataFrame, label: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write a frame as a table in the shared folder and read it back.

    Cuts lineage at a stage that several later steps read, and survives the loss
    of any executor since the files do not live on one.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{label}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
