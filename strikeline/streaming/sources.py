"""File-source streams and run helpers."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strikeline.operators.dedup import keep_one
from strikeline.session import shared_dir


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet", files_per_trigger: int = 16) -> DataFrame:
    """Parquet files appended to a folder during the session."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", pattern).parquet(folder)
    )


def event_time(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """Zone-less timestamps become instants (session zone UTC) so a watermark can be set."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/streams/{label}-{uuid.uuid4().hex}"


def run_append(stream: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Process everything available in append mode into a table and read it back."""
    spark = stream.sparkSession
    out = path or new_path(spark, label)
    q = (
        stream.writeStream.outputMode("append").format("parquet").option("path", out)
        .option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_latest(stream: DataFrame, label: str, keys: Sequence[str], order: Sequence[str] = (), mode: str = "update") -> DataFrame:
    """Process everything available; the newest copy per key wins.

    Every micro-batch is reduced to one row per key and written to its own
    batch folder (a replay overwrites it, so restarts are safe). The returned
    view keeps the row of the highest (order, batch); within a batch, rows of equal
    order are told apart by their other columns. This is last-copy-wins,
    unlike watermark deduplication, which keeps the first.
    """
    spark = stream.sparkSession
    out = new_path(spark, label)
    order = list(order)

    def write(batch: DataFrame, batch_id: int) -> None:
        rest = [c for c in batch.columns if c not in keys and c not in order]
        keep_one(batch, keys, [*order, *rest] or list(keys)).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    q = (
        stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{out}-checkpoint")
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch_id", T.LongType())])
    return keep_one(spark.read.schema(schema).parquet(out), keys, [*order, "batch_id"]).drop("batch_id")
