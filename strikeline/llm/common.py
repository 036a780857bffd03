"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Words are runs of anything but a space and the five ASCII controls tab to carriage return.
SPACE = "\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that clash with none of ``df``, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def ref(name: str) -> Column:
    """A top-level column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_of(name: str) -> Column:
    return F.coalesce(ref(name).cast("string"), F.lit(""))


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, list]], added: Sequence[T.StructField], text: str) -> DataFrame:
    """Keep every row and column of ``df`` and add columns that ``fn`` computes from the batch.

    The batch given to ``fn`` has the columns of ``df``; what it returns is added, or
    replaces a column of the same name (which then keeps its place and type).
    """
    names = [f.name for f in added]
    schema = T.StructType([f for f in df.schema.fields] + [f for f in added if f.name not in df.columns])
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = fn(b.column(at).to_pylist())
            cols = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            for n in names:
                cols[n] = got[n] if isinstance(got[n], (pa.Array, pa.ChunkedArray)) else pa.array(got[n])
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return df.mapInArrow(run, schema)


def slices(items: list, most: int) -> Iterator[list]:
    for i in range(0, len(items), most):
        yield items[i : i + most]


def ship(spark: SparkSession) -> None:
    """Prepare a session: Python workers import this package from where the driver has it, if no package was
    distributed to them, and get batches of texts small enough for several workers on one executor, unless
    the session has its own size."""
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, "1000")
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
