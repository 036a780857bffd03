"""Two-level primitives that keep hot keys out of a single task.

A window over ``partitionBy(key)`` hands a key's whole history to one task. The
helpers here cut a key into slices, run the ordered work inside each slice, and
carry only a per-slice summary (one row per key and slice) across the borders.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strikeline.functions.scalar import epoch_seconds

SLICE = "_slice"


def with_time_slice(df: DataFrame, ts: str, seconds: int, out: str = SLICE) -> DataFrame:
    return df.withColumn(out, F.floor(epoch_seconds(ts) / F.lit(seconds)).cast("long"))


def time_width(df: DataFrame, keys: Sequence[str], ts: str, rows: int = 500_000, widest: int = 86_400, narrowest: int = 1) -> int:
    """Seconds of a time slice such that the busiest (key, slice) holds about ``rows`` rows at most.

    Counts rows per key and slice of the widest kind (one number reaches the driver) and halves the
    width as often as the busiest of them needs.
    """
    counted = with_time_slice(df.select(*keys, ts), ts, widest).groupBy(*keys, SLICE).agg(F.count(F.lit(1)).alias("_n"))
    busiest, width = counted.agg(F.max("_n")).first()[0] or 0, widest
    while busiest > rows and width > narrowest:
        width, busiest = max(narrowest, width // 2), busiest / 2
    return width


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join in which a NULL key is a key like any other, as it is in ``groupBy`` and windows."""
    names = {c: f"_r_{c}" for c in on}
    renamed = right.select(*[F.col(c).alias(names.get(c, c)) for c in right.columns])
    same = F.lit(True)
    for c, r in names.items():
        same = same & F.col(c).eqNullSafe(F.col(r))
    return left.join(renamed, same, "left").drop(*names.values())


def slice_carry(df: DataFrame, keys: Sequence[str], sums: dict[str, Column], slice_col: str = SLICE) -> DataFrame:
    """Per slice: totals of all earlier slices (``x``) and of the whole key (``x_total``)."""
    by_key = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    before = by_key.orderBy(slice_col).rowsBetween(W.unboundedPreceding, -1)
    totals = df.groupBy(*keys, slice_col).agg(*[e.alias(n) for n, e in sums.items()])
    return totals.select(
        *keys,
        slice_col,
        *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in sums],
        *[F.sum(n).over(by_key).alias(f"{n}_total") for n in sums],
    )


def exclusive_prefix(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], measures: dict[str, str], slice_col: str = SLICE
) -> DataFrame:
    """Running sums of everything ordered before each row, plus key totals.

    ``measures`` maps output name to input column; totals come as ``<name>_total``.
    """
    carry = slice_carry(df, keys, {f"_c_{o}": F.sum(i) for o, i in measures.items()}, slice_col)
    local = W.partitionBy(*keys, slice_col).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = df.select(
        "*", *[F.coalesce(F.sum(i).over(local), F.lit(0)).alias(f"_l_{o}") for o, i in measures.items()]
    )
    out = null_safe_join(out, carry, [*keys, slice_col])
    for o in measures:
        out = out.withColumns({o: F.col(f"_l_{o}") + F.col(f"_c_{o}"), f"{o}_total": F.col(f"_c_{o}_total")})
    return out.drop(*[c for o in measures for c in (f"_l_{o}", f"_c_{o}", f"_c_{o}_total")])


def row_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_col: str = SLICE, out: str = "_rn") -> DataFrame:
    """Zero-based position of each row within its key, without one task per key."""
    one = df.withColumn("_one", F.lit(1).cast("long"))
    indexed = exclusive_prefix(one, keys, order, {out: "_one"}, slice_col)
    return indexed.drop("_one", f"{out}_total")


def rolling_over_ticks(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    slice_col: str,
    rows: int,
    build: Callable[[object], dict[str, Column]],
    chunk_rows: int = 50_000,
) -> DataFrame:
    """Row-frame windows of at most ``rows`` rows over a key of any size.

    Rows get a global index, are regrouped into equal chunks, and each chunk is
    given the last ``rows - 1`` rows of its predecessor. ``build`` receives the
    window spec and returns the output columns.
    """
    chunk_rows = max(chunk_rows, rows)
    indexed = row_index(df, keys, order, slice_col)
    own = F.floor(F.col("_rn") / chunk_rows).cast("long")
    tail = (F.col("_rn") % chunk_rows) >= (chunk_rows - (rows - 1))
    copies = F.when(tail, F.array(own, own + 1)).otherwise(F.array(own))
    spread = indexed.withColumn("_own", own).withColumn("_chunk", F.explode(copies))
    spec = W.partitionBy(*keys, "_chunk").orderBy("_rn")
    return (
        spread.withColumns(build(spec)).where(F.col("_chunk") == F.col("_own")).drop("_own", "_chunk", "_rn")
    )
