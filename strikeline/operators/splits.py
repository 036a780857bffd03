"""Time-ordered splits and folds over distinct dates.

A calendar has one row per date, whatever the table holds, so it is sent to the rows: a join
by shuffle would write every row and put each date into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _calendar(df: DataFrame, date: str) -> DataFrame:
    days = df.select(date).distinct()
    w = W.orderBy(date)
    return days.select(date, (F.row_number().over(w) - 1).alias("_i"), F.count(F.lit(1)).over(W.partitionBy(F.lit(0))).alias("_n"))


def three_way_split(df: DataFrame, date: str, train: float = 0.5, gap: int = 7, out: str = "split") -> DataFrame:
    """train / test / holdout by date position, with dropped gap days (NULL) between."""
    n, i = F.col("_n"), F.col("_i")
    a = F.floor(n * F.lit(train))
    rest = n - a - 2 * gap
    t0 = a + gap
    t1 = t0 + F.floor(rest / 2)
    label = F.when(i < a, "train").when((i >= t0) & (i < t1), "test").when(i >= t1 + gap, "holdout")
    return df.join(F.broadcast(_calendar(df, date).select(date, label.alias(out))), date, "left")


def walk_forward_folds(df: DataFrame, date: str, splits: int, min_train: int) -> DataFrame:
    """Expanding-train folds; each row is emitted once per fold it takes part in."""
    n, i = F.col("_n"), F.col("_i")
    size = F.greatest(F.lit(1), F.floor((n - min_train) / splits))
    fold = F.explode(F.sequence(F.lit(0), F.lit(splits - 1)))
    cal = _calendar(df, date).select(date, "_i", "_n", fold.alias("fold"))
    start = F.lit(min_train) + F.col("fold") * size
    role = F.when(i < start, "train").when(i < start + size, "val")
    cal = cal.where(start + size <= n).select(date, "fold", role.alias("role")).where(F.col("role").isNotNull())
    return df.join(F.broadcast(cal), date, "inner")


def last_dates(df: DataFrame, date: str, n: int) -> DataFrame:
    """Rows of the last ``n`` distinct dates."""
    cal = _calendar(df, date).where(F.col("_i") >= F.col("_n") - n).select(date)
    return df.join(F.broadcast(cal), date, "left_semi")


def last_share(df: DataFrame, date: str, share: float) -> DataFrame:
    """Rows of the most recent share of distinct dates."""
    cal = _calendar(df, date).where(F.col("_i") >= F.floor(F.col("_n") * F.lit(1.0 - share))).select(date)
    return df.join(F.broadcast(cal), date, "left_semi")
