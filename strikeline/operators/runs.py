"""Run lengths, streaks and state switches over a calendar-bounded series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strikeline.functions.scalar import ColumnLike, col
from strikeline.operators.windows import cumulative


def run_of_true(df: DataFrame, flag: ColumnLike, w: WindowSpec, out: str) -> DataFrame:
    """Rows since the flag was last false; zero where it is false."""
    on = F.coalesce(col(flag).cast("boolean"), F.lit(False))
    rn = F.row_number().over(w)
    last_off = F.max(F.when(~F.col("_on"), F.col("_r"))).over(cumulative(w))
    return (
        df.withColumn("_on", on)
        .withColumn("_r", rn)
        .withColumn(out, F.when(F.col("_on"), F.col("_r") - F.coalesce(last_off, F.lit(0))).otherwise(0).cast("long"))
        .drop("_on", "_r")
    )


def run_of_state(df: DataFrame, state: str, w: WindowSpec, duration: str, switch: str | None = None) -> DataFrame:
    """How long the current state has lasted, and whether it just changed."""
    prev = F.lag(state).over(w)
    changed = F.when(F.row_number().over(w) == 1, F.lit(False)).otherwise(~F.col(state).eqNullSafe(prev))
    start = F.max(F.when(F.col("_chg") | (F.col("_r") == 1), F.col("_r"))).over(cumulative(w))
    out = df.withColumn("_r", F.row_number().over(w)).withColumn("_chg", changed)
    out = out.withColumn(duration, (F.col("_r") - start + 1).cast("long"))
    if switch:
        out = out.withColumn(switch, F.col("_chg").cast("long"))
    return out.drop("_r", "_chg")


def signed_run(df: DataFrame, flag: str, w: WindowSpec, out: str) -> DataFrame:
    """Run length of a boolean state, negative while it is false."""
    runs = run_of_state(df, flag, w, "_d")
    return runs.withColumn(out, F.when(F.col(flag), F.col("_d")).otherwise(-F.col("_d"))).drop("_d")


def streaks(df: DataFrame, keys: list[str], order: str, outcome: str, win: str, loss: str) -> DataFrame:
    """Win and loss streaks known before each row; NULL outcomes pass the streak on.

    ``outcome`` is 1 for a win, 0 for a loss, NULL when nothing was observed.
    Streaks are counted over observed rows and lagged by one row.
    """
    w = W.partitionBy(*keys).orderBy(order)
    cum = cumulative(w)
    seen = F.count(outcome).over(cum)
    last_loss = F.max(F.when(F.col(outcome) == 0, F.col("_n"))).over(cum)
    last_win = F.max(F.when(F.col(outcome) == 1, F.col("_n"))).over(cum)
    base = df.withColumn("_n", seen)
    now = base.withColumn("_ll", F.coalesce(last_loss, F.lit(0))).withColumn("_lw", F.coalesce(last_win, F.lit(0)))
    wins: Column = F.col("_n") - F.col("_ll")
    losses: Column = F.col("_n") - F.col("_lw")
    now = now.withColumn("_w", wins).withColumn("_l", losses)
    return now.withColumn(win, F.lag("_w").over(w)).withColumn(loss, F.lag("_l").over(w)).drop(
        "_n", "_ll", "_lw", "_w", "_l"
    )
