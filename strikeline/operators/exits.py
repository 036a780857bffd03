"""Counterfactual exit labels along an open position's path."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strikeline.functions.scalar import epoch_seconds


def exit_labels(path: DataFrame, key: Sequence[str], time: str, debit: str, credit: str, minutes: int = 5, share: float = 0.15, fee: float = 0.0) -> DataFrame:
    """Would closing now beat holding, and does a sharp loss follow soon?

    ``should_exit`` compares P&L at this minute with the path's last minute.
    ``adverse_move`` is set when the debit rises by more than a share of the
    credit within the next minutes, NULL when no later point is in range. Windows
    run over one position's minutes.
    """
    whole = W.partitionBy(*key)
    ahead = W.partitionBy(*key).orderBy("_sec").rangeBetween(1, minutes * 60)
    x = path.withColumn("_sec", epoch_seconds(time))
    final = F.max_by(debit, time).over(whole)
    nxt = F.max(debit).over(ahead)
    now, hold = F.col(credit) - F.col(debit) - fee, F.col(credit) - final - fee
    return x.withColumns(
        {
            "should_exit": (now > hold).cast("long"),
            "adverse_move": F.when(nxt.isNotNull(), (nxt - F.col(debit) > F.col(credit) * share).cast("long")),
        }
    ).drop("_sec")
