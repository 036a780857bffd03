"""Rolling, expanding and exponentially weighted columns over an ordered series.

Every function takes a window spec ``w`` (``partitionBy(...).orderBy(...)``) and
returns a Column. They are meant for series bounded by a calendar: daily rows of
a symbol, or the bars of one session. Raw ticks go through
``slicing.rolling_over_ticks``. Partial frames give NULL until ``min_periods``
non-null rows are there.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strikeline.functions.scalar import ColumnLike, col, div, safe_ln


def series(keys: Sequence[str], order: str) -> WindowSpec:
    return W.partitionBy(*keys).orderBy(order)


def trailing(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def cumulative(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(W.unboundedPreceding, 0)


def _gate(agg: Column, seen: ColumnLike, frame: WindowSpec, min_periods: int) -> Column:
    return F.when(F.count(col(seen)).over(frame) >= min_periods, agg.over(frame))


def shift(c: ColumnLike, w: WindowSpec, k: int = 1) -> Column:
    return F.lag(col(c), k).over(w) if k >= 0 else F.lead(col(c), -k).over(w)


def diff(c: ColumnLike, w: WindowSpec, k: int = 1) -> Column:
    return col(c) - shift(c, w, k)


def pct_change(c: ColumnLike, w: WindowSpec, k: int = 1, scale: float = 1.0) -> Column:
    return (div(c, shift(c, w, k)) - 1.0) * scale


def log_return(c: ColumnLike, w: WindowSpec, k: int = 1) -> Column:
    return safe_ln(div(c, shift(c, w, k)))


def rolling_mean(c: ColumnLike, w: WindowSpec, n: int, min_periods: int | None = None) -> Column:
    return _gate(F.avg(col(c)), c, trailing(w, n), n if min_periods is None else min_periods)


def rolling_std(c: ColumnLike, w: WindowSpec, n: int, min_periods: int | None = None) -> Column:
    return _gate(F.stddev_samp(col(c)), c, trailing(w, n), max(2, n if min_periods is None else min_periods))


def rolling_var(c: ColumnLike, w: WindowSpec, n: int, min_periods: int | None = None) -> Column:
    return _gate(F.var_samp(col(c)), c, trailing(w, n), max(2, n if min_periods is None else min_periods))


def rolling_sum(c: ColumnLike, w: WindowSpec, n: int, min_periods: int | None = None) -> Column:
    return _gate(F.sum(col(c)), c, trailing(w, n), n if min_periods is None else min_periods)


def rolling_max(c: ColumnLike, w: WindowSpec, n: int, min_periods: int | None = None) -> Column:
    return _gate(F.max(col(c)), c, trailing(w, n), n if min_periods is None else min_periods)


def rolling_min(c: ColumnLike, w: WindowSpec, n: int, min_periods: int | None = None) -> Column:
    return _gate(F.min(col(c)), c, trailing(w, n), n if min_periods is None else min_periods)


def zscore(c: ColumnLike, w: WindowSpec, n: int, min_periods: int | None = None) -> Column:
    return div(col(c) - rolling_mean(c, w, n, min_periods), rolling_std(c, w, n, min_periods))


def rolling_corr(a: ColumnLike, b: ColumnLike, w: WindowSpec, n: int, min_periods: int | None = None) -> Column:
    both = F.when(col(a).isNotNull() & col(b).isNotNull(), F.lit(1))
    return _gate(F.corr(col(a), col(b)), both, trailing(w, n), n if min_periods is None else min_periods)


def rolling_autocorr(c: str, lagged: str, w: WindowSpec, n: int) -> Column:
    """Lag-one autocorrelation of the last ``n`` values (n-1 pairs).

    ``lagged`` is the column holding the previous value of ``c``.
    """
    return rolling_corr(c, lagged, w, n - 1)


def pct_rank_of_last(c: ColumnLike, w: WindowSpec, n: int, min_periods: int, scale: float = 1.0) -> Column:
    """Average-rank percentile of the newest value within its trailing frame."""
    frame = trailing(w, n)
    x = col(c)
    seen = F.collect_list(x).over(frame)
    below = F.size(F.filter(seen, lambda v: v < x))
    equal = F.size(F.filter(seen, lambda v: v == x))
    rank = div(below + (equal + 1) / 2.0, F.size(seen)) * scale
    return F.when(x.isNotNull() & (F.count(x).over(frame) >= min_periods), rank)


def share_at_or_below(c: ColumnLike, w: WindowSpec, n: int, min_periods: int) -> Column:
    """Share of the trailing frame that is at or below the newest value."""
    frame = trailing(w, n)
    x = col(c)
    seen = F.collect_list(x).over(frame)
    rank = div(F.size(F.filter(seen, lambda v: v <= x)), F.size(seen))
    return F.when(x.isNotNull() & (F.count(x).over(frame) >= min_periods), rank)


_DECAY = 300.0  # log weight after which the past is e**-300 of a value, far below a double's precision


def with_ewm(df: DataFrame, keys: Sequence[str], order: str, specs: dict[str, tuple[str, float, int]], ignore_null: bool = False) -> DataFrame:
    """Recursive exponentially weighted means, first value as the start, over whole series.

    ``specs`` maps an output column to (column, alpha, min_periods). A NULL row repeats the
    last mean; by default it still ages it (the weight of the past decays with every row), with
    ``ignore_null`` only values count. Fewer than ``min_periods`` values give NULL.

    The recurrence y = a y' + b x is a sum of b x weighted by the products of all later a. These
    are kept as running logs and cut into spans of ``_DECAY``, so that the sum of a span and
    of the one before it give the mean in two plain window passes: no lists, no limit on rows.
    """
    w, past = _by(keys, order), _by(keys, order).rowsBetween(W.unboundedPreceding, -1)
    columns = df.columns
    x = df.withColumn("_pos", F.row_number().over(w))
    for i, (out, (c, alpha, min_periods)) in enumerate(specs.items()):
        v = F.col(c)
        if alpha >= 1.0:
            x = x.withColumn(f"_y{i}", F.last(v, ignorenulls=True).over(cumulative(w)))
        else:
            x = x.withColumn("_before", F.last(F.when(v.isNotNull(), F.col("_pos")), ignorenulls=True).over(past))
            gap = F.lit(1.0) if ignore_null else (F.col("_pos") - F.col("_before")).cast("double")
            kept = F.pow(F.lit(1.0 - alpha), gap)
            step = F.when(v.isNull() | F.col("_before").isNull(), 0.0).otherwise(gap * F.lit(-math.log(1.0 - alpha)) + F.log(kept + F.lit(alpha)))
            share = F.when(F.col("_before").isNull(), 1.0).otherwise(F.lit(alpha) / (kept + F.lit(alpha)))
            x = x.withColumns({"_step": step, "_own": share * v}).withColumn("_age", F.sum("_step").over(cumulative(w)))
            x = x.withColumn("_span", F.floor(F.col("_age") / F.lit(_DECAY)).cast("long")).withColumn("_rest", F.col("_age") - F.col("_span") * F.lit(_DECAY))
            x = x.withColumn("_own", F.col("_own") * F.exp("_rest"))
            here = F.sum("_own").over(W.partitionBy(*keys, "_span").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
            last = F.sum("_own").over(W.partitionBy(*keys).orderBy("_span").rangeBetween(-1, -1))
            x = x.withColumns({"_here": here, "_last": last})
            mean = F.exp(-F.col("_rest")) * F.coalesce("_here", F.lit(0.0)) + F.exp(-F.col("_rest") - F.lit(_DECAY)) * F.coalesce("_last", F.lit(0.0))
            x = x.withColumn(f"_y{i}", mean).drop("_before", "_step", "_own", "_age", "_span", "_rest", "_here", "_last")
        x = x.withColumn(f"_y{i}", F.when(F.count(v).over(cumulative(w)) >= max(1, min_periods), F.col(f"_y{i}")))
    return x.select(*[c for c in columns if c not in specs], *[F.col(f"_y{i}").alias(out) for i, out in enumerate(specs)])


def span(c: str, n: int, min_periods: int | None = None) -> tuple[str, float, int]:
    """A ``with_ewm`` spec by span."""
    return c, 2.0 / (n + 1.0), n if min_periods is None else min_periods


def _by(keys: Sequence[str], order: str) -> WindowSpec:
    return (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy(order)


def expanding_mean(c: ColumnLike, w: WindowSpec) -> Column:
    return F.avg(col(c)).over(cumulative(w))


def running_max(c: ColumnLike, w: WindowSpec) -> Column:
    return F.max(col(c)).over(cumulative(w))


def running_min(c: ColumnLike, w: WindowSpec) -> Column:
    return F.min(col(c)).over(cumulative(w))


def running_sum(c: ColumnLike, w: WindowSpec) -> Column:
    return F.sum(col(c)).over(cumulative(w))


def ffill(c: ColumnLike, w: WindowSpec, limit: int | None = None) -> Column:
    """Carry the last non-null value forward, at most ``limit`` rows."""
    frame = cumulative(w) if limit is None else w.rowsBetween(-limit, 0)
    return F.last(col(c), ignorenulls=True).over(frame)


def clamp_zero(c: Column) -> Column:
    return F.when(c.isNotNull(), F.greatest(c, F.lit(0.0)))


def with_cusum(df: DataFrame, w: WindowSpec, returns: ColumnLike, mean: ColumnLike, drift: ColumnLike, up: str = "cusum_up", down: str = "cusum_down") -> DataFrame:
    """Upward and downward change scores over the whole series.

    s = max(0, s + r - mean - drift/2) and its mirror, from zero. That is the running sum less its
    lowest point so far (zero included), so two running aggregates replace the recursion. NULLs add nothing.
    """
    r, zero = col(returns) - col(mean), F.lit(0.0)
    x = df.withColumns({"_su": F.sum(F.coalesce(r - col(drift) / 2.0, zero)).over(cumulative(w)), "_sd": F.sum(F.coalesce(-(r + col(drift) / 2.0), zero)).over(cumulative(w))})
    score = {o: F.col(s) - F.least(zero, F.min(s).over(cumulative(w))) for o, s in ((up, "_su"), (down, "_sd"))}
    return x.withColumns(score).drop("_su", "_sd")
