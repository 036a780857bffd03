"""Scans over keys of any size: recursions whose steps compose.

A recursion over a key's rows runs in three parts. Each slice of the key is reduced to the
map that it applies to the state it gets (one row); the maps of all earlier slices are
composed by doubling, so that after k rounds a slice knows its last 2^k ones; and each slice
applies its incoming state to its own rows with plain windows. No task sees more than a
slice, whatever the key holds.

Every function takes a slice column that grows with the order within a key
(``slicing.with_time_slice``) and keeps rows and columns. NULL keys are keys. Orders must
be unique per key; equal ones are broken by the engine.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strikeline.functions.scalar import ColumnLike, col
from strikeline.operators.slicing import SLICE, null_safe_join
from strikeline.operators.windows import with_cusum, with_ewm
from strikeline.plans.tables import settle

State = dict[str, Column]


def states_before(maps: DataFrame, keys: Sequence[str], names: Sequence[str], compose: Callable[[State, State], State], slice_col: str = SLICE) -> DataFrame:
    """``keys, slice`` and the composition of the maps of all earlier slices; NULL where there are none.

    ``maps`` has one row per key and slice. ``compose(earlier, later)`` gives the map of both, from columns
    by name, and must be associative. One number, the slices of the longest key, reaches the driver.
    """
    maps = settle(maps, "maps")
    longest = maps.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0
    by = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy(slice_col)
    x = maps.select(*keys, slice_col, *names, F.row_number().over(by).alias("_at"))
    step = 1
    while step < longest:
        back = x.withColumns({f"_b_{n}": F.lag(n, step).over(by) for n in names})
        both = compose({n: F.col(f"_b_{n}") for n in names}, {n: F.col(n) for n in names})
        x = back.select(*keys, slice_col, "_at", *[F.when(F.col("_at") > step, both[n]).otherwise(F.col(n)).alias(n) for n in names])
        step *= 2
    return x.select(*keys, slice_col, *[F.lag(n).over(by).alias(n) for n in names])


def _local(keys: Sequence[str], order: str, slice_col: str):  # noqa: ANN202
    w = W.partitionBy(*keys, slice_col).orderBy(order)
    return w, w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)


def ewm_over_ticks(df: DataFrame, keys: Sequence[str], order: str, specs: dict[str, tuple[str, float, int]], slice_col: str = SLICE, ignore_null: bool = False) -> DataFrame:
    """``windows.with_ewm`` for keys of any size: the same specs, the same values.

    A slice maps the mean y it gets to A y + B. Locally its mean z starts from its own first value x;
    the mean of the whole key is z + D s (y - x), where D is what later rows of the slice leave of the
    first and s the share of the past at that first value, which depends on the rows since the last value
    in earlier slices.
    """
    w, upto, past = _local(keys, order, slice_col)
    columns, slices = df.columns, [*keys, slice_col]
    by = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy(slice_col).rowsBetween(W.unboundedPreceding, -1)

    def kept(alpha: float, gap: Column) -> Column:
        return F.lit(1.0 - alpha) if ignore_null else F.pow(F.lit(1.0 - alpha), gap.cast("double"))

    x = df.withColumns({"_pos": F.row_number().over(w), **{f"_z{i}": F.col(c) for i, (c, _, _) in enumerate(specs.values())}})
    x = with_ewm(x, slices, order, {f"_z{i}": (f"_z{i}", alpha, 1) for i, (_, alpha, _) in enumerate(specs.values())}, ignore_null)
    x = x.withColumns({f"_p{i}": F.last(F.when(F.col(c).isNotNull(), F.col("_pos")), ignorenulls=True).over(past) for i, (c, _, _) in enumerate(specs.values())})
    ages = {}
    for i, (c, alpha, _) in enumerate(specs.values()):
        gap = F.lit(1) if ignore_null else F.col("_pos") - F.col(f"_p{i}")
        left = F.lit(0.0) if alpha >= 1.0 else gap * F.lit(-math.log(1.0 - alpha)) + F.log(kept(alpha, gap) + F.lit(alpha))
        ages[f"_g{i}"] = F.when(F.col(c).isNull() | F.col(f"_p{i}").isNull(), 0.0).otherwise(left)
    x = x.withColumns(ages)
    x = x.withColumns({n: e for i, (c, _, _) in enumerate(specs.values()) for n, e in ((f"_d{i}", F.exp(-F.sum(f"_g{i}").over(upto))), (f"_k{i}", F.count(F.col(c)).over(upto)))})
    x = settle(x.drop(*[f"_{t}{i}" for i in range(len(specs)) for t in "pg"]), "local")

    found = [F.max("_pos").alias("_rows")]
    for i, (c, _, _) in enumerate(specs.values()):
        value_pos = F.when(F.col(c).isNotNull(), F.col("_pos"))
        found += [F.min(value_pos).alias(f"_f{i}"), F.max(value_pos).alias(f"_l{i}"), F.count(F.col(c)).alias(f"_n{i}")]
        found += [F.min_by(F.col(c), value_pos).cast("double").alias(f"_x{i}"), F.max_by(f"_z{i}", "_pos").alias(f"_z{i}"), F.max_by(f"_d{i}", "_pos").alias(f"_d{i}")]
    maps = x.groupBy(*slices).agg(*found).withColumn("_start", F.coalesce(F.sum("_rows").over(by), F.lit(0)))
    for i, (_, alpha, _) in enumerate(specs.values()):
        since = F.col("_start") + F.col(f"_f{i}") - F.last(F.col("_start") + F.col(f"_l{i}"), ignorenulls=True).over(by)
        maps = maps.withColumns({f"_since{i}": since, f"_seen{i}": F.coalesce(F.sum(f"_n{i}").over(by), F.lit(0))})
        share = F.lit(0.0) if alpha >= 1.0 else kept(alpha, F.col(f"_since{i}")) / (kept(alpha, F.col(f"_since{i}")) + F.lit(alpha))
        maps = maps.withColumn(f"_s{i}", F.when(F.col(f"_seen{i}") > 0, share).otherwise(0.0))
        none, pull = F.col(f"_n{i}") == 0, F.col(f"_d{i}") * F.col(f"_s{i}")
        maps = maps.withColumns({f"_a{i}": F.when(none, 1.0).otherwise(pull), f"_b{i}": F.when(none, 0.0).otherwise(F.col(f"_z{i}") - pull * F.col(f"_x{i}"))})
    maps = settle(maps, "slices")

    def compose(p: State, q: State) -> State:
        return {n: e for i in range(len(specs)) for n, e in ((f"_a{i}", q[f"_a{i}"] * p[f"_a{i}"]), (f"_b{i}", q[f"_a{i}"] * p[f"_b{i}"] + q[f"_b{i}"]))}

    state = states_before(maps, keys, [f"_{t}{i}" for i in range(len(specs)) for t in "ab"], compose, slice_col)
    state = state.select(*slices, *[F.col(f"_b{i}").alias(f"_in{i}") for i in range(len(specs))])
    carried = null_safe_join(maps.select(*slices, *[f"{t}{i}" for i in range(len(specs)) for t in ("_x", "_s", "_seen")]), state, slices)
    x, means = null_safe_join(x, carried, slices), []
    for i, (out, (_, _, min_periods)) in enumerate(specs.items()):
        known, own = F.col(f"_seen{i}") > 0, F.col(f"_z{i}")
        moved = own + F.col(f"_d{i}") * F.col(f"_s{i}") * (F.col(f"_in{i}") - F.col(f"_x{i}"))
        y = F.when(F.col(f"_k{i}") == 0, F.when(known, F.col(f"_in{i}"))).otherwise(F.when(known, moved).otherwise(own))
        means.append(F.when(F.col(f"_k{i}") + F.col(f"_seen{i}") >= max(1, min_periods), y).alias(out))
    return x.select(*[c for c in columns if c not in specs], *means)


def cusum_over_ticks(df: DataFrame, keys: Sequence[str], order: str, returns: ColumnLike, mean: ColumnLike, drift: ColumnLike, slice_col: str = SLICE, up: str = "cusum_up", down: str = "cusum_down") -> DataFrame:
    """``windows.with_cusum`` for keys of any size. A slice maps a score s to max(m, s + t): t its sum, m its own score."""
    w, upto, _ = _local(keys, order, slice_col)
    slices, zero = [*keys, slice_col], F.lit(0.0)
    r = col(returns) - col(mean)
    x = with_cusum(df, w, returns, mean, drift, "_mu", "_md")
    x = x.withColumns({"_tu": F.sum(F.coalesce(r - col(drift) / 2.0, zero)).over(upto), "_td": F.sum(F.coalesce(-(r + col(drift) / 2.0), zero)).over(upto)})
    names = ["_mu", "_tu", "_md", "_td"]
    maps = x.groupBy(*slices).agg(*[F.max_by(n, order).alias(n) for n in names])

    def compose(p: State, q: State) -> State:
        out = {}
        for side in "ud":
            out[f"_t{side}"] = p[f"_t{side}"] + q[f"_t{side}"]
            out[f"_m{side}"] = F.greatest(q[f"_m{side}"], p[f"_m{side}"] + q[f"_t{side}"])
        return out

    state = states_before(maps, keys, names, compose, slice_col)
    x = null_safe_join(x, state.select(*slices, F.col("_mu").alias("_iu"), F.col("_md").alias("_id")), slices)
    score = {o: F.greatest(F.col(f"_m{s}"), F.coalesce(F.col(f"_i{s}"), zero) + F.col(f"_t{s}")) for o, s in ((up, "u"), (down, "d"))}
    return x.withColumns(score).drop(*names, "_iu", "_id")


def count_since(df: DataFrame, keys: Sequence[str], order: str, resets: dict[str, tuple[Column, Column]], slice_col: str = SLICE) -> DataFrame:
    """Add, per entry of ``resets``, the rows with ``counts`` since the last row with ``reset`` (both of it included).

    ``resets`` maps an output to (reset, counts), booleans without NULLs. A slice without a reset adds its count to
    what it gets, another forgets it: the prefix run, suffix run and whole of a segmented scan.
    """
    w, upto, _ = _local(keys, order, slice_col)
    slices, x, names = [*keys, slice_col], df, []
    for i, (reset, counts) in enumerate(resets.values()):
        x = x.withColumns({f"_r{i}": reset, f"_c{i}": F.sum(counts.cast("long")).over(upto)})
        at = F.last(F.when(F.col(f"_r{i}"), F.col(f"_c{i}") - counts.cast("long")), ignorenulls=True).over(upto)
        x = x.withColumns({f"_n{i}": F.col(f"_c{i}") - F.coalesce(at, F.lit(0)), f"_h{i}": at.isNotNull()})
        names += [f"_n{i}", f"_h{i}"]
    maps = x.groupBy(*slices).agg(*[F.max_by(n, order).alias(n) for n in names])

    def compose(p: State, q: State) -> State:
        out = {}
        for i in range(len(resets)):
            out[f"_n{i}"] = F.when(q[f"_h{i}"], q[f"_n{i}"]).otherwise(p[f"_n{i}"] + q[f"_n{i}"])
            out[f"_h{i}"] = p[f"_h{i}"] | q[f"_h{i}"]
        return out

    state = states_before(maps, keys, names, compose, slice_col)
    x = null_safe_join(x, state.select(*slices, *[F.col(f"_n{i}").alias(f"_i{i}") for i in range(len(resets))]), slices)
    found = {o: F.col(f"_n{i}") + F.when(F.col(f"_h{i}"), F.lit(0)).otherwise(F.coalesce(F.col(f"_i{i}"), F.lit(0))) for i, o in enumerate(resets)}
    return x.withColumns(found).drop(*[f"_{p}{i}" for i in range(len(resets)) for p in "rcnhi"])


def previous_over_ticks(df: DataFrame, keys: Sequence[str], order: str, values: dict[str, str], slice_col: str = SLICE, first: str | None = None) -> DataFrame:
    """Add the value of the row before, across slices; ``first`` names a flag for rows without one."""
    w, _, _ = _local(keys, order, slice_col)
    slices = [*keys, slice_col]
    by = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy(slice_col)
    last = df.groupBy(*slices).agg(*[F.max_by(c, order).alias(f"_e{i}") for i, c in enumerate(values.values())])
    before = last.select(*slices, *[F.lag(f"_e{i}").over(by).alias(f"_e{i}") for i in range(len(values))], F.row_number().over(by).alias("_nth"))
    x = null_safe_join(df.withColumn("_pos", F.row_number().over(w)), before, slices)
    x = x.withColumns({o: F.when(F.col("_pos") == 1, F.col(f"_e{i}")).otherwise(F.lag(c).over(w)) for i, (o, c) in enumerate(values.items())})
    if first:
        x = x.withColumn(first, (F.col("_pos") == 1) & (F.col("_nth") == 1))
    return x.drop("_pos", "_nth", *[f"_e{i}" for i in range(len(values))])


def run_of_true_over_ticks(df: DataFrame, keys: Sequence[str], order: str, flag: ColumnLike, out: str, slice_col: str = SLICE) -> DataFrame:
    """``runs.run_of_true`` for keys of any size."""
    on = F.coalesce(col(flag).cast("boolean"), F.lit(False))
    return count_since(df, keys, order, {out: (~on, on)}, slice_col)


def run_of_state_over_ticks(df: DataFrame, keys: Sequence[str], order: str, state: str, duration: str, switch: str | None = None, slice_col: str = SLICE) -> DataFrame:
    """``runs.run_of_state`` for keys of any size; a NULL state is a state."""
    x = settle(previous_over_ticks(df, keys, order, {"_was": state}, slice_col, "_new"), "states")
    changed = ~F.col("_new") & ~F.col(state).eqNullSafe(F.col("_was"))
    x = count_since(x, keys, order, {duration: (changed, F.lit(True))}, slice_col)
    return (x.withColumn(switch, changed.cast("long")) if switch else x).drop("_was", "_new")


def signed_run_over_ticks(df: DataFrame, keys: Sequence[str], order: str, flag: str, out: str, slice_col: str = SLICE) -> DataFrame:
    """``runs.signed_run`` for keys of any size: negative while the flag is false or NULL."""
    x = run_of_state_over_ticks(df, keys, order, flag, "_d", None, slice_col)
    return x.withColumn(out, F.when(F.col(flag), F.col("_d")).otherwise(-F.col("_d"))).drop("_d")


def streaks_over_ticks(df: DataFrame, keys: Sequence[str], order: str, outcome: str, win: str, loss: str, slice_col: str = SLICE) -> DataFrame:
    """``runs.streaks`` for keys of any size: streaks known before each row, NULL outcomes pass them on."""
    is_win, is_loss = (F.coalesce(F.col(outcome) == k, F.lit(False)) for k in (1, 0))
    seen = F.col(outcome).isNotNull()
    x = count_since(df, keys, order, {"_w": (is_loss, seen & ~is_loss), "_l": (is_win, seen & ~is_win)}, slice_col)
    return previous_over_ticks(settle(x, "streaks"), keys, order, {win: "_w", loss: "_l"}, slice_col).drop("_w", "_l")
