"""Selection and slicing by the bits of numbers.

A double is mapped to a long of the same order. Its leading bits are a bin, and a histogram over bins
is a plain aggregate with map-side combine, of at most 2^16 rows a group. A bin that holds too much is
opened by the next 16 bits, so that after four levels a bin is a single value, however values are spread.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strikeline.operators.slicing import SLICE, null_safe_join
from strikeline.plans.tables import settle

LEVEL_BITS = 16
DEPTHS = tuple(range(LEVEL_BITS, 65, LEVEL_BITS))
# Fixed values of the 64-bit floating-point format.
FRACTION, BIAS = 1 << 52, 1023


def with_order_bits(df: DataFrame, value: str, out: str = "_bits") -> DataFrame:
    """A long in the order of ``value`` as a double: equal for equal values (zeros too), NaN highest, NULL for NULL.

    The exponent comes from a logarithm and is set right where it was off by one.
    """
    x, e, f = F.col("_abs"), F.col("_exp"), F.col("_frac")
    number, infinite = F.col(value).cast("double"), F.lit((2 * BIAS + 1) * FRACTION)
    endless = F.isnan(number) | (F.abs(number) == F.lit(float("inf")))
    out_of_range = F.when(F.isnan(number), infinite + F.lit(1)).when(endless, infinite)
    lowest, highest = F.lit(1 - BIAS).cast("long"), F.lit(BIAS).cast("long")
    bits = df.withColumn("_abs", F.when(endless, F.lit(1.0)).otherwise(F.abs(number)))
    guess = F.floor(F.log2(F.nullif(x, F.lit(0.0)))).cast("long")
    bits = bits.withColumn("_exp", F.coalesce(F.least(F.greatest(guess, lowest), highest), lowest))
    # the fraction is exact, and tells where the logarithm was off by one
    bits = bits.withColumn("_frac", x / F.pow(F.lit(2.0), e))
    step = F.when((f < 1) & (e > lowest), F.lit(-1)).when(f >= 2, F.lit(1)).otherwise(F.lit(0))
    half = F.when((f < 1) & (e > lowest), f * 2).when(f >= 2, f / 2).otherwise(f)
    # below the smallest normal number the fraction has no leading one, and the sum is right as it is
    size = F.coalesce(out_of_range, (e + step + F.lit(BIAS - 1)) * F.lit(FRACTION) + (half * F.lit(float(FRACTION))).cast("long"))
    return bits.withColumn(out, F.when(F.isnan(number) | (number >= 0), size).otherwise(-size)).drop("_abs", "_exp", "_frac")


def _bin(depth: int) -> Column:
    """First number of the bin of ``_bits`` at a depth."""
    rest = 64 - depth
    return F.shiftleft(F.shiftright("_bits", rest), rest) if rest else F.col("_bits")


def _histogram(rows: DataFrame, on: Sequence[str], depth: int) -> DataFrame:
    return rows.withColumn("_bin", _bin(depth)).groupBy(*on, "_bin").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_bits").alias("_low"), F.max("_bits").alias("_high"), F.min("_v").alias("_v")
    )


def _within(rows: DataFrame, bins: DataFrame, keys: Sequence[str], depth: int) -> DataFrame:
    """Rows that fall into the given bins, with the columns of the bin."""
    return null_safe_join(rows.withColumn("_in", _bin(depth)), bins, [*keys, "_in"])


def order_statistics(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], most: int = 1_000_000) -> DataFrame:
    """``keys, n, stats``: a map from zero-based rank to value for the ranks that ``probs`` interpolate between.

    Rows whose value is NULL do not count. Only bins that hold a wanted rank and more than one value are
    read again; they are sorted when they hold at most ``most`` rows, which bounds tasks but not the result.
    A group of any size thus costs two or three scans and no sort of the group. One number a level reaches the driver.
    """
    rows = with_order_bits(df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v")), "_v")
    ranks = F.array_distinct(F.array(*[r((F.col("_total") - 1) * F.lit(float(p))).cast("long") for p in probs for r in (F.floor, F.ceil)]))

    def wanted(first: Column) -> Column:
        return F.filter("_ranks", lambda r: (r >= first) & (r < first + F.col("_n")))

    whole = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    hist = _histogram(rows, keys, DEPTHS[0]).withColumn("_total", F.sum("_n").over(whole)).withColumn("_ranks", ranks)
    before = F.sum("_n").over(whole.orderBy("_bin")) - F.col("_n")
    columns = [*keys, "_total", "_bin", "_first", "_n", "_low", "_high", "_v", "_ranks"]
    hist = hist.withColumn("_first", before).withColumn("_ranks", wanted(F.col("_first"))).where(F.size("_ranks") > 0)
    hist = settle(hist.select(columns), "bins")
    single, done = F.col("_low") == F.col("_high"), []
    for at, depth in enumerate(DEPTHS):
        done.append(hist.where(single).select(*keys, "_total", "_ranks", "_v"))
        busiest = hist.where(~single).agg(F.max("_n")).first()[0]
        if busiest is None:
            break
        bins = hist.where(~single).select(*keys, F.col("_bin").alias("_in"), "_total", "_first", "_ranks")
        inside = _within(rows, bins, keys, depth).where(F.col("_total").isNotNull())
        on = [*keys, "_in"]
        base = W.partitionBy(*on)
        carried = [F.any_value(c).alias(c) for c in ("_total", "_first", "_ranks")]
        if busiest <= most:
            counts = inside.groupBy(*on, "_v").agg(F.count(F.lit(1)).alias("_n"), *carried)
            first = F.col("_first") + F.sum("_n").over(base.orderBy("_v")) - F.col("_n")
            found = counts.withColumn("_first", first).withColumn("_ranks", wanted(F.col("_first")))
            done.append(found.where(F.size("_ranks") > 0).select(*keys, "_total", "_ranks", "_v"))
            break
        deeper = null_safe_join(_histogram(inside, on, DEPTHS[at + 1]), bins, on)
        first = F.col("_first") + F.sum("_n").over(base.orderBy("_bin")) - F.col("_n")
        hist = deeper.withColumn("_first", first).withColumn("_ranks", wanted(F.col("_first"))).where(F.size("_ranks") > 0)
        hist = settle(hist.select(columns), "bins")
    found = done[0]
    for part in done[1:]:
        found = found.unionByName(part)
    pairs = found.select(*keys, "_total", "_v", F.explode("_ranks").alias("_rank"))
    stats = F.map_from_entries(F.collect_list(F.struct("_rank", "_v")))
    # a group has at most two ranks a probability
    return pairs.groupBy(*keys).agg(F.max("_total").alias("n"), stats.alias("stats"))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], most: int = 1_000_000, out: str = "quantiles") -> DataFrame:
    """Exact linearly interpolated quantiles per group as an array column; groups without a value have no row,
    and without keys there is one row in any case.

    Zero of either sign is zero, and NaN is the largest value.
    """
    picked = order_statistics(df, keys, value, probs, most)
    values = []
    for p in probs:
        rank = (F.col("n") - 1) * F.lit(float(p))
        low, high = (F.col("stats")[r(rank).cast("long")] for r in (F.floor, F.ceil))
        values.append(F.when(low == high, low).otherwise(low + (high - low) * (rank - F.floor(rank))))
    return picked.select(*keys, "n", F.array(*values).alias(out))


def quantiles_long(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], out: str, prob_name: str) -> DataFrame:
    """One row per group and probability."""
    q = exact_quantiles(df, keys, value, probs, out="_q")
    pairs = F.arrays_zip(F.array(*[F.lit(float(p)) for p in probs]).alias("p"), F.col("_q").alias("q"))
    return q.select(*keys, "n", F.explode(pairs).alias("_e")).select(
        *keys, "n", F.col("_e.p").alias(prob_name), F.col("_e.q").alias(out)
    )


def with_value_slice(df: DataFrame, keys: Sequence[str], value: str, most: int = 500_000, out: str = SLICE) -> DataFrame:
    """Cut each group into value ranges of at most about ``most`` rows each; the slice number ascends with the value.

    Neighbouring bins share a slice while they fit. Bins of more rows are cut by the next bits, down to single
    values, which stay whole: count equal values first where they may be many. NULL values get a NULL slice.
    """
    bits = with_order_bits(df, value)
    slices, open_bins = None, None
    for depth in DEPTHS:
        inside = bits if open_bins is None else _within(bits, open_bins, keys, depth - LEVEL_BITS).where(F.col("_open"))
        on = list(keys) if open_bins is None else [*keys, "_in"]
        counts = inside.where(F.col(value).isNotNull()).withColumn("_bin", _bin(depth)).groupBy(*on, "_bin").agg(
            F.count(F.lit(1)).alias("_n"), F.min("_bits").alias("_low"), F.max("_bits").alias("_high")
        )
        group = W.partitionBy(*on) if on else W.partitionBy(F.lit(0))
        share = F.floor((F.sum("_n").over(group.orderBy("_bin")) - F.col("_n")) / F.lit(most))
        counts = counts.withColumn("_share", share)
        first = F.min("_bin").over(W.partitionBy(*on, "_share"))
        full = (F.col("_n") > most) & (F.col("_low") < F.col("_high"))
        level = counts.select(*keys, F.col("_bin").alias(f"_bin{depth}"), first.alias(f"_slice{depth}"), full.alias("_open"), "_share")
        level = settle(level, "slices")
        split, deeper = level.agg(F.max(F.col("_share") > 0), F.max("_open")).first()
        if slices is None and not split and not deeper:
            return df.withColumn(out, F.when(F.col(value).isNotNull(), F.lit(0).cast("long")))  # every group fits a slice
        bits = null_safe_join(bits.withColumn(f"_bin{depth}", _bin(depth)), level.drop("_open", "_share"), [*keys, f"_bin{depth}"]).drop(f"_bin{depth}")
        # a slice number that an opened bin shares with its lower neighbours is replaced one level down
        slices = F.col(f"_slice{depth}") if slices is None else F.coalesce(F.col(f"_slice{depth}"), slices)
        open_bins = level.where("_open").select(*keys, F.col(f"_bin{depth}").alias("_in"), "_open")
        if not deeper:
            break
    made = [f"_slice{d}" for d in DEPTHS if f"_slice{d}" in bits.columns]
    return bits.withColumn(out, slices).drop("_bits", *[c for c in made if c != out])
