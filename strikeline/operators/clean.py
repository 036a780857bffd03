"""Row filters, projections and table hygiene."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strikeline.functions.scalar import ColumnLike, col, finite, minute_of_day

FRACTIONAL = (T.DoubleType, T.FloatType)
NUMERIC = (T.DoubleType, T.FloatType, T.IntegerType, T.LongType, T.ShortType, T.ByteType, T.DecimalType)


def drop_weekends(df: DataFrame, ts: str) -> DataFrame:
    return df.where(F.weekday(ts) < 5)


def drop_all_zero_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop rows in which every listed column is zero or NULL."""
    any_value = F.lit(False)
    for c in cols:
        any_value = any_value | (F.coalesce(F.col(c), F.lit(0.0)) != 0)
    return df.where(any_value)


def minutes(hhmm: str) -> int:
    h, m = hhmm.split(":")
    return int(h) * 60 + int(m)


def in_session(ts: ColumnLike, start: str | None, end: str, include_end: bool = False) -> Column:
    """Time-of-day test; the end is exclusive unless asked (then only HH:MM:00 counts)."""
    m = minute_of_day(ts)
    upper = (m < minutes(end)) if not include_end else (
        (m < minutes(end)) | ((m == minutes(end)) & (F.second(col(ts)) == 0))
    )
    return upper if start is None else (m >= minutes(start)) & upper


def clip_dates(df: DataFrame, date: str, start: str | None = None, end: str | None = None) -> DataFrame:
    if start:
        df = df.where(F.col(date) >= F.lit(start).cast("date"))
    if end:
        df = df.where(F.col(date) <= F.lit(end).cast("date"))
    return df


def project_existing(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Add ``new <- source`` copies for every source column that exists, in one select."""
    have = set(df.columns)
    fresh = {new: F.col(src) for new, src in mapping.items() if src in have}
    keep = [c for c in df.columns if c not in fresh]
    return df.select(*keep, *[e.alias(n) for n, e in fresh.items()])


def rename_existing(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    have = set(df.columns)
    return df.withColumnsRenamed({old: new for old, new in mapping.items() if old in have})


def drop_matching(df: DataFrame, names: Iterable[str] = (), prefixes: Iterable[str] = (), suffixes: Iterable[str] = ()) -> DataFrame:
    """Drop columns by exact name, prefix or suffix; unknown names are ignored."""
    names, pre, suf = set(names), tuple(prefixes), tuple(suffixes)
    gone = [
        c for c in df.columns
        if c in names or (pre and c.startswith(pre)) or (suf and c.endswith(suf))
    ]
    return df.drop(*gone)


def sanitize_numeric(df: DataFrame) -> DataFrame:
    """NaN and infinities to NULL in every floating column, in one projection."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, FRACTIONAL)}
    return df.select(*[finite(c).alias(c) if c in floats else F.col(c) for c in df.columns])


def one_hot(df: DataFrame, column: str, domain: Sequence[str], prefix: str) -> DataFrame:
    """0/1 flags over a fixed domain; values outside it are all zero."""
    return df.select(
        "*", *[F.coalesce((F.col(column) == v).cast("long"), F.lit(0)).alias(f"{prefix}{v}") for v in domain]
    )


def feature_columns(df: DataFrame, meta: Iterable[str], dictionary: Mapping[str, bool] | None = None) -> list[str]:
    """Numeric, non-meta columns, restricted to those the dictionary marks as in the model."""
    meta = set(meta)
    return [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, NUMERIC) and f.name not in meta and (dictionary is None or dictionary.get(f.name, False))
    ]


def null_rates(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per column with its share of NULLs, from a single pass."""
    n = F.count(F.lit(1))
    one = df.agg(*[F.try_divide((n - F.count(c)).cast("double"), n).alias(c) for c in cols])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("null_rate")) for c in cols]))
    return one.select(pairs.alias("_p")).select("_p.feature", "_p.null_rate")


def columns_under_null_rate(df: DataFrame, cols: Sequence[str], limit: float = 0.5) -> list[str]:
    """Columns kept by the null-rate rule. Brings one number per column to the driver."""
    row = df.agg(*[F.count(c).alias(c) for c in cols], F.count(F.lit(1)).alias("_n")).first()
    n = row["_n"]
    return [c for c in cols if n and (n - row[c]) / n <= limit]


def impute(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fill NULLs with the exact column median found by distributed order statistics."""
    from strikeline.operators.radix import exact_quantiles

    long = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in cols])).alias("_p")
    ).select("_p.*")
    medians = exact_quantiles(long, ["feature"], "v", [0.5])  # one row per column
    fills = medians.agg(F.map_from_entries(F.collect_list(F.struct("feature", F.col("quantiles")[0])))).scalar()  # one row, one entry per column
    return df.withColumn("_fills", fills).withColumns({c: F.coalesce(F.col(c), F.col("_fills")[c]) for c in cols}).drop("_fills")


def hard_blocked(
    days_to_fomc: ColumnLike, event_flags: Sequence[ColumnLike], vix: ColumnLike, gap_pct: ColumnLike | None = None
) -> Column:
    """Event day, FOMC day or eve, VIX above 35, or an opening gap beyond 1.5 percent."""
    hit = col(days_to_fomc).isin(0, 1)
    tests = [hit, *[col(c) == 1 for c in event_flags], col(vix) > 35]
    if gap_pct is not None:
        tests.append(F.abs(col(gap_pct)) > 1.5)
    out = F.lit(False)
    for t in tests:
        out = out | F.coalesce(t, F.lit(False))
    return out


def soft_reasons(date: ColumnLike, vix: ColumnLike, in_fomc_week: ColumnLike) -> Column:
    """Array of soft blocker reasons for a date."""
    d, v = col(date), col(vix)
    late = F.dayofmonth(d) >= 28
    return F.array_compact(
        F.array(
            F.when((v >= 25) & (v <= 35), F.lit("elevated vol")),
            F.when(late, F.lit("month end")),
            F.when(late & F.month(d).isin(3, 6, 9, 12), F.lit("quarter end")),
            F.when(F.coalesce(col(in_fomc_week).cast("boolean"), F.lit(False)), F.lit("fomc week")),
        )
    )


def hard_reasons(is_fomc: ColumnLike, events: ColumnLike, earnings: ColumnLike, fomc_tomorrow: ColumnLike, vix: ColumnLike) -> Column:
    """Array of hard blocker reasons; ``events`` is an array of event names of the day."""
    def yes(c: ColumnLike) -> Column:
        return F.coalesce(col(c).cast("boolean"), F.lit(False))

    single = F.array_compact(
        F.array(
            F.when(yes(is_fomc), F.lit("fomc day")),
            F.when(yes(earnings), F.lit("earnings")),
            F.when(yes(fomc_tomorrow), F.lit("fomc eve")),
            F.when(col(vix) > 35, F.lit("vix above 35")),
        )
    )
    named = F.transform(F.coalesce(col(events), F.array().cast("array<string>")), lambda e: F.concat(F.lit("release: "), e))
    return F.concat(single, named)
