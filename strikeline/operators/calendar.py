"""Calendar columns, business-day grids and event proximity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikeline.functions.scalar import ColumnLike, col
from strikeline.operators.asof import asof_join, lookup_interval

# Start of each presidential term and its party.
TERMS = [
    ("1993-01-20", "D", 1), ("1997-01-20", "D", 2), ("2001-01-20", "R", 1), ("2005-01-20", "R", 2),
    ("2009-01-20", "D", 1), ("2013-01-20", "D", 2), ("2017-01-20", "R", 1), ("2021-01-20", "D", 1),
    ("2025-01-20", "R", 2), ("2029-01-20", None, None),
]


def _int(c: Column) -> Column:
    return c.cast("long")


def entry_time_columns(ts: str, open_minute: int = 570, session: float = 390.0) -> dict[str, Column]:
    t = F.col(ts)
    since = _int(F.hour(t) * 60 + F.minute(t) - open_minute)
    angle = F.lit(2.0) * F.pi() * since / F.lit(session)
    return {
        "entry_hour": _int(F.hour(t)),
        "entry_minute": _int(F.minute(t)),
        "minutes_since_open": since,
        "time_sin": F.sin(angle),
        "time_cos": F.cos(angle),
    }


def weekday_columns(date: str) -> dict[str, Column]:
    d = F.col(date).cast("date")
    month_end = d == F.last_day(d)
    return {
        "day_of_week": _int(F.weekday(d)),
        "is_monday": _int(F.weekday(d) == 0),
        "is_friday": _int(F.weekday(d) == 4),
        "is_month_end": _int(month_end),
        "is_quarter_end": _int(month_end & (F.month(d) % 3 == 0)),
        "cycle_quarter": _int(F.quarter(d)),
    }


def quarter_end(d: Column) -> Column:
    return F.last_day(F.add_months(F.trunc(d, "quarter"), 2))


def season_columns(date: str) -> dict[str, Column]:
    """Position in month and quarter, and the seasonal flags."""
    d = F.col(date).cast("date")
    m, day = F.month(d), F.dayofmonth(d)
    to_month_end = F.datediff(F.last_day(d), d)
    to_qtr_end = F.datediff(quarter_end(d), d)
    first_nov = F.make_date(F.year(d), F.lit(11), F.lit(1))
    fourth_thursday = F.date_add(F.next_day(F.date_sub(first_nov, 1), "THU"), 21)
    return {
        "week_of_year": _int(F.weekofyear(d)),
        "day_of_month": _int(day),
        "month": _int(m),
        "quarter": _int(F.quarter(d)),
        "days_into_quarter": _int(F.datediff(d, F.trunc(d, "quarter"))),
        "sell_in_may": _int(m.between(5, 10)),
        "q4_rally": _int(m >= 10),
        "january_effect": _int(m == 1),
        "days_to_month_end": _int(to_month_end),
        "near_month_end": _int(to_month_end <= 3),
        "days_to_qtr_end": _int(to_qtr_end),
        "near_qtr_end": _int(to_qtr_end <= 5),
        "thanksgiving_week": _int((m == 11) & (F.abs(F.datediff(d, fourth_thursday)) <= 4)),
        "christmas_week": _int((m == 12) & (day >= 24)),
    }


def third_friday(d: Column) -> Column:
    return F.date_add(F.next_day(F.date_sub(F.trunc(d, "month"), 1), "FRI"), 14)


def opex_columns(date: str) -> dict[str, Column]:
    """Monthly expiry day, its +-4 day neighbourhood, and triple witching."""
    d = F.col(date).cast("date")
    third = third_friday(d)
    return {
        "opex_day": _int(d == third),
        "opex_week": _int(F.abs(F.datediff(d, third)) <= 4),
        "triple_witching": _int((d == third) & (F.month(d) % 3 == 0)),
    }


def cycle_columns(df: DataFrame, date: str) -> DataFrame:
    """Term, party and position in the four-year cycle, by validity-interval lookup."""
    spans = [
        (start, TERMS[i + 1][0], {"party_dem": int(party == "D"), "term_num": term, "_inag": start})
        for i, (start, party, term) in enumerate(TERMS[:-1])
    ]
    out = lookup_interval(df, date, spans, ["party_dem", "term_num", "_inag"])
    d, s = F.col(date).cast("date"), F.col("_inag").cast("date")
    months = F.greatest((F.year(d) - F.year(s)) * 12 + F.month(d) - F.month(s), F.lit(0))
    year = F.floor(months / 12) + 1
    return out.withColumns(
        {
            "party_dem": _int(F.col("party_dem")),
            "term_num": _int(F.col("term_num")),
            "cycle_year": _int(F.least(year, F.lit(4))),
            "cycle_month": _int(F.least(months % 48, F.lit(47))),
            "pre_election_year": _int(year == 3),
            "election_year": _int(year == 4),
            "midterm_year": _int(year == 2),
            "first_year": _int(year == 1),
        }
    ).drop("_inag")


def weekdays_before(d: Column) -> Column:
    """Monday-to-Friday days since a fixed Monday, up to but excluding ``d``."""
    n = F.datediff(d, F.lit("1900-01-01").cast("date"))
    return F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(5))


def business_days_between(start: ColumnLike, end: ColumnLike) -> Column:
    """Weekdays in [start, end), holidays ignored, without building a sequence."""
    return _int(weekdays_before(col(end).cast("date")) - weekdays_before(col(start).cast("date")))


def business_grid(df: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    """Every weekday between a key's first and last date."""
    span = df.groupBy(*keys).agg(F.min(date).alias("_a"), F.max(date).alias("_b"))
    return span.select(*keys, F.explode(F.sequence("_a", "_b")).alias(date)).where(F.weekday(date) < 5)


def reindex_business_days(df: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    return business_grid(df, keys, date).join(df, [*keys, date], "left")


def missing_weekdays(df: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    return business_grid(df, keys, date).join(df.select(*keys, date).distinct(), [*keys, date], "left_anti")


def days_to_next(
    dates: DataFrame, events: DataFrame, date: str, event_col: str, names: Sequence[str],
    strict: bool = True, missing: int | None = None, any_name: str | None = None,
) -> DataFrame:
    """Days until the next event of each kind, one column per name.

    Strict with NULL when none is left, or inclusive with a sentinel (``missing``).
    """
    kinds = events.where(F.col(event_col).isin(list(names))).select(F.col(event_col).alias("_k"), F.col(date).alias("_ev"))
    if any_name:
        kinds = kinds.unionByName(kinds.select(F.lit(any_name).alias("_k"), "_ev"))
    want = list(names) + ([any_name] if any_name else [])
    asks = dates.select(date).distinct().select(date, F.explode(F.array(*[F.lit(n) for n in want])).alias("_k"))
    hit = asof_join(asks, kinds, ["_k"], date, "_ev", {"_next": "_ev"}, "forward", strict, slice_seconds=366 * 86_400)
    gap = _int(F.datediff("_next", date))
    if missing is not None:
        gap = F.coalesce(gap, F.lit(missing))
    return hit.groupBy(date).agg(*[F.max(F.when(F.col("_k") == n, gap)).alias(f"days_to_next_{n.lower()}") for n in want])


def event_flags(dates: DataFrame, events: DataFrame, date: str, event_col: str, names: Sequence[str]) -> DataFrame:
    """is_<event>_day flags, zero on days without events."""
    flags = events.groupBy(date).agg(
        *[F.max((F.col(event_col) == n).cast("long")).alias(f"is_{n.lower()}_day") for n in names]
    )
    out = dates.join(flags, date, "left")
    return out.withColumns({f"is_{n.lower()}_day": F.coalesce(F.col(f"is_{n.lower()}_day"), F.lit(0)) for n in names})


def near_event(dates: DataFrame, events: DataFrame, date: str, days: int) -> DataFrame:
    """Flags: any event within +-days, and any event in the same Monday-to-Sunday week."""
    marks = events.select(date).distinct()
    around = marks.select(F.explode(F.sequence(F.date_sub(date, days), F.date_add(date, days))).alias(date)).distinct()
    weeks = marks.select(F.trunc(date, "week").alias("_wk")).distinct()
    return (
        dates.withColumn("_wk", F.trunc(date, "week"))
        .join(around.withColumn("_n", F.lit(1)), date, "left")
        .join(weeks.withColumn("_w", F.lit(1)), "_wk", "left")
        .withColumns({"near_event": _int(F.coalesce("_n", F.lit(0))), "event_week": _int(F.coalesce("_w", F.lit(0)))})
        .drop("_wk", "_n", "_w")
    )


def earnings_flags(dates: DataFrame, earnings: DataFrame, date: str, symbol: str, names: Sequence[str]) -> DataFrame:
    """Per-symbol flags, count, sorted symbol list and any-earnings flag per day."""
    daily = earnings.select(date, symbol).distinct().groupBy(date).agg(
        *[F.max((F.col(symbol) == n).cast("long")).alias(f"is_earnings_{n.lower()}") for n in names],
        F.count(F.lit(1)).alias("earnings_count"),
        F.array_join(F.array_sort(F.collect_set(symbol)), ",").alias("earnings_symbols"),
    )
    out = dates.join(daily, date, "left")
    zero = {f"is_earnings_{n.lower()}": F.coalesce(F.col(f"is_earnings_{n.lower()}"), F.lit(0)) for n in names}
    return out.withColumns(
        {
            **zero,
            "earnings_count": F.coalesce("earnings_count", F.lit(0)),
            "earnings_symbols": F.coalesce("earnings_symbols", F.lit("")),
            "is_earnings_day": _int(F.coalesce("earnings_count", F.lit(0)) > 0),
        }
    )
