"""Scalar column helpers. All of them stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def div(a: ColumnLike, b: ColumnLike) -> Column:
    """Division that yields NULL for a zero divisor (ANSI mode raises otherwise)."""
    return F.try_divide(col(a), col(b))


def div_pos(a: ColumnLike, b: ColumnLike) -> Column:
    """a / b where b is strictly positive, else NULL."""
    return F.when(col(b) > 0, div(a, b))


def pct_over(a: ColumnLike, b: ColumnLike) -> Column:
    """Distance of ``a`` over ``b`` in percent, for positive ``b``."""
    return F.when(col(b) > 0, div(col(a) - col(b), b) * 100.0)


def finite(c: ColumnLike) -> Column:
    """NaN and both infinities become NULL."""
    x = col(c)
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None)).otherwise(x)


def safe_ln(c: ColumnLike) -> Column:
    """Natural log, NULL at and below zero."""
    return F.when(col(c) > 0, F.ln(col(c)))


def to_step(c: ColumnLike, step: float = 5.0) -> Column:
    """Round to a strike grid with half-even ties, as numpy rounds."""
    return F.bround(col(c) / F.lit(step)) * F.lit(step)


def clip(c: ColumnLike, low: float | None = None, high: float | None = None) -> Column:
    """Clamp while keeping NULL NULL (greatest/least skip NULLs on their own)."""
    x = col(c)
    out = x
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(x.isNotNull(), out)


def mid_price(bid: ColumnLike, ask: ColumnLike) -> Column:
    return (col(bid) + col(ask)) / 2.0


def both_positive_mid(bid: ColumnLike, ask: ColumnLike) -> Column:
    return F.when((col(bid) > 0) & (col(ask) > 0), mid_price(bid, ask))


def side_of(right: ColumnLike) -> Column:
    """Vendor spellings of the option side folded to ``call`` / ``put``."""
    x = F.lower(F.trim(col(right)))
    return F.when(x.isin("c", "call"), F.lit("call")).when(x.isin("p", "put"), F.lit("put"))


def minute_of_day(ts: ColumnLike) -> Column:
    return F.hour(col(ts)) * 60 + F.minute(col(ts))


def epoch_seconds(ts: ColumnLike) -> Column:
    """Seconds since 1970 read off the wall clock, independent of the session zone."""
    t = col(ts)
    days = F.datediff(t.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86400 + F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)


def bar_start(ts: ColumnLike, width: str) -> Column:
    """Start of the tumbling bar of the given width that holds ``ts``."""
    return F.window(col(ts), width).getField("start")


def target_delta_of(strategy: ColumnLike) -> Column:
    """Target delta read from a strategy label such as IC_25d_25w."""
    return F.regexp_extract(col(strategy), r"IC_(\d{2})d", 1).cast("double") / 100.0


def occ_symbol(root: ColumnLike, expiry: ColumnLike, right: ColumnLike, strike: ColumnLike) -> Column:
    """Option symbol: root, yymmdd, C or P, strike in thousandths over eight digits."""
    return F.concat(
        col(root),
        F.date_format(col(expiry), "yyMMdd"),
        F.when(side_of(right) == "call", F.lit("C")).otherwise(F.lit("P")),
        F.lpad(F.round(col(strike) * 1000).cast("long").cast("string"), 8, "0"),
    )


OCC_PATTERN = r"^([A-Z]+)(\d{6})([CP])(\d{8})$"


def parse_occ(symbol: ColumnLike) -> Column:
    """Struct of root, expiry, right and strike taken out of an option symbol."""
    s = col(symbol)

    def part(i: int) -> Column:
        return F.regexp_extract(s, OCC_PATTERN, i)

    ok = s.rlike(OCC_PATTERN)
    return F.when(
        ok,
        F.struct(
            part(1).alias("root"),
            F.try_to_date(part(2), "yyMMdd").alias("expiry"),
            F.when(part(3) == "C", "call").otherwise("put").alias("right"),
            (part(4).try_cast("double") / 1000.0).alias("strike"),
        ),
    )


def expected_value(prob: ColumnLike, win: ColumnLike, loss: ColumnLike, cost: float) -> Column:
    p = col(prob)
    return p * col(win) + (F.lit(1.0) - p) * col(loss) - F.lit(cost)


def half_kelly(prob: ColumnLike, win: ColumnLike, loss_abs: ColumnLike, floor: float = 0.15, cap: float = 0.02) -> Column:
    """Half of edge over odds, zero below the edge floor, capped per position."""
    odds = div(win, loss_abs)
    edge = col(prob) * odds - (F.lit(1.0) - col(prob))
    return F.when(edge < floor, F.lit(0.0)).otherwise(F.least(F.lit(0.5) * div(edge, odds), F.lit(cap)))


def cyclic_time(minutes: ColumnLike, period: float = 390.0) -> tuple[Column, Column]:
    angle = F.lit(2.0) * F.pi() * col(minutes) / F.lit(period)
    return F.sin(angle), F.cos(angle)
