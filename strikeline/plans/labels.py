"""Labels straight from a chain: entries at the quote minute itself."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikeline.operators.chain import pivot_sides
from strikeline.plans.outcomes import build_outcomes
from strikeline.plans.spine import build_spine
from strikeline.plans.tables import settle


def quote_state(chain: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Chain pivoted per minute and strike with bid/ask mids and the minute's median underlying.

    The median runs over one minute's quotes, at most two per listed strike.
    """
    x = chain.withColumns({"mid_close": (F.col("bid") + F.col("ask")) / 2.0, "bid_close": F.col("bid"), "decision_datetime": F.col("timestamp")})
    day = [*keys, "date", "decision_datetime"]
    spot = x.groupBy(*day).agg(F.percentile("underlying_price", 0.5).alias("spx_close"))
    return pivot_sides(x, [*day, "strike"], "right", ["bid_close", "mid_close", "delta", "implied_vol"]).join(spot, day)


def build_entry_labels(chain: DataFrame, keys: Sequence[str] = (), start: str = "09:30", end: str = "15:00", min_quotes: int = 10, long_form: bool = False) -> DataFrame:
    """Every strategy at every minute with its nine races and the minutes left to the last quote.

    Combinations are not deduplicated, and the race ends at the fixed close even
    when that minute has no quote. Entries without a later quote are left out.
    """
    state = settle(quote_state(chain, keys), "quotes")
    spine = settle(build_spine(state, keys, start, end, min_quotes=min_quotes, dedup=False), "entries")
    out = build_outcomes(spine, state, keys, close=end, long_form=long_form, fallback_close=False)
    return out.where(F.col("time_to_close_min").isNotNull()).withColumn("spx_at_entry", F.round("spx_prev_min_close", 2))
