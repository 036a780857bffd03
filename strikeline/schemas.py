"""Declared table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

D, L, S, I = T.DoubleType(), T.LongType(), T.StringType(), T.IntegerType()
DATE, TS = T.DateType(), T.TimestampNTZType()


def _schema(**cols: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in cols.items()])


OHLC = ("open", "high", "low", "close")
BARS_1MIN = _schema(datetime=TS, **{c: D for c in OHLC})
VIX_1MIN = _schema(datetime=TS, **{f"vix_{c}": D for c in OHLC})
VIX1D_1MIN = _schema(datetime=TS, **{f"vix1d_{c}": D for c in OHLC})
CHAIN_INTRADAY = _schema(
    date=DATE, strike=D, right=S, timestamp=TS,
    **{c: D for c in ("underlying_price", "bid", "ask", "mid", "delta", "gamma", "theta", "vega", "rho", "implied_vol", "iv_error")},
)
CHAIN_EOD = _schema(date=DATE, expiration=DATE, strike=D, right=S, **{c: D for c in OHLC}, volume=L, bid=D, ask=D, bid_size=L, ask_size=L)
OPEN_INTEREST = _schema(date=DATE, expiration=DATE, strike=D, right=S, open_interest=L)
TERM_STRUCTURE = _schema(
    date=DATE, expiration=DATE, dte=I, strike=D, right=S, **{c: D for c in ("spx_close", "atm_strike", "moneyness", "bid", "ask", "mid")}, volume=L
)
DAILY_OHLC = _schema(date=DATE, **{c: D for c in OHLC}, volume=L)
QUOTES_TICK = _schema(timestamp=TS, strike=D, right=S, bid=D, ask=D)
EVENTS = _schema(date=DATE, event=S)
EARNINGS = _schema(symbol=S, date=DATE, time_of_day=S)
REGIME_DAILY = _schema(date=DATE, regime_state=I, regime_prob_highvol=D, regime_prob_lowvol=D, regime_duration=I, regime_switch=I)
GEX_REGIME_DAILY = _schema(date=DATE, gex_regime=I, gex_regime_prob_pos=D, gex_regime_prob_trans=D, gex_regime_prob_neg=D, gex_regime_duration=I, gex_regime_switch=I)
