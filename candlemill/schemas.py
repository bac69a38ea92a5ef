"""Schemas of candle, tick, instrument and prediction tables."""

from __future__ import annotations

CANDLE = "symbol string, interval string, ts timestamp_ntz, open double, high double, low double, close double, volume double"
CANDLE_COLUMNS = ["symbol", "interval", "ts", "open", "high", "low", "close", "volume"]
#: Geometry columns a stored candle also carries, in file order.
GEOMETRY_COLUMNS = [
    "candle_type", "candle_color", "body_size", "upper_wick_size", "lower_wick_size", "candle_size",
    "upper_wick_to_candle_ratio", "lower_wick_to_candle_ratio", "upper_wick_to_body_ratio", "lower_wick_to_body_ratio",
    "wick_difference_to_candle_ratio", "body_to_candle_ratio",
]
TICK = (
    "instrument_token long, last_price double, volume_traded double, last_traded_quantity double, last_quantity double, "
    "quantity double, timestamp timestamp, exchange_timestamp timestamp, last_trade_time timestamp"
)
INSTRUMENT = "exchange string, tradingsymbol string, instrument_token long"


def require(df, columns: list[str], where: str = "table") -> None:
    """Raise with the list of missing columns (a check of the plan's schema, no job)."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{where} lacks columns: {', '.join(missing)}")
