"""Chart units of indicator names: the longest matching prefix decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Name prefixes and their units.
UNITS = {
    "MA": "price", "EMASLOPE": "percent", "EMA": "price", "VWAPDIST": "percent", "VWAP": "price", "RSI": "oscillator", "STOCH": "oscillator",
    "MACD": "volatility", "ADX": "oscillator", "BBW": "percent", "ATR": "volatility", "RVOL": "volatility", "OBV": "volume",
}


def indicator_unit(name: Column, extra: dict[str, str] | None = None) -> Column:
    units = UNITS | {k.upper().strip(): v for k, v in (extra or {}).items()}
    out = None
    for prefix in sorted(units, key=lambda p: (-len(p), p)):
        test = F.upper(F.trim(name)).startswith(F.lit(prefix))
        out = F.when(test, units[prefix]) if out is None else out.when(test, units[prefix])
    return out.otherwise("raw")


def indicators_long(candles: DataFrame, names: list[str]) -> DataFrame:
    """One row for each candle and indicator value that is not null, with its unit."""
    long = candles.unpivot(["symbol", "interval", "ts"], names, "name", "value")
    return long.filter(F.col("value").isNotNull()).withColumn("unit", indicator_unit(F.col("name")))
