"""Candles from trade ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlemill.functions.time import candle_bucket


def volume_delta(ticks: DataFrame, token: str = "instrument_token", order: list[str] | None = None) -> DataFrame:
    """Ticks with ``volume_delta``: rise of the token's cumulative volume, or the tick's own quantity.

    Expects ``volume_traded`` (cumulative, may be null) and ``trade_quantity``. A fall (a reset) counts
    the quantity and starts anew.
    """
    w = Window.partitionBy(token).orderBy(*(order or ["event_time"])).rowsBetween(Window.unboundedPreceding, -1)
    before = F.last("volume_traded", ignorenulls=True).over(w)
    now = F.col("volume_traded")
    rise = F.when(now.isNotNull() & before.isNotNull() & (now >= before), now - before)
    return ticks.withColumn("volume_delta", F.coalesce(rise, F.col("trade_quantity")))


def ticks_to_candles(ticks: DataFrame, interval: str, price: str = "last_price", volume: str = "volume_delta", time: str = "event_time", order: list[str] | None = None) -> DataFrame:
    """OHLCV by symbol and bucket; partial sums, extremes and first/last prices combine before the shuffle."""
    at: Column = F.struct(*(order or [time]))
    bucket = candle_bucket(F.col(time), F.lit(interval))
    return (
        ticks.groupBy("symbol", F.lit(interval).alias("interval"), bucket.alias("ts"))
        .agg(F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.sum(volume).alias("volume"))
    )
