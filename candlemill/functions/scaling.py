"""Bounded forms of indicator values for models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def scale_oscillator(value: Column) -> Column:
    """0..100 to -1..1; null stays null."""
    return (value - 50.0) / 50.0


def bounded(x: Column, low: float, high: float) -> Column:
    """Clipped to [low, high] and divided by high; null stays null (``least`` alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)) / high)


def clip_zscore(z: Column) -> Column:
    return F.coalesce(bounded(z, -3.0, 3.0), F.lit(0.0))


def clip_macd(macd: Column, close: Column) -> Column:
    return F.coalesce(bounded(_finite(F.try_divide(macd, close)), -0.05, 0.05), F.lit(0.0))


def clip_atr(atr: Column, close: Column) -> Column:
    return F.coalesce(bounded(_finite(F.try_divide(atr, close)), 0.0, 0.05), F.lit(0.0))
