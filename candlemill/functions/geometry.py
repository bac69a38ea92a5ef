"""Shape of a single candle: sizes, ratios, colour, type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlemill.functions.time import literal_map

COLORS = ["green", "red"]
TYPES = ["standard", "doji", "hammer", "inverted_hammer", "spinning_top", "marubozu"]
# What a candle type says.
DESCRIPTIONS = {
    "standard": "A regular candle with no special reversal or indecision pattern.",
    "doji": "A candle with a very small body, often showing market indecision.",
    "hammer": "A candle with a small body and long lower shadow that can signal bullish reversal.",
    "inverted_hammer": "A candle with a small body and long upper shadow that can signal a potential reversal.",
    "spinning_top": "A candle with a small body and visible upper and lower shadows, suggesting indecision.",
    "marubozu": "A strong momentum candle with a large body and very small shadows.",
}


def _zero(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def sizes() -> dict[str, Column]:
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return {
        "body_size": F.abs(c - o), "candle_size": _zero(h - low),
        "upper_wick_size": _zero(h - F.greatest(o, c)), "lower_wick_size": _zero(F.least(o, c) - low),
    }


def ratios() -> dict[str, Column]:
    """Centred shares of the candle, and plain ratios; null where the denominator is zero."""
    body, size, up, low = (F.col(x) for x in ("body_size", "candle_size", "upper_wick_size", "lower_wick_size"))
    half = F.lit(0.5)
    return {
        "upper_wick_to_candle_ratio": F.try_divide(up, size) - half, "lower_wick_to_candle_ratio": F.try_divide(low, size) - half,
        "body_to_candle_ratio": F.try_divide(body, size) - half, "upper_wick_to_body_ratio": F.try_divide(up, body),
        "lower_wick_to_body_ratio": F.try_divide(low, body), "wick_difference_to_candle_ratio": F.try_divide(up - low, size),
    }


def candle_color() -> Column:
    """Green where the lower wick is the longer one."""
    return F.when(F.col("lower_wick_size") > F.col("upper_wick_size"), "green").otherwise("red")


def candle_type() -> Column:
    """First shape that fits; the order matters."""
    body, size, up, low = (F.col(x) for x in ("body_size", "candle_size", "upper_wick_size", "lower_wick_size"))
    return (
        F.when((size == 0) | (body <= size * 0.1), "doji").when(body >= size * 0.9, "marubozu")
        .when((low >= body * 2) & (up <= body), "hammer").when((up >= body * 2) & (low <= body), "inverted_hammer")
        .when(body <= size * 0.3, "spinning_top").otherwise("standard")
    )


def describe_type(kind: Column) -> Column:
    return F.element_at(literal_map(DESCRIPTIONS), kind)


def one_hot() -> dict[str, Column]:
    kinds = {f"candle_color_{v}": (F.col("candle_color") == v).cast("int") for v in COLORS}
    return kinds | {f"candle_type_{v}": (F.col("candle_type") == v).cast("int") for v in TYPES}


def with_geometry(candles: DataFrame) -> DataFrame:
    """All geometry columns; projections only."""
    return candles.withColumns(sizes()).withColumns(ratios() | {"candle_color": candle_color(), "candle_type": candle_type()})
