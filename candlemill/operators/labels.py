"""Labels from the rows ahead: fixed-horizon returns and triple barriers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlemill.operators.features import Features, encode_features
from candlemill.operators.series import frame, series

LABELS = ["label_lower", "label_neutral", "label_upper"]


@dataclass
class Barriers:
    upper: float = 5.0
    lower: float = 5.0
    horizon: int = 35
    tie: str = "lower"
    vertical: str = "return"

    def __post_init__(self) -> None:
        if self.upper <= 0 or self.lower <= 0 or self.horizon < 1:
            raise ValueError("barriers and the horizon must be positive")
        if self.tie not in ("lower", "upper", "neutral") or self.vertical not in ("return", "neutral"):
            raise ValueError("unknown tie or vertical rule")


def fixed_horizon_return(horizon: int) -> Column:
    """close ``horizon`` rows ahead over close, less 1; null at the end and where not finite."""
    r = F.try_divide(F.lead("close", horizon).over(series()), F.col("close")) - 1
    return F.when(~F.isnan(r) & (F.abs(r) != float("inf")), r)


def barrier_side(b: Barriers) -> tuple[dict[str, Column], Column]:
    """(helper columns, label -1/0/1): the side touched first within the horizon.

    The rows ahead are an array of at most ``horizon`` pairs that is reduced at once.
    """
    top, bottom = F.col("close") * (1 + b.upper / 100), F.col("close") * (1 - b.lower / 100)
    stages = {
        "_ahead": F.collect_list(F.struct("high", "low")).over(frame(-1, b.horizon)),
        "_there": F.lead(F.lit(1), b.horizon).over(series()),
        "_ret": fixed_horizon_return(b.horizon),
    }
    tie = {"lower": -1, "upper": 1, "neutral": 0}[b.tie]
    up, down = (lambda x: x["high"] >= top), (lambda x: x["low"] <= bottom)
    touch = F.filter("_ahead", lambda x: up(x) | down(x))
    first = F.get(touch, F.lit(0))
    hit = F.when(up(first) & down(first), tie).when(up(first), 1).otherwise(-1)
    end = F.lit(0) if b.vertical == "neutral" else F.signum("_ret").cast("int")
    return stages, F.when(F.col("_there").isNotNull(), F.when(F.size(touch) > 0, hit).otherwise(end))


def triple_barrier(candles: DataFrame, b: Barriers) -> DataFrame:
    """Candles with one-hot label columns; the last ``horizon`` rows of a series have none."""
    stages, side = barrier_side(b)
    out = candles
    for n, c in stages.items():
        out = out.withColumn(n, c)
    out = out.withColumn("_side", side).drop(*stages)
    return out.withColumns({n: (F.col("_side") == v).cast("int") for n, v in zip(LABELS, (-1, 0, 1), strict=True)}).drop("_side")


def return_label(candles: DataFrame, horizon: int, name: str = "label_return") -> DataFrame:
    return candles.withColumn(name, fixed_horizon_return(horizon))


def drop_unlabelled(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return rows.na.drop(subset=columns or [c for c in LABELS if c in rows.columns])


def join_features_labels(features: DataFrame, labels: DataFrame, label_columns: list[str]) -> DataFrame:
    """Features with the labels of the same candle; label columns win over same-named features."""
    keys = ["symbol", "interval", "ts"]
    return features.drop(*label_columns).join(labels.select(*keys, *label_columns), keys)


def labelled_dataset(candles: DataFrame, features: Features, b: Barriers, drop: bool = True) -> DataFrame:
    """Features and labels in one pass over the series: labels ride along as extra columns."""
    both = encode_features(triple_barrier(candles, b), features)
    return drop_unlabelled(both, LABELS) if drop else both
