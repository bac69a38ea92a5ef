"""Technical indicators as window columns over a series.

Each function takes candles and returns them with one column more. Warm-up rows are null by
row number, divisions by zero are null. Helper columns are dropped; Catalyst merges
windows over the same series into one exchange and one sort.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlemill.functions.scaling import scale_oscillator
from candlemill.operators import recurrence
from candlemill.operators.series import frame, position, series

Add = Callable[[DataFrame, str], DataFrame]


def _from(row: int, value: Column) -> Column:
    """Null before the 0-based row ``row`` of a series."""
    return F.when(position() > row, value)


def _staged(df: DataFrame, name: str, stages: dict[str, Column], value: Column) -> DataFrame:
    for k, c in stages.items():
        df = df.withColumn(k, c)
    return df.withColumn(name, value).drop(*stages)


def sma(period: int, column: str = "close") -> Add:
    return lambda df, name: df.withColumn(name, _from(period - 1, F.avg(column).over(frame(period - 1))))


def vma(period: int) -> Add:
    return sma(period, "volume")


def _vwap(period: int | None) -> Column:
    price = (F.col("high") + F.col("low") + F.col("close")) / 3
    w = frame(None if period is None else period - 1)
    value = F.try_divide(F.sum(price * F.col("volume")).over(w), F.sum("volume").over(w))
    return value if period is None else _from(period - 1, value)


def vwap(period: int | None = None) -> Add:
    return lambda df, name: df.withColumn(name, _vwap(period))


def vwap_distance(period: int | None = None, normalize: bool = True) -> Add:
    away = F.col("close") - F.col("_vwap")
    return lambda df, name: _staged(df, name, {"_vwap": _vwap(period)}, F.try_divide(away, F.col("_vwap")) if normalize else away)


def _rsi_stages(period: int) -> tuple[dict[str, Column], Column]:
    w = frame(period - 1)
    stages = {
        "_d": F.col("close") - F.lag("close").over(series()),
        "_g": F.avg(F.greatest(F.col("_d"), F.lit(0.0))).over(w), "_l": F.avg(F.greatest(-F.col("_d"), F.lit(0.0))).over(w),
    }
    value = F.when(F.col("_l") == 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + F.try_divide(F.col("_g"), F.col("_l"))))
    return stages, _from(period, value)


def rsi(period: int = 14, normalize: bool = False) -> Add:
    stages, value = _rsi_stages(period)
    return lambda df, name: _staged(df, name, stages, scale_oscillator(value) if normalize else value)


def bbw(period: int = 20, multiplier: float = 2.0) -> Add:
    w = frame(period - 1)
    value = F.try_divide(2 * multiplier * F.stddev_pop("close").over(w), F.avg("close").over(w))
    return lambda df, name: df.withColumn(name, _from(period - 1, value))


def _true_range() -> tuple[dict[str, Column], Column]:
    before = F.col("_pc")
    value = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    return {"_pc": F.lag("close").over(series())}, F.when(before.isNotNull(), value)


def true_range() -> Add:
    stages, value = _true_range()
    return lambda df, name: _staged(df, name, stages, value)


def atr(period: int = 14) -> Add:
    stages, value = _true_range()
    return lambda df, name: _staged(df, name, stages | {"_tr": value}, _from(period, F.avg("_tr").over(frame(period - 1))))


def directional_movement(plus: bool = True) -> Add:
    stages = {"_up": F.col("high") - F.lag("high").over(series()), "_down": F.lag("low").over(series()) - F.col("low")}
    a, b = (F.col("_up"), F.col("_down")) if plus else (F.col("_down"), F.col("_up"))
    return lambda df, name: _staged(df, name, stages, F.when((a > b) & (a > 0), a).when(a.isNotNull(), 0.0))


def rolling_volatility(period: int = 20, annualize: float | None = None) -> Add:
    before = F.col("_pc")
    stages = {"_pc": F.lag("close").over(series()), "_r": F.when((before > 0) & (F.col("close") > 0), F.ln(F.try_divide(F.col("close"), F.when(before != 0, before))))}
    w = frame(period - 1)
    value = F.when(F.count("_r").over(w) == period, F.stddev_pop("_r").over(w) * (annualize**0.5 if annualize else 1.0))
    return lambda df, name: _staged(df, name, stages, _from(period, value))


def _stochastic(high: str, low: str, value: str, period: int) -> Column:
    w = frame(period - 1)
    least, most = F.min(low).over(w), F.max(high).over(w)
    return F.try_divide(F.col(value) - least, most - least) * 100.0


def stochastic(period: int = 14, normalize: bool = False) -> Add:
    value = _from(period - 1, _stochastic("high", "low", "close", period))
    return lambda df, name: df.withColumn(name, scale_oscillator(value) if normalize else value)


def stochastic_rsi(rsi_period: int = 14, stoch_period: int = 14, normalize: bool = False) -> Add:
    stages, strength = _rsi_stages(rsi_period)
    value = _from(rsi_period + stoch_period - 1, _stochastic("_s", "_s", "_s", stoch_period))
    return lambda df, name: _staged(df, name, stages | {"_s": strength}, scale_oscillator(value) if normalize else value)


def obv() -> Add:
    change = F.col("_d")
    signed = F.when(change > 0, F.col("volume")).when(change < 0, -F.col("volume")).otherwise(0.0)
    stages = {"_d": F.col("close") - F.lag("close").over(series()), "_v": signed}
    return lambda df, name: _staged(df, name, stages, _from(1, F.sum("_v").over(frame(None))))


def log_volume_zscore(n: int = 5) -> Add:
    """Log volume against mean and sample deviation of the ``n`` rows before; unscaled, null in warm-up.

    Without deviation the value is infinite with the sign of the difference, or 0.
    """
    w = frame(n, -1)
    stages = {"_x": F.when(F.col("volume") >= 0, F.log1p("volume")), "_n": F.count("_x").over(w), "_m": F.avg("_x").over(w), "_s": F.stddev_samp("_x").over(w)}
    away = F.col("_x") - F.col("_m")
    value = F.when(F.col("_s") > 0, away / F.col("_s")).when(away > 0, float("inf")).when(away < 0, float("-inf")).when(away == 0, 0.0)
    return lambda df, name: _staged(df, name, stages, F.when(F.col("_n") == n, value))


def popular() -> tuple[dict[str, Add], dict[str, recurrence.Scan]]:
    """The usual bundle of 17 indicators: window columns, and recurrences."""
    windows = {
        "ma_20": sma(20), "ma_50": sma(50), "vwap": vwap(), "vwapdist_20": vwap_distance(20), "rsi_14": rsi(14), "bbw_20": bbw(20), "atr_14": atr(14),
        "rvol_20": rolling_volatility(20), "stoch_14": stochastic(14), "stochrsi_14_14": stochastic_rsi(14, 14), "obv": obv(),
    }
    scans = {
        "ema_9": recurrence.ema(9), "ema_21": recurrence.ema(21), "emaslope_9_3": recurrence.ema_slope(9, 3), "macd_12_26": recurrence.macd(12, 26),
        "macdhist_12_26_9": recurrence.macd_hist(12, 26, 9), "adx_14": recurrence.adx(14),
    }
    return windows, scans


def add_indicators(candles: DataFrame, windows: dict[str, Add] | None = None, scans: dict[str, recurrence.Scan | recurrence.Whole] | None = None) -> DataFrame:
    """Add named indicator columns; same-named ones are replaced, new ones follow the others.

    Window columns come first and recurrences last, so both share one exchange and sort.
    """
    windows, scans = windows or {}, scans or {}
    names = [*candles.columns, *(n for n in [*windows, *scans] if n not in candles.columns)]
    out = candles
    for name, add in windows.items():
        out = add(out, name)
    if scans:
        out = recurrence.with_recurrences(out, scans)
    return out.select(names)
