"""Bounded indicators as scans: the next value of a live series from the few rows it looks back on."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from candlemill.operators import recurrence
from candlemill.operators.recurrence import NAN, Scan, State

PRICES = ("high", "low", "close")


def looking_back(columns: tuple[str, ...], rows: int, values: Callable[..., np.ndarray]) -> Scan:
    """``values`` of the last ``rows`` rows of each column; NaN while a series is shorter. The state holds one row less.

    ``values`` takes each column with the rows held before it, and gives a value for every new row, from the last
    ``rows`` rows alone: it may be given many series one after the other.
    """
    keep = rows - 1

    def run(g: dict[str, np.ndarray], s: State) -> tuple[np.ndarray, State]:
        old = int(s[0])
        held = [np.concatenate([s[1 + i * keep : 1 + (i + 1) * keep], g[c]]) for i, c in enumerate(columns)]
        n = len(held[0]) - keep
        with np.errstate(all="ignore"):
            out = np.where(np.arange(n) >= keep - old, values(*held), np.nan)
        tail = [x for h in held for x in h[len(h) - keep :].tolist()]
        return out, [float(min(old + n, keep)), *tail]

    def grid(g: dict[str, np.ndarray], n: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        old = s[:, :1]
        held = [np.concatenate([s[:, 1 + i * keep : 1 + (i + 1) * keep], g[c]], axis=1) for i, c in enumerate(columns)]
        count, width = held[0].shape
        with np.errstate(all="ignore"):
            flat = values(*(h.reshape(-1) for h in held))
        # the first rows' values are of windows that reach into the series before
        made = np.concatenate([np.full(keep, np.nan), flat]).reshape(count, width)[:, keep:]
        made = np.where(np.arange(width - keep)[None] >= keep - old, made, np.nan)
        return made, np.concatenate([np.minimum(old + n[:, None], keep), *(recurrence.newest_of(h, n, keep) for h in held)], axis=1)

    return Scan(columns, (0.0, *[NAN] * (keep * len(columns))), run, grid)


def last(x: np.ndarray, rows: int) -> np.ndarray:
    """The last ``rows`` values at each row that has so many, a row each."""
    return np.lib.stride_tricks.sliding_window_view(x, rows)


def _strength(close: np.ndarray, period: int) -> np.ndarray:
    d = np.diff(close)
    gain, loss = last(np.maximum(d, 0), period).mean(axis=1), last(np.maximum(-d, 0), period).mean(axis=1)
    return np.where(loss == 0, 100.0, 100.0 - 100.0 / (1.0 + recurrence.ratio(gain, loss)))


def _place(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return recurrence.ratio(x - low, high - low) * 100.0


def sma(period: int, column: str = "close") -> Scan:
    return looking_back((column,), period, lambda x: last(x, period).mean(axis=1))


def vwap_distance(period: int) -> Scan:
    def values(h: np.ndarray, low: np.ndarray, c: np.ndarray, v: np.ndarray) -> np.ndarray:
        mean = recurrence.ratio(last((h + low + c) / 3 * v, period).sum(axis=1), last(v, period).sum(axis=1))
        return recurrence.ratio(c[period - 1 :] - mean, mean)

    return looking_back((*PRICES, "volume"), period, values)


def rsi(period: int) -> Scan:
    return looking_back(("close",), period + 1, lambda c: _strength(c, period))


def bbw(period: int, multiplier: float = 2.0) -> Scan:
    return looking_back(("close",), period, lambda c: recurrence.ratio(2 * multiplier * last(c, period).std(axis=1), last(c, period).mean(axis=1)))


def atr(period: int) -> Scan:
    def values(h: np.ndarray, low: np.ndarray, c: np.ndarray) -> np.ndarray:
        return last(np.maximum(h[1:] - low[1:], np.maximum(abs(h[1:] - c[:-1]), abs(low[1:] - c[:-1]))), period).mean(axis=1)

    return looking_back(PRICES, period + 1, values)


def rolling_volatility(period: int) -> Scan:
    def values(c: np.ndarray) -> np.ndarray:
        return last(np.where((c[1:] > 0) & (c[:-1] > 0), np.log(c[1:] / c[:-1]), np.nan), period).std(axis=1)

    return looking_back(("close",), period + 1, values)


def stochastic(period: int) -> Scan:
    return looking_back(PRICES, period, lambda h, low, c: _place(c[period - 1 :], last(low, period).min(axis=1), last(h, period).max(axis=1)))


def stochastic_rsi(rsi_period: int, stoch_period: int) -> Scan:
    def values(c: np.ndarray) -> np.ndarray:
        s = _strength(c, rsi_period)
        held = last(s, stoch_period)
        return _place(s[stoch_period - 1 :], held.min(axis=1), held.max(axis=1))

    return looking_back(("close",), rsi_period + stoch_period, values)


def log_volume_zscore(n: int) -> Scan:
    def values(v: np.ndarray) -> np.ndarray:
        x = np.where(v < 0, np.nan, np.log1p(v))
        before = last(x[:-1], n)
        away, s = x[n:] - before.mean(axis=1), before.std(axis=1, ddof=1)
        return np.where(s > 0, away / s, np.where(away == 0, 0.0, np.sign(away) * np.inf))

    return looking_back(("volume",), n + 1, values)


def vwap() -> Scan:
    def run(g: dict[str, np.ndarray], s: State) -> tuple[np.ndarray, State]:
        paid = s[0] + np.cumsum((g["high"] + g["low"] + g["close"]) / 3 * g["volume"])
        held = s[1] + np.cumsum(g["volume"])
        return recurrence.ratio(paid, held), [float(paid[-1]), float(held[-1])]

    def grid(g: dict[str, np.ndarray], n: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        paid = s[:, :1] + np.cumsum((g["high"] + g["low"] + g["close"]) / 3 * g["volume"], axis=1)
        held = s[:, 1:] + np.cumsum(g["volume"], axis=1)
        return recurrence.ratio(paid, held), np.concatenate([recurrence.newest(paid, n), recurrence.newest(held, n)], axis=1)

    return Scan((*PRICES, "volume"), (0.0, 0.0), run, grid)


def obv() -> Scan:
    def run(g: dict[str, np.ndarray], s: State) -> tuple[np.ndarray, State]:
        d = g["close"] - recurrence.before(g["close"], s[0])
        total = s[1] + np.cumsum(np.where(d > 0, g["volume"], np.where(d < 0, -g["volume"], 0.0)))
        return np.where(np.isnan(d), np.nan, total), [float(g["close"][-1]), float(total[-1])]

    def grid(g: dict[str, np.ndarray], n: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = g["close"] - recurrence.before_grid(g["close"], s[:, 0])
        total = s[:, 1:] + np.cumsum(np.where(d > 0, g["volume"], np.where(d < 0, -g["volume"], 0.0)), axis=1)
        return np.where(np.isnan(d), np.nan, total), np.concatenate([recurrence.newest(g["close"], n), recurrence.newest(total, n)], axis=1)

    return Scan(("close", "volume"), (NAN, 0.0), run, grid)


def popular() -> dict[str, Scan]:
    """The usual bundle of 17 indicators, live."""
    return {
        "ma_20": sma(20), "ma_50": sma(50), "vwap": vwap(), "vwapdist_20": vwap_distance(20), "rsi_14": rsi(14), "bbw_20": bbw(20), "atr_14": atr(14),
        "rvol_20": rolling_volatility(20), "stoch_14": stochastic(14), "stochrsi_14_14": stochastic_rsi(14, 14), "obv": obv(),
        "ema_9": recurrence.ema(9), "ema_21": recurrence.ema(21), "emaslope_9_3": recurrence.ema_slope(9, 3), "macd_12_26": recurrence.macd(12, 26),
        "macdhist_12_26_9": recurrence.macd_hist(12, 26, 9), "adx_14": recurrence.adx(14),
    }
