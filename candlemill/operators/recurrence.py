"""Recurrences over a series: seeded exponential averages, MACD, ADX.

A recurrence is a ``Scan``: it takes the next rows of a series with the state its earlier rows left, a
few numbers. ``with_recurrences`` runs scans over Arrow batches of rows in series order, so a task
holds a batch and not a series; live streams run the same scans with their state in the state store, many short series at
once (``advanced_many``).
``longseries`` carries them over chunks, so that one series can be shared by many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from candlemill.operators.series import KEYS, position

State = list[float]
#: Columns of many series as (series, rows), NaN past a series' end, their lengths, and a state each.
Grid = Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
#: A function of a whole series, for user-made indicators that cannot be written as a scan.
Whole = Callable[[pd.DataFrame], np.ndarray]
NAN = float("nan")


@dataclass(frozen=True)
class Scan:
    """Values of the next rows, and the state after them, from their columns and the state before.

    ``grid``, if there is one, does for many series at once what ``run`` does for one.
    """

    columns: tuple[str, ...]
    start: tuple[float, ...]
    run: Callable[[dict[str, np.ndarray], State], tuple[np.ndarray, State]]
    grid: Grid | None = None


#: State of a smoothing: values so far (up to the period), and their running mean.
FRESH = (0.0, 0.0)


def advance(x: np.ndarray, period: int, alpha: float, state: State) -> tuple[np.ndarray, State]:
    """Exponential smoothing seeded with the mean of the first ``period`` values; NaN before, and where x is NaN."""
    n, v = int(state[0]), state[1]
    out = np.full(len(x), np.nan)
    some = ~np.isnan(x)
    y = x[some]
    seed = min(max(period - n, 0), len(y))
    made = np.full(len(y), np.nan)
    if seed:
        n, v = n + seed, v + float(y[:seed].sum()) / period
        if n == period:
            made[seed - 1] = v
    if seed < len(y):
        made[seed:] = pd.Series(np.concatenate([[v], y[seed:]])).ewm(alpha=alpha, adjust=False).mean().to_numpy()[1:]
        v = float(made[-1])
    out[some] = made
    return out, [float(n), v]


def advance_grid(x: np.ndarray, period: int, alpha: float, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``advance`` of many series, a row of ``x`` each: all of them take a step together."""
    n, v = state[:, 0].copy(), state[:, 1].copy()
    out = np.full(x.shape[::-1], np.nan)
    for made, y in zip(out, np.ascontiguousarray(x.T), strict=True):
        some = ~np.isnan(y)
        seed = some & (n < period)
        if seed.any():
            n += seed
            v[seed] += y[seed] / period
            np.copyto(v, v + alpha * (y - v), where=some & ~seed)
            np.copyto(made, v, where=some & (n >= period))
        else:
            np.copyto(v, v + alpha * (y - v), where=some)
            np.copyto(made, v, where=some)
    return out.T, np.stack([n, v], axis=1)


def newest(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The last value of each series of a grid."""
    return x[np.arange(len(x)), lengths - 1][:, None]


def newest_of(x: np.ndarray, lengths: np.ndarray, rows: int) -> np.ndarray:
    """The last ``rows`` values of each series of a grid that begins with ``rows`` values of before."""
    return np.take_along_axis(x, lengths[:, None] + np.arange(rows)[None], axis=1)


def advanced_many(scans: dict[str, Scan], columns: dict[str, np.ndarray], lengths: np.ndarray, states: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Values by scan of the next rows of many series, one series after the other, and their states (all scans' in a row) after them.

    Series of up to twice one length pass together as a grid, where they are many or short enough for that.
    """
    lengths = np.asarray(lengths, np.int64)
    starts = np.cumsum(lengths) - lengths
    values, after = {n: np.full(int(lengths.sum()), np.nan) for n in scans}, np.array(states, float)
    places = dict(zip(scans, np.cumsum([0, *(len(s.start) for s in scans.values())]).tolist(), strict=False))
    classes = np.where(lengths > 0, np.ceil(np.log2(np.maximum(lengths, 1))), -1)
    for c in np.unique(classes[classes >= 0]):
        some = np.flatnonzero(classes == c)
        own, steps = lengths[some], np.arange(lengths[some].max())
        there = steps[None] < own[:, None]
        at = np.where(there, starts[some][:, None] + steps[None], 0)
        gridded = len(some) * 8 >= len(steps)
        g = {k: np.where(there, x[at], np.nan) for k, x in columns.items()} if gridded else {}
        for n, s in scans.items():
            part = slice(places[n], places[n] + len(s.start))
            if s.grid and gridded:
                made, state = s.grid({k: g[k] for k in s.columns}, own, after[some, part])
                values[n][at[there]], after[some, part] = made[there], state
                continue
            for i in some:
                rows = slice(starts[i], starts[i] + lengths[i])
                values[n][rows], state = s.run({k: columns[k][rows] for k in s.columns}, after[i, part].tolist())
                after[i, part] = state
    return values, after


def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.full(np.shape(a), np.nan)
    np.divide(a, b, out=out, where=b != 0)
    return out


def before(x: np.ndarray, last: float) -> np.ndarray:
    """The value of the row before each row."""
    return np.concatenate([[last], x[:-1]])


def before_grid(x: np.ndarray, last: np.ndarray) -> np.ndarray:
    return np.concatenate([last[:, None], x[:, :-1]], axis=1)


def ema(period: int, column: str = "close") -> Scan:
    alpha = 2.0 / (period + 1)
    return Scan((column,), FRESH, lambda g, s: advance(g[column], period, alpha, s), lambda g, n, s: advance_grid(g[column], period, alpha, s))


def ema_slope(period: int = 9, slope_period: int = 3, normalize: bool = True) -> Scan:
    def run(g: dict[str, np.ndarray], s: State) -> tuple[np.ndarray, State]:
        e, own = advance(g["close"], period, 2.0 / (period + 1), s[:2])
        every = np.concatenate([s[2:], e])
        past = every[: len(e)]
        slope = (e - past) / slope_period
        return ratio(slope, np.abs(past)) if normalize else slope, [*own, *every[len(e) :].tolist()]

    def grid(g: dict[str, np.ndarray], n: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        e, own = advance_grid(g["close"], period, 2.0 / (period + 1), s[:, :2])
        every = np.concatenate([s[:, 2:], e], axis=1)
        past = every[:, : e.shape[1]]
        slope = (e - past) / slope_period
        return ratio(slope, np.abs(past)) if normalize else slope, np.concatenate([own, newest_of(every, n, slope_period)], axis=1)

    return Scan(("close",), (*FRESH, *[NAN] * slope_period), run, grid)


def macd(fast: int = 12, slow: int = 26, column: str = "close") -> Scan:
    if fast >= slow:
        raise ValueError("the fast period must be shorter than the slow one")

    def run(g: dict[str, np.ndarray], s: State) -> tuple[np.ndarray, State]:
        f, a = advance(g[column], fast, 2.0 / (fast + 1), s[:2])
        w, b = advance(g[column], slow, 2.0 / (slow + 1), s[2:])
        return f - w, [*a, *b]

    def grid(g: dict[str, np.ndarray], n: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        f, a = advance_grid(g[column], fast, 2.0 / (fast + 1), s[:, :2])
        w, b = advance_grid(g[column], slow, 2.0 / (slow + 1), s[:, 2:])
        return f - w, np.concatenate([a, b], axis=1)

    return Scan((column,), FRESH * 2, run, grid)


def macd_hist(fast: int = 12, slow: int = 26, signal: int = 9, normalize: bool = False) -> Scan:
    line = macd(fast, slow)

    def run(g: dict[str, np.ndarray], s: State) -> tuple[np.ndarray, State]:
        m, own = line.run(g, s[:4])
        e, a = advance(m, signal, 2.0 / (signal + 1), s[4:])
        return ratio(m - e, g["close"]) if normalize else m - e, [*own, *a]

    def grid(g: dict[str, np.ndarray], n: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m, own = line.grid(g, n, s[:, :4])
        e, a = advance_grid(m, signal, 2.0 / (signal + 1), s[:, 4:])
        return ratio(m - e, g["close"]) if normalize else m - e, np.concatenate([own, a], axis=1)

    return Scan(("close",), FRESH * 3, run, grid)


def adx(period: int = 14, normalize: bool = False) -> Scan:
    def run(g: dict[str, np.ndarray], s: State) -> tuple[np.ndarray, State]:
        h, low, c = g["high"], g["low"], g["close"]
        ph, pl, pc = before(h, s[0]), before(low, s[1]), before(c, s[2])
        up, down = h - ph, pl - low
        first = np.isnan(pc)
        plus, minus = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
        tr = np.maximum(h - low, np.maximum(np.abs(h - pc), np.abs(low - pc)))
        state = [float(h[-1]), float(low[-1]), float(c[-1])]
        smooth = []
        for i, x in enumerate((tr, plus, minus)):
            y, own = advance(np.where(first, np.nan, x), period, 1.0 / period, s[3 + 2 * i : 5 + 2 * i])
            smooth.append(y)
            state += own
        t, p, m = smooth
        di_p, di_m = 100 * ratio(p, t), 100 * ratio(m, t)
        out, own = advance(100 * ratio(np.abs(di_p - di_m), di_p + di_m), period, 1.0 / period, s[9:])
        return out / 100 if normalize else out, [*state, *own]

    def grid(g: dict[str, np.ndarray], n: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h, low, c = g["high"], g["low"], g["close"]
        ph, pl, pc = (before_grid(x, s[:, i]) for i, x in enumerate((h, low, c)))
        up, down = h - ph, pl - low
        first = np.isnan(pc)
        plus, minus = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
        tr = np.maximum(h - low, np.maximum(np.abs(h - pc), np.abs(low - pc)))
        # no step past a series' end: there the moves would be 0, not NaN
        gone = first | (np.arange(h.shape[1])[None] >= n[:, None])
        state, smooth = [newest(x, n) for x in (h, low, c)], []
        for i, x in enumerate((tr, plus, minus)):
            y, own = advance_grid(np.where(gone, np.nan, x), period, 1.0 / period, s[:, 3 + 2 * i : 5 + 2 * i])
            smooth.append(y)
            state.append(own)
        t, p, m = smooth
        di_p, di_m = 100 * ratio(p, t), 100 * ratio(m, t)
        out, own = advance_grid(100 * ratio(np.abs(di_p - di_m), di_p + di_m), period, 1.0 / period, s[:, 9:])
        return out / 100 if normalize else out, np.concatenate([*state, own], axis=1)

    return Scan(("high", "low", "close"), (NAN, NAN, NAN, *FRESH * 4), run, grid)


def with_recurrences(candles: DataFrame, specs: dict[str, Scan | Whole]) -> DataFrame:
    """Add one double column for each spec; NaN becomes null.

    Rows come in series order, numbered, from the same exchange and sort that window columns use. Scans are
    streamed over them; functions of a whole series (``Whole``) need a group in memory each.
    """
    scans = {n: s for n, s in specs.items() if isinstance(s, Scan)}
    whole = {n: s for n, s in specs.items() if not isinstance(s, Scan)}
    out = candles.select([c for c in candles.columns if c not in specs])
    if whole:
        out = _grouped(out, whole)
    return _streamed(out, scans) if scans else out


def _streamed(candles: DataFrame, scans: dict[str, Scan]) -> DataFrame:
    carried = candles.columns
    needed = list(dict.fromkeys(c for s in scans.values() for c in s.columns))
    k = len(carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[str, State] = {}
        for batch in batches:
            starts = np.flatnonzero(batch.column(k).to_numpy() == 1)
            columns = {c: batch.column(k + 1 + i).to_numpy(zero_copy_only=False).astype(float) for i, c in enumerate(needed)}
            values = {n: np.empty(len(batch)) for n in scans}
            edges = [0, *starts[starts > 0].tolist(), len(batch)]
            fresh = set(starts.tolist())
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if lo == hi:
                    continue
                part = {c: x[lo:hi] for c, x in columns.items()}
                for n, s in scans.items():
                    state = list(s.start) if lo in fresh else states[n]
                    values[n][lo:hi], states[n] = s.run(part, state)
            made = [pa.array(v, pa.float64(), mask=np.isnan(v)) for v in values.values()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(k)), *made], names=[*carried, *scans])

    rows = candles.withColumn("_rn", position()).select(*carried, "_rn", *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(needed)])
    return rows.mapInArrow(run, StructType([*candles.schema.fields, *(StructField(n, DoubleType()) for n in scans)]))


def _grouped(candles: DataFrame, specs: dict[str, Whole]) -> DataFrame:
    fields = [*candles.schema.fields, *(StructField(n, DoubleType()) for n in specs)]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("ts", kind="stable").reset_index(drop=True)
        for name, f in specs.items():
            g[name] = np.asarray(f(g), float)
        return g

    out = candles.groupBy(*KEYS).applyInPandas(run, StructType(fields))
    return out.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in specs})
