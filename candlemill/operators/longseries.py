"""Recurrences and running sums over series too long for one task.

Rows are numbered by calendar units (``series.number_rows``) and cut into chunks of ``size`` rows; no task
holds, sorts or walks a whole series, so one series may hold most of a table.

``scan`` runs an ``Affine`` scan. The carried part of its state passes through a chunk as an affine map, whatever
state comes in, so each chunk first returns its map (the scan itself, run from nothing and from each unit
state), the maps of a series are folded in order, a few numbers a chunk, and each chunk then runs the scan
from the state it begins with. The numbered rows are written to the shared folder once and read by both passes. ``adx`` composes two of these: Wilder sums give DX, and DX, counted where it is
not skipped, gives the average. ``prefix_sum``, ``vwap`` and ``obv`` need no Python: chunk totals, their running
sums, and local sums. ``triple_barrier`` finds first touches in chunks that see as many rows ahead as the horizon.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from candlemill.operators import recurrence
from candlemill.operators.labels import LABELS, Barriers
from candlemill.operators.recurrence import NAN, Scan, State, advance, before, ratio
from candlemill.operators.series import KEYS, halo, number_rows
from candlemill.session import written
from candlemill.sources.store import remove

#: Rows of a chunk.
SIZE = 4096
_CHUNK = [*KEYS, "chunk"]


@dataclass(frozen=True)
class Affine:
    """A scan whose state at positions ``carried`` passes through rows as an affine map.

    ``known`` gives the rest of the state before a row: from its number, the row before it (if ``halo`` asks for
    one), and how many values of ``counted`` the series has before it.
    """

    scan: Scan
    carried: tuple[int, ...]
    known: Callable[[int, dict[str, float] | None, int], State]
    halo: int = 0
    counted: str | None = None

    def begin(self, rn: int, row: dict[str, float] | None, count: int, carry: np.ndarray) -> State:
        state = list(self.known(rn, row, count))
        for i, v in zip(self.carried, carry, strict=True):
            state[i] = float(v)
        return state

    def end(self, columns: dict[str, np.ndarray], state: State) -> np.ndarray:
        after = self.scan.run(columns, state)[1]
        return np.array([after[i] for i in self.carried])


def _seen(n: int, period: int) -> float:
    return float(min(max(n, 0), period))


def ema(period: int, column: str = "close") -> Affine:
    return Affine(recurrence.ema(period, column), (1,), lambda rn, row, n: [_seen(rn, period), 0.0])


def macd(fast: int = 12, slow: int = 26, column: str = "close") -> Affine:
    return Affine(recurrence.macd(fast, slow, column), (1, 3), lambda rn, row, n: [_seen(rn, fast), 0.0, _seen(rn, slow), 0.0])


def macd_hist(fast: int = 12, slow: int = 26, signal: int = 9, normalize: bool = False) -> Affine:
    """The signal line sees its first value at row ``slow`` - 1."""
    known = lambda rn, row, n: [_seen(rn, fast), 0.0, _seen(rn, slow), 0.0, _seen(rn - slow + 1, signal), 0.0]
    return Affine(recurrence.macd_hist(fast, slow, signal, normalize), (1, 3, 5), known)


def directional_index(period: int = 14) -> Affine:
    """DX of every row, null where it is skipped; three Wilder means are carried."""

    def run(g: dict[str, np.ndarray], s: State) -> tuple[np.ndarray, State]:
        h, low, c = g["high"], g["low"], g["close"]
        ph, pl, pc = before(h, s[0]), before(low, s[1]), before(c, s[2])
        up, down, first = h - ph, pl - low, np.isnan(pc)
        moves = (
            np.maximum(h - low, np.maximum(np.abs(h - pc), np.abs(low - pc))),
            np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0),
        )
        state, smooth = [float(h[-1]), float(low[-1]), float(c[-1])], []
        for i, x in enumerate(moves):
            y, own = advance(np.where(first, np.nan, x), period, 1.0 / period, s[3 + 2 * i : 5 + 2 * i])
            smooth.append(y)
            state += own
        plus, minus = ratio(smooth[1], smooth[0]), ratio(smooth[2], smooth[0])
        return 100 * ratio(np.abs(plus - minus), plus + minus), state

    def known(rn: int, row: dict[str, float] | None, n: int) -> State:
        own = [row[c] for c in ("high", "low", "close")] if row else [NAN] * 3
        return [*own, *[_seen(rn - 1, period), 0.0] * 3]

    return Affine(Scan(("high", "low", "close"), (NAN, NAN, NAN, *recurrence.FRESH * 3), run), (4, 6, 8), known, halo=1)


def smoothed(period: int, column: str) -> Affine:
    """Wilder's average of a column's values; rows without one are passed over."""
    return Affine(Scan((column,), recurrence.FRESH, lambda g, s: advance(g[column], period, 1.0 / period, s)), (1,), lambda rn, row, n: [_seen(n, period), 0.0], counted=column)


def chunked(candles: DataFrame, size: int, rows_before: int = 0, unit: str = "month") -> DataFrame:
    """Numbered rows (``rn``) by ``chunk``; ``core`` tells a chunk's own rows from copies of those before it."""
    rows = candles if "rn" in candles.columns else number_rows(candles, unit)
    if rows_before:
        return halo(rows, size, rows_before, 0)
    return rows.withColumns({"chunk": F.floor(F.col("rn") / size), "core": F.lit(True)})


def _by_chunk(rows: DataFrame, heads: DataFrame | None, columns: list[str], make: Callable, schema: StructType) -> DataFrame:
    """``make(chunk's rows, their columns as arrays, head)`` of every chunk; a head is an array of doubles or None."""
    carried = rows.columns
    kind = ArrayType(DoubleType())
    # columns that are doubles or whole numbers already are not carried twice
    apart = {c: f"_x{i}" for i, c in enumerate(columns) if rows.schema[c].dataType.simpleString() not in ("double", "float", "bigint", "int")}
    body = rows.select(*carried, F.lit(1).alias("_kind"), F.lit(None).cast(kind).alias("_head"), *[F.col(c).cast("double").alias(x) for c, x in apart.items()])
    if heads is not None:
        void = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name not in _CHUNK]
        body = body.unionByName(heads.select(*_CHUNK, *void, F.lit(0).alias("_kind"), F.col("head").alias("_head"), *[F.lit(None).cast("double").alias(x) for x in apart.values()]))
    dealt = body.repartition(*_CHUNK).sortWithinPartitions(*_CHUNK, "_kind", "rn")
    k = len(carried)
    names = [carried.index(c) for c in _CHUNK]
    places = {c: k + 2 + list(apart).index(c) if c in apart else carried.index(c) for c in columns}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def done() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            head = t.column(k + 1)[0].as_py() if t.column(k)[0].as_py() == 0 else None
            t = t.slice(1) if t.column(k)[0].as_py() == 0 else t
            if len(t):
                xs = {c: t.column(places[c]).to_numpy().astype(float) for c in columns}
                yield make(t.select(list(range(k))), xs, head)

        for batch in batches:
            keys = [batch.column(i) for i in names]
            changes = np.zeros(max(0, len(batch) - 1), bool)
            for c in keys:
                one = c.dictionary_encode().indices.to_numpy() if pa.types.is_string(c.type) else c.to_numpy()
                changes |= one[1:] != one[:-1]
            edges = [0, *(1 + np.flatnonzero(changes)).tolist(), len(batch)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if lo == hi:
                    continue
                key = tuple(c[lo].as_py() for c in keys)
                if held and key != now:
                    yield from done()
                    held = []
                now = key
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from done()

    return dealt.mapInArrow(run, schema)


def _fields(rows: DataFrame, *names: str) -> list[StructField]:
    return [rows.schema[n] for n in names]


def scan(candles: DataFrame, name: str, spec: Affine, size: int = SIZE, unit: str = "month", paths: list[str] | None = None) -> DataFrame:
    """Candles (numbered, with ``rn``) with the scan's values as a column ``name``; NaN becomes null.

    The path of the table of chunks, which the result reads, is added to ``paths``.
    """
    # numbered once: both passes read it
    rows = written(chunked(candles.drop(name) if name != spec.counted else candles, size, spec.halo, unit), "chunks", paths)
    columns = list(dict.fromkeys(["rn", *spec.scan.columns]))
    width = len(spec.carried)
    counts = None
    if spec.counted:
        # values before each chunk: a running sum over the chunk table
        each = rows.where("core").groupBy(*_CHUNK).agg(F.count(spec.counted).alias("n"))
        so_far = F.coalesce(F.sum("n").over(Window.partitionBy(*KEYS).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counts = each.select(*_CHUNK, F.array(so_far.cast("double")).alias("head"))
    mapped = StructType([*_fields(rows, *_CHUNK), StructField("head", ArrayType(DoubleType())), StructField("map", ArrayType(DoubleType()))])

    def opened(t: pa.Table, xs: dict[str, np.ndarray]) -> tuple[int, int, dict[str, float] | None, dict[str, np.ndarray]]:
        core = t.column("core").to_numpy()
        skip = int((~core).sum())
        row = {c: float(xs[c][skip - 1]) for c in spec.scan.columns} if skip else None
        return skip, int(xs["rn"][skip]) if skip < len(core) else -1, row, {c: xs[c][skip:] for c in spec.scan.columns}

    def to_map(t: pa.Table, xs: dict[str, np.ndarray], head: list[float] | None) -> pa.RecordBatch:
        _, rn, row, own = opened(t, xs)
        key = [t.column(c)[:1].combine_chunks() for c in _CHUNK]
        if rn < 0:
            return pa.RecordBatch.from_arrays([*(c[:0] for c in key), pa.array([], pa.list_(pa.float64())), pa.array([], pa.list_(pa.float64()))], names=mapped.names)
        n = int(head[0]) if head else 0
        base = spec.end(own, spec.begin(rn, row, n, np.zeros(width)))
        # the linear part from rows of zeros, so that it does not drown in the sums of the rows
        still, none = {c: np.where(np.isnan(x), NAN, 0.0) for c, x in own.items()}, row and dict.fromkeys(row, 0.0)
        flat = np.concatenate([base, *(spec.end(still, spec.begin(rn, none, n, one)) for one in np.eye(width))])
        return pa.RecordBatch.from_arrays([*key, pa.array([head or [0.0]], pa.list_(pa.float64())), pa.array([flat.tolist()], pa.list_(pa.float64()))], names=mapped.names)

    # maps need the scan's own columns only
    maps = _by_chunk(rows.select(list(dict.fromkeys([*_CHUNK, "rn", "core", *columns]))), counts, columns, to_map, mapped)
    begun = StructType([*_fields(rows, *_CHUNK), StructField("head", ArrayType(DoubleType()))])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, np.zeros(width)
        for batch in batches:
            heads = []
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(len(KEYS))), strict=True))
            for key, n, m in zip(keys, batch.column(len(KEYS) + 1).to_pylist(), batch.column(len(KEYS) + 2).to_pylist(), strict=True):
                if key != now:
                    now, state = key, np.zeros(width)
                heads.append([*n, *state.tolist()])
                flat = np.array(m).reshape(width + 1, width)
                state = flat[0] + state @ flat[1:]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(_CHUNK))), pa.array(heads, pa.list_(pa.float64()))], names=begun.names)

    heads = maps.repartition(*KEYS).sortWithinPartitions(*_CHUNK).mapInArrow(fold, begun)
    kept = [c for c in rows.columns if c not in ("chunk", "core")]
    schema = StructType([*_fields(rows, *kept), StructField(name, DoubleType())])

    def to_values(t: pa.Table, xs: dict[str, np.ndarray], head: list[float]) -> pa.RecordBatch:
        skip, rn, row, own = opened(t, xs)
        values = spec.scan.run(own, spec.begin(rn, row, int(head[0]), np.array(head[1:])))[0] if rn >= 0 else np.zeros(0)
        made = pa.array(values, pa.float64(), mask=np.isnan(values))
        t = t.slice(skip).select(kept).combine_chunks()
        return pa.RecordBatch.from_arrays([*(c.chunk(0) if c.num_chunks else c.combine_chunks() for c in t.columns), made], names=schema.names)

    return _by_chunk(rows, heads, columns, to_values, schema)


def adx(candles: DataFrame, name: str, period: int = 14, normalize: bool = False, size: int = SIZE, unit: str = "month") -> DataFrame:
    """The average directional index: DX by chunks, then its average over the rows that have one."""
    spent: list[str] = []
    dx = scan(candles, "_dx", directional_index(period), size, unit, spent)
    out = scan(dx, name, smoothed(period, "_dx"), size, unit).drop("_dx")
    for path in spent:
        # the second table of chunks has all that is in the first
        remove(candles.sparkSession, path)
    # where DX is skipped there is no value either: the average is null there already
    return out.withColumn(name, F.col(name) / 100) if normalize else out


def prefix_sum(candles: DataFrame, sums: dict[str, Column], size: int = SIZE, unit: str = "month") -> DataFrame:
    """Numbered candles with the running sum of each expression over the series, by chunks."""
    rows = chunked(candles, size, 0, unit).drop("core").withColumns({f"_v{i}": c for i, c in enumerate(sums.values())})
    total = rows.groupBy(*_CHUNK).agg(*[F.sum(f"_v{i}").alias(f"_s{i}") for i in range(len(sums))])
    earlier = Window.partitionBy(*KEYS).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = total.select(*_CHUNK, *[F.coalesce(F.sum(f"_s{i}").over(earlier), F.lit(0.0)).alias(f"_o{i}") for i in range(len(sums))])
    local = Window.partitionBy(*_CHUNK).orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(offsets, _CHUNK).withColumns({n: F.col(f"_o{i}") + F.coalesce(F.sum(f"_v{i}").over(local), F.lit(0.0)) for i, n in enumerate(sums)})
    return out.drop("chunk", *[f"_{k}{i}" for k in "vo" for i in range(len(sums))])


def vwap(candles: DataFrame, name: str, size: int = SIZE, unit: str = "month") -> DataFrame:
    """The volume-weighted average price of all rows so far."""
    price = (F.col("high") + F.col("low") + F.col("close")) / 3
    out = prefix_sum(candles, {"_paid": price * F.col("volume"), "_held": F.col("volume")}, size, unit)
    return out.withColumn(name, F.try_divide(F.col("_paid"), F.col("_held"))).drop("_paid", "_held")


def obv(candles: DataFrame, name: str, size: int = SIZE, unit: str = "month") -> DataFrame:
    """On-balance volume: volumes so far, signed by the change of the close; null on the first row."""
    rows = halo(candles if "rn" in candles.columns else number_rows(candles, unit), size, 1, 0)
    change = F.col("close") - F.lag("close").over(Window.partitionBy(*_CHUNK).orderBy("rn"))
    signed = F.when(change > 0, F.col("volume")).when(change < 0, -F.col("volume")).otherwise(0.0)
    moved = rows.withColumn("_signed", signed).where("core").drop("chunk", "core")
    out = prefix_sum(moved, {name: F.col("_signed")}, size, unit).drop("_signed")
    return out.withColumn(name, F.when(F.col("rn") > 0, F.col(name)))


def first_reached(x: np.ndarray, least: np.ndarray, most: int) -> np.ndarray:
    """How many rows after each row ``x`` first is ``least`` or more; ``most`` + 1 if not within ``most`` rows.

    Running maxima over 1, 2, 4, ... rows; a row leaps over the longest stretch that stays below, then over
    shorter ones, so the work is rows times the logarithm of ``most``, whatever the data.
    """
    n = len(least)
    padded_ = np.concatenate([x, np.full(most + 1, -np.inf)])
    levels = [padded_]
    while 2 ** len(levels) <= most:
        step = 2 ** (len(levels) - 1)
        top = levels[-1]
        levels.append(np.maximum(top[:-step], top[step:]))
    at = np.arange(n) + 1
    left = np.full(n, most)
    for k in range(len(levels) - 1, -1, -1):
        step = 2**k
        # a level is taken twice at most: ``most`` need not be a power of two
        for _ in range(2 if k == len(levels) - 1 else 1):
            leap = (left >= step) & (levels[k][np.minimum(at, len(levels[k]) - 1)] < least)
            at, left = at + leap * step, left - leap * step
    return at - np.arange(n)


def sides(high: np.ndarray, low: np.ndarray, close: np.ndarray, b: Barriers) -> np.ndarray:
    """Label -1, 0, 1 of every row by its first touch, NaN where there is none; prices that are missing touch nothing."""
    n, h = len(close), b.horizon
    some = ~np.isnan(close)
    up = first_reached(np.where(np.isnan(high), -np.inf, high), np.where(some, close * (1 + b.upper / 100), np.inf), h)
    down = first_reached(np.where(np.isnan(low), -np.inf, -low), np.where(some, -(close * (1 - b.lower / 100)), np.inf), h)
    out = np.full(n, np.nan)
    there = np.arange(n) + h < n
    if b.vertical == "neutral":
        out[there] = 0
    else:
        move = ratio(close[h:], close[: n - h]) - 1 if n > h else np.zeros(0)
        out[: max(0, n - h)] = np.where(np.isfinite(move), np.sign(move), np.nan)
    first = np.minimum(up, down)
    tie = {"lower": -1, "upper": 1, "neutral": 0}[b.tie]
    touched = there & (first <= h)
    out[touched] = np.where(up == down, tie, np.where(up < down, 1, -1))[touched]
    return out


def triple_barrier(candles: DataFrame, b: Barriers, size: int = SIZE, unit: str = "month") -> DataFrame:
    """Candles (numbered, with ``rn``) with one-hot labels as ``labels.triple_barrier`` gives them.

    A chunk has ``size`` rows, or the horizon's number if that is more, and sees the horizon's rows after it; its memory
    grows with the logarithm of the horizon beyond that.
    """
    numbered = candles if "rn" in candles.columns else number_rows(candles, unit)
    rows = halo(numbered, max(size, b.horizon), 0, b.horizon)
    kept = [c for c in rows.columns if c not in ("chunk", "core", *LABELS)]
    schema = StructType([*_fields(rows, *kept), *(StructField(n, IntegerType()) for n in LABELS)])

    def label(t: pa.Table, xs: dict[str, np.ndarray], head: list[float] | None) -> pa.RecordBatch:
        own = int(t.column("core").to_numpy().sum())
        side = sides(xs["high"], xs["low"], xs["close"], b)[:own]
        none = np.isnan(side)
        made = [pa.array((side == v).astype(np.int32), pa.int32(), mask=none) for v in (-1, 0, 1)]
        t = t.slice(0, own).select(kept).combine_chunks()
        return pa.RecordBatch.from_arrays([*(c.chunk(0) if c.num_chunks else c.combine_chunks() for c in t.columns), *made], names=schema.names)

    return _by_chunk(rows, None, ["high", "low", "close"], label, schema)
