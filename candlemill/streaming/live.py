"""Live candles, volume deltas, indicators and features with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import DoubleType, StructField, StructType

from candlemill.functions import geometry
from candlemill.functions.scaling import clip_atr, clip_macd, clip_zscore, scale_oscillator
from candlemill.functions.time import MINUTES, OPEN_MINUTE
from candlemill.operators import recurrence
from candlemill.operators.features import Features
from candlemill.operators.recurrence import Scan
from candlemill.operators.series import KEYS
from candlemill.sources.store import exists, folders, placed, remove, replace_partitions, upsert_candles
from candlemill.streaming import cursors
from candlemill.streaming.cursors import popular

#: Groups that keys are dealt into for stateful steps; it must not change while a checkpoint is in use.
SHARDS = 256
#: Series a micro-batch may touch for its keys to be broadcast.
TOUCHED = 100_000
#: Symbols, or years, of a micro-batch that are named in a filter on partitions.
NAMED = 1000


def stream_candles(ticks: DataFrame, interval: str, lateness: str = "10 minutes", price: str = "last_price", volume: str = "volume_delta", time: str = "event_time", tie: str = "event_id") -> DataFrame:
    """Tumbling candles of ticks whose ``time`` is market wall clock as a timestamp.

    Append mode gives closed candles, update mode the forming one. Late ticks are dropped by
    the watermark; a tick of a newer bucket opens its own candle.
    """
    minutes = MINUTES[interval]
    if minutes >= 1440:
        raise ValueError("live candles are intraday")
    at = F.window(time, f"{minutes} minutes", f"{minutes} minutes", f"{OPEN_MINUTE % minutes} minutes")
    order = F.struct(time, tie)
    out = ticks.withWatermark(time, lateness).groupBy("symbol", at).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.sum(volume).alias("volume")
    )
    return out.select("symbol", F.lit(interval).alias("interval"), F.col("window.start").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume")


def sharded(rows: DataFrame, *keys: str) -> GroupedData:
    """Rows grouped by shards of their keys: a stateful call costs much more than a key's few rows, so it gets many keys."""
    return rows.withColumn("_shard", F.pmod(F.xxhash64(*keys), F.lit(SHARDS)).cast("int")).groupBy("_shard")


class Known:
    """Places of keys (tuples) in a shard's state, in the order in which they came."""

    def __init__(self, *columns: list) -> None:
        self.keys = list(zip(*columns, strict=True))
        self.place = {k: i for i, k in enumerate(self.keys)}

    def places(self, *columns: pd.Series) -> np.ndarray:
        """The place of each row's key; new keys get the next places."""
        code = np.zeros(len(columns[0]), np.int64)
        for c in columns:
            own, names = pd.factorize(c, use_na_sentinel=False)
            code = code * (len(names) + 1) + own
        _, first, back = np.unique(code, return_index=True, return_inverse=True)
        at = []
        for key in zip(*(c.iloc[first].tolist() for c in columns), strict=True):
            if key not in self.place:
                self.place[key] = len(self.keys)
                self.keys.append(key)
            at.append(self.place[key])
        return np.array(at, np.int64)[back]

    def columns(self, n: int) -> list[list]:
        return [[k[i] for k in self.keys] for i in range(n)]


def numbers(held: bytes | None, kind: type, *shape: int) -> np.ndarray:
    """An array of a state's bytes."""
    return np.frombuffer(bytes(held or b""), kind).reshape(*shape).copy()


def grown(x: np.ndarray, n: int, fill: Any) -> np.ndarray:
    """The array with ``n`` rows, new ones filled."""
    return np.concatenate([x, np.full((n - len(x), *x.shape[1:]), fill, x.dtype)])


class _Deltas(StatefulProcessor):
    """Last cumulative volume of the tokens of a shard."""

    def __init__(self, token: str, kind: str, columns: list[str]) -> None:
        self.token, self.kind, self.columns = token, kind, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", f"tokens array<{self.kind}>, volumes binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        tokens, held = self.last.get() if self.last.exists() else ([], b"")
        known, held = Known(tokens), numbers(held, float, -1)
        part = pd.concat(list(rows))
        part = part.assign(_at=known.places(part[self.token])).sort_values(["_at", "event_time", "event_id"], kind="stable").reset_index(drop=True)
        held = grown(held, len(known.keys), np.nan)
        at, now = part["_at"].to_numpy(), part["volume_traded"].astype(float)
        newest = now.groupby(at).ffill()
        before = newest.groupby(at).shift(1).to_numpy()
        before = np.where(np.isnan(before), held[at], before)
        part["volume_delta"] = np.where(now.to_numpy() >= before, now.to_numpy() - before, part["trade_quantity"].to_numpy(float))
        last = newest.groupby(at).last()
        held[last.index] = np.where(last.isna(), held[last.index], last)
        some = np.flatnonzero(~np.isnan(held))
        if len(some):
            self.last.update(([known.keys[i][0] for i in some], held[some].tobytes()))
        yield part[[*self.columns, "volume_delta"]]

    def close(self) -> None:
        pass


def stream_volume_delta(ticks: DataFrame, token: str = "token", time: str | None = None) -> DataFrame:
    """Ticks with ``volume_delta``; ticks are put in order within a micro-batch.

    ``time`` names the column that has the watermark, if there is one: it passes through to the next stateful
    operator, and ticks that come too late are dropped here.
    """
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in ticks.schema), "volume_delta double"])
    mode = ("eventTime", None, time) if time else ("none",)
    return sharded(ticks, token).transformWithStateInPandas(_Deltas(token, ticks.schema[token].dataType.simpleString(), ticks.columns), schema, "append", *mode)


_CANDLE = ["open", "opened", "open_tie", "high", "low", "close", "closed_at", "close_tie", "volume", "ticks"]
_LONGS = ["opened", "open_tie", "closed_at", "close_tie", "ticks"]
_DOUBLES = [c for c in _CANDLE if c not in _LONGS]


class _Forming(StatefulProcessor):
    """Open candles of a shard's symbols by the time they end (milliseconds); an event-time timer closes the first ones, and sets the next.

    A shard without open candles has no state.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.candles = handle.getValueState("candles", "symbols array<string>, ends binary, longs binary, doubles binary")

    def held(self) -> pd.DataFrame:
        symbols, ends, longs, doubles = self.candles.get() if self.candles.exists() else ([], b"", b"", b"")
        columns = dict(zip(_LONGS, numbers(longs, np.int64, len(_LONGS), -1), strict=True)) | dict(zip(_DOUBLES, numbers(doubles, float, len(_DOUBLES), -1), strict=True))
        return pd.DataFrame({"symbol": np.array(symbols, object), "end": numbers(ends, np.int64, -1)} | {c: columns[c] for c in _CANDLE})

    def keep(self, candles: pd.DataFrame) -> None:
        if not len(candles):
            self.candles.clear()
            return
        as_bytes = lambda columns, kind: np.stack([candles[c].to_numpy(kind) for c in columns]).tobytes()
        self.candles.update((candles["symbol"].tolist(), as_bytes(["end"], np.int64), as_bytes(_LONGS, np.int64), as_bytes(_DOUBLES, float)))
        self.handle.registerTimer(int(candles["end"].min()))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(rows)).sort_values(["symbol", "end", "at", "tie"], kind="stable")
        by = part.groupby(["symbol", "end"], sort=False, dropna=False)
        price, first, newest = by["price"], by.first(), by.last()
        made = pd.DataFrame({
            "open": first["price"], "opened": first["at"], "open_tie": first["tie"], "high": price.max(), "low": price.min(),
            "close": newest["price"], "closed_at": newest["at"], "close_tie": newest["tie"], "volume": by["quantity"].sum(), "ticks": by.size(),
        }).reset_index()
        every = merged(self.held(), made)
        self.keep(every)
        yield self.out(every[every["fresh"]], False)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        until = max(int(expiredTimerInfo.getExpiryTimeInMs()), int(timerValues.getCurrentWatermarkInMs()))
        held = self.held()
        ended = held["end"] <= until
        if ended.any():
            self.keep(held[~ended])
            yield self.out(held[ended], True)

    def out(self, candles: pd.DataFrame, closed: bool) -> pd.DataFrame:
        return candles[["symbol", "end", "open", "high", "low", "close", "volume", "ticks"]].assign(closed=closed)

    def close(self) -> None:
        pass


def merged(held: pd.DataFrame, made: pd.DataFrame) -> pd.DataFrame:
    """Candles of two parts of their ticks, by event time and tie; ``fresh``: those that have ticks in the second part."""
    names = ["symbol", "end"]
    if not len(held):
        return made.assign(fresh=True)
    both = pd.concat([held.assign(fresh=False), made.assign(fresh=True)], ignore_index=True)
    both = both.assign(_at=both.groupby(names, sort=False, dropna=False).ngroup().to_numpy())
    first = both.sort_values(["_at", "opened", "open_tie"], kind="stable").drop_duplicates("_at")
    last = both.iloc[::-1].sort_values(["_at", "closed_at", "close_tie"], kind="stable").drop_duplicates("_at", keep="last")
    by = both.groupby("_at", sort=True)
    out = first.reset_index(drop=True)
    out[["close", "closed_at", "close_tie"]] = last.reset_index(drop=True)[["close", "closed_at", "close_tie"]]
    for c, how in (("high", "max"), ("low", "min"), ("volume", "sum"), ("ticks", "sum"), ("fresh", "any")):
        out[c] = by[c].agg(how).to_numpy()
    return out.drop(columns="_at")


def live_candles(ticks: DataFrame, interval: str, price: str = "last_price", volume: str = "volume_delta", time: str = "event_time", tie: str = "event_id") -> DataFrame:
    """Forming and closed candles: (symbol, interval, ts, open, high, low, close, volume, ticks, closed, end).

    Every micro-batch gives each candle that it touched as it is then (``closed`` false); a candle comes a last
    time, closed, when the watermark of ``time`` passes its end, and leaves the state. ``ticks`` must carry a watermark.
    """
    minutes = MINUTES[interval]
    if minutes >= 1440:
        raise ValueError("live candles are intraday")
    step, shift = minutes * 60_000_000, OPEN_MINUTE % minutes * 60_000_000
    at = F.unix_micros(time)
    end = F.expr(f"(unix_micros({time}) - pmod(unix_micros({time}) - {shift}, {step}) + {step}) div 1000")
    rows = ticks.select("symbol", time, at.alias("at"), F.col(tie).cast("long").alias("tie"), F.col(price).cast("double").alias("price"), F.col(volume).cast("double").alias("quantity"), end.alias("end"))
    schema = "symbol string, end long, open double, high double, low double, close double, volume double, ticks long, closed boolean"
    out = sharded(rows, "symbol").transformWithStateInPandas(_Forming(), schema, "append", "eventTime")
    start = F.timestamp_millis(F.col("end") - minutes * 60_000).cast("timestamp_ntz")
    return out.select("symbol", F.lit(interval).alias("interval"), start.alias("ts"), "open", "high", "low", "close", "volume", "ticks", "closed", "end")


def late_ticks(query: StreamingQuery) -> int:
    """Ticks that a query has dropped because the watermark had passed them (of the progress that is kept)."""
    return sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"])


def split_state(scans: dict[str, Scan], state: list[float]) -> dict[str, list[float]]:
    """The state of each scan, from all of them in a row."""
    out, at = {}, 0
    for n, s in scans.items():
        out[n] = list(state[at : at + len(s.start)])
        at += len(s.start)
    return out


def advanced(scans: dict[str, Scan], columns: dict[str, np.ndarray], state: list[float]) -> tuple[dict[str, np.ndarray], list[float]]:
    """Values of the next rows of a series by scan, and the state after them."""
    values, after = {}, []
    for n, own in split_state(scans, state).items():
        values[n], now = scans[n].run({c: columns[c] for c in scans[n].columns}, own)
        after += [float(x) for x in now]
    return values, after


class _Scans(StatefulProcessor):
    """Scans over the series of a shard."""

    def __init__(self, scans: dict[str, Scan], columns: list[str]) -> None:
        self.scans, self.columns = scans, columns
        self.needed = list(dict.fromkeys(c for s in scans.values() for c in s.columns))
        self.fresh = np.array([x for s in scans.values() for x in s.start], float)

    def started(self, states: np.ndarray, n: int) -> np.ndarray:
        """The states with those of new series."""
        return np.concatenate([states, np.tile(self.fresh, (n - len(states), 1))])

    def passed(self, rows: pd.DataFrame, states: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Values of rows in order of series (``_at``) and time, and the states after them."""
        lengths = np.bincount(rows["_at"].to_numpy(np.int64), minlength=len(states))
        return recurrence.advanced_many(self.scans, {c: rows[c].to_numpy(float) for c in self.needed}, lengths, states)

    def close(self) -> None:
        pass


class _Cursor(_Scans):
    """State of each scan before the newest candle of a series, and that candle.

    A candle of a newer time closes the one before; the newest candle is forming: when it comes again,
    its values are taken anew from the state before it. Older candles are ignored. Closed candles of a
    micro-batch pass the scans together, and so do the series of a shard.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "symbols array<string>, intervals array<string>, times binary, before binary, newest binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        k = len(self.needed)
        symbols, intervals, times, before, newest = self.state.get() if self.state.exists() else ([], [], b"", b"", b"")
        known, old = Known(symbols, intervals), len(symbols)
        part = pd.concat(list(rows))
        part = part.assign(_at=known.places(part["symbol"], part["interval"]), _us=part["ts"].to_numpy("datetime64[us]").astype(np.int64))
        n = len(known.keys)
        times = grown(numbers(times, np.int64, -1), n, -(1 << 62))
        before = self.started(numbers(before, float, old, len(self.fresh)), n)
        newest = grown(numbers(newest, float, old, k), n, np.nan)
        part = part[part["_us"].to_numpy() >= times[part["_at"].to_numpy()]].sort_values(["_at", "_us"], kind="stable").reset_index(drop=True)
        if not len(part):
            return
        # the newest candle so far is closed, unless it comes again
        first = part.drop_duplicates("_at")
        closes = first[(first["_us"].to_numpy() > times[first["_at"].to_numpy()]) & (first["_at"].to_numpy() < old)]["_at"].to_numpy()
        held = pd.DataFrame(newest[closes], columns=self.needed).assign(_at=closes, _us=times[closes], _row=-1)
        both = pd.concat([held, part[[*self.needed, "_at", "_us"]].assign(_row=np.arange(len(part)))], ignore_index=True).sort_values(["_at", "_us", "_row"], kind="stable").reset_index(drop=True)
        at, us = both["_at"].to_numpy(), both["_us"].to_numpy()
        last = np.append(at[1:] != at[:-1], True)
        again = np.append((at[1:] == at[:-1]) & (us[1:] == us[:-1]), False)
        made = {name: np.full(len(part), np.nan) for name in self.scans}

        def evaluate(which: np.ndarray, states: np.ndarray) -> np.ndarray:
            rows = both[which]
            values, after = self.passed(rows, states)
            row = rows["_row"].to_numpy()
            for name, v in values.items():
                made[name][row[row >= 0]] = v[row >= 0]
            return after

        if again.any():
            # candles that come again in one batch: each is evaluated on the state before its time
            for i in np.flatnonzero(again):
                earlier = (at == at[i]) & (us < us[i]) & ~again
                state = advanced(self.scans, {c: both[c].to_numpy(float)[earlier] for c in self.needed}, before[at[i]].tolist())[1] if earlier.any() else before[at[i]].tolist()
                values, _ = advanced(self.scans, {c: both[c].to_numpy(float)[i : i + 1] for c in self.needed}, state)
                for name, v in values.items():
                    made[name][both["_row"][i]] = v[0]
        before = evaluate(~last & ~again, before)
        evaluate(last, before)
        times[at[last]], newest[at[last]] = us[last], both[self.needed].to_numpy(float)[last]
        self.state.update((*known.columns(2), times.tobytes(), before.tobytes(), newest.tobytes()))
        yield part[self.columns].assign(**made)


class _OpenCursor(_Scans):
    """Committed state of each scan after the last closed candle of a series, and its open candles, for the series of a shard.

    Closed candles are committed in time order. Open ones are evaluated one after the other on top of the
    committed state, which they do not change; an open candle that changes changes the open ones after it.
    """

    def __init__(self, scans: dict[str, Scan], columns: list[str], idle: int | None) -> None:
        super().__init__(scans, columns)
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "symbols array<string>, intervals array<string>, last binary, seen binary, committed binary, at binary, ends binary, held binary", self.idle)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        now = int(timerValues.getCurrentProcessingTimeInMs()) if self.idle is not None else 0
        symbols, intervals, last, seen, state, at, ends, held = self.state.get() if self.state.exists() else ([], [], *[b""] * 6)
        known, old = Known(symbols, intervals), len(symbols)
        part = pd.concat(list(rows))
        part = part.assign(_at=known.places(part["symbol"], part["interval"]))
        n = len(known.keys)
        last, seen = grown(numbers(last, np.int64, -1), n, -(1 << 62)), grown(numbers(seen, np.int64, -1), n, now)
        state = self.started(numbers(state, float, old, len(self.fresh)), n)
        open_ = pd.DataFrame(numbers(held, float, -1, max(1, len(self.needed)))[:, : len(self.needed)], columns=self.needed).assign(_at=numbers(at, np.int64, -1), end=numbers(ends, np.int64, -1), _row=-1)
        if self.idle is not None:
            gone = seen + self.idle <= now
            last[gone], state[gone] = -(1 << 62), self.fresh
            open_ = open_[~gone[open_["_at"].to_numpy()]]
        seen[part["_at"].to_numpy()] = now
        part = part.sort_values(["_at", "end", "closed"], kind="stable")
        part = part[part["end"].to_numpy() > last[part["_at"].to_numpy()]].reset_index(drop=True)
        closed = part[part["closed"]].drop_duplicates(["_at", "end"], keep="last")
        if len(closed):
            values, state = self.passed(closed, state)
            newest = closed.drop_duplicates("_at", keep="last")
            last[newest["_at"].to_numpy()] = newest["end"].to_numpy()
            yield closed[self.columns].assign(**values)
        open_ = open_[open_["end"].to_numpy() > last[open_["_at"].to_numpy()]]
        forming = part[~part["closed"].to_numpy(bool) & (part["end"].to_numpy() > last[part["_at"].to_numpy()])].drop_duplicates(["_at", "end"], keep="last").reset_index(drop=True)
        if len(forming):
            both = pd.concat([open_, forming[[*self.needed, "_at", "end"]].assign(_row=np.arange(len(forming)))], ignore_index=True)
            open_ = both.drop_duplicates(["_at", "end"], keep="last").sort_values(["_at", "end"], kind="stable")
            some = open_[np.isin(open_["_at"].to_numpy(), forming["_at"].to_numpy())]
            values, _ = self.passed(some, state)
            fresh = some["_row"].to_numpy() >= 0
            yield forming.iloc[some["_row"].to_numpy()[fresh]][self.columns].assign(**{name: v[fresh] for name, v in values.items()})
        if self.idle is not None:
            # series that have come before and are idle now leave the state
            kept = seen + self.idle > now
            place = np.cumsum(kept) - 1
            known.keys = [key for key, stays in zip(known.keys, kept, strict=True) if stays]
            last, seen, state, open_ = last[kept], seen[kept], state[kept], open_.assign(_at=place[open_["_at"].to_numpy()])
        as_bytes = lambda c, kind: open_[c].to_numpy(kind).tobytes()
        self.state.update((*known.columns(2), last.tobytes(), seen.tobytes(), state.tobytes(), as_bytes("_at", np.int64), as_bytes("end", np.int64), np.ascontiguousarray(open_[self.needed].to_numpy(float)).tobytes()))


def live_indicators(candles: DataFrame, scans: dict[str, Scan] | None = None, idle: int | None = None) -> DataFrame:
    """Forming and closed candles (of ``live_candles``) with the named indicators, null in warm-up.

    A closed candle's values are those of the batch form; a forming candle's are what they would be if it closed
    now. ``idle``: milliseconds after which a series without candles loses its state (never, if not given).
    """
    scans = popular() if scans is None else scans
    schema = StructType([*candles.schema.fields, *(StructField(n, DoubleType()) for n in scans)])
    mode = "none" if idle is None else "processingTime"
    out = sharded(candles, *KEYS).transformWithStateInPandas(_OpenCursor(scans, candles.columns, idle), schema, "append", mode)
    return out.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in scans})


def live_chain(ticks: DataFrame, interval: str, lateness: str = "10 minutes", scans: dict[str, Scan] | None = None, token: str = "token", time: str = "event_time", idle: int | None = None) -> DataFrame:
    """Ticks to volume deltas, to forming and closed candles, to their indicators: one query of three stateful operators.

    The query's progress tells, as observed metrics ``ticks``, how many ticks were read and how many had no time,
    token or price (they are dropped); ``late_ticks`` counts those that came too late.
    """
    bad = F.col(time).isNull() | F.col(token).isNull() | F.col("last_price").isNull()
    seen = ticks.observe("ticks", F.count(F.lit(1)).alias("read"), F.count_if(bad).alias("unusable"))
    deltas = stream_volume_delta(seen.where(~bad).withWatermark(time, lateness), token, time)
    return live_indicators(live_candles(deltas, interval, time=time), scans, idle)


def stream_indicators(candles: DataFrame, scans: dict[str, Scan] | None = None) -> DataFrame:
    """Every candle update with the named indicators (the popular ones, if none are given), null in warm-up.

    ``ts`` must be a timestamp. The state of a series is the few numbers its scans keep.
    """
    scans = popular() if scans is None else scans
    schema = StructType([*candles.schema.fields, *(StructField(n, DoubleType()) for n in scans)])
    out = sharded(candles, *KEYS).transformWithStateInPandas(_Cursor(scans, candles.columns), schema, "append", "none")
    return out.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in scans})


def stream_features(candles: DataFrame, f: Features) -> DataFrame:
    """Keys and the whole configured feature row of every candle update, null in warm-up."""
    wanted = f.columns()
    some = lambda c, value: F.when(F.col(c).isNotNull(), value)
    close = F.col("close")
    fixed = {
        "log_volume_zscore": (cursors.log_volume_zscore(f.zscore_window), lambda c: some(c, clip_zscore(F.col(c)))),
        "atr": (cursors.atr(f.period), lambda c: some(c, clip_atr(F.col(c), close))),
        "macd": (recurrence.macd(*f.macd), lambda c: some(c, clip_macd(F.col(c), close))),
        "adx": (recurrence.adx(f.period, normalize=True), F.col),
    }
    by_period = {"rsi": cursors.rsi, "stochastic": cursors.stochastic, "stochastic_rsi": lambda p: cursors.stochastic_rsi(p, p)}
    scans, ready = {}, {}
    for c in wanted:
        kind, period = f.oscillator(c)
        scan, value = (by_period[kind](period), lambda n: scale_oscillator(F.col(n))) if kind else fixed.get(c, (None, None))
        if scan is not None:
            scans[f"_f_{c}"] = scan
            ready[c] = value(f"_f_{c}")
    out = geometry.with_geometry(stream_indicators(candles, scans) if scans else candles)
    ready |= {c: x for c, x in geometry.one_hot().items() if c in wanted}
    known = set(out.columns)
    return out.select("symbol", "interval", "ts", *[(ready[c] if c in ready else F.col(c) if c in known else F.lit(None).cast("double")).alias(c) for c in wanted])


def stream_upsert(candles: DataFrame, path: str, checkpoint: str, by_year: bool = False, buckets: int | None = None, **trigger: Any) -> StreamingQuery:
    """Start a query that merges candle updates into a Parquet table partitioned by series or by ``buckets`` of series (and year).

    A batch reads and replaces only the series or buckets, or years of them, that it touches; the years and, if they are few, the
    symbols or buckets are filters on partitions. What it will write is written aside first (``_merged/b<number>``, which
    readers of the table do not see), so a batch that runs again after a failure publishes the same
    rows; the two newest of these are kept.
    """
    keys = folders(by_year, buckets)

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        aside, plain = f"{path}/_merged/b{number}", batch.drop("load_seq")
        if not exists(spark, f"{aside}/_SUCCESS"):
            stored = plain.limit(0)
            if exists(spark, f"{path}/interval=*"):
                # the batch's types: partition values would be read as what they look like
                there = spark.read.schema(placed(plain, by_year, buckets).schema).parquet(path)
                touched = placed(batch, by_year, buckets).select(*keys).distinct()
                few = touched.limit(TOUCHED + 1).count() <= TOUCHED
                for column in keys[:0:-1]:
                    names = [r[0] for r in touched.select(column).distinct().limit(NAMED + 1).collect()]
                    there = there.filter(F.col(column).isin(names)) if len(names) <= NAMED else there
                stored = there.join(F.broadcast(touched) if few else touched, keys, "left_semi").select(plain.columns)
            upsert_candles(stored, batch).write.mode("overwrite").parquet(aside)
        replace_partitions(spark.read.schema(plain.schema).parquet(aside), path, by_year, buckets=buckets)
        remove(spark, f"{path}/_merged/b{number - 2}")

    return candles.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).outputMode("append").trigger(**trigger or {"availableNow": True}).start()
