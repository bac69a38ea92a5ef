"""Stateful steps pass many series at once: few states, timers and calls, whatever the number of series."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from candlemill.operators import indicators, recurrence
from candlemill.streaming import live
from tests.test_streaming import CANDLES, SCHEMA, near, rocksdb

SERIES = 400


def drained(stream, tmp_path):
    q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination()
    return q.recentProgress, stream.sparkSession.read.parquet(str(tmp_path / "out"))


def test_many_series_pass_as_one_does():
    rng = np.random.default_rng(3)
    scans = live.popular() | {"z": live.cursors.log_volume_zscore(5), "running": recurrence.Scan(("close",), (0.0,), lambda g, s: (s[0] + np.cumsum(g["close"]), [s[0] + float(g["close"].sum())]))}
    lengths = np.array([0, 1, 2, 300, *rng.integers(0, 60, 40)])
    states = np.tile([x for s in scans.values() for x in s.start], (len(lengths), 1))
    single = [s.tolist() for s in states]
    for _ in range(3):
        n = int(lengths.sum())
        close = 100 + rng.normal(size=n).cumsum()
        close[rng.integers(0, n, 5)] = np.nan
        g = {"close": close, "high": close + 1, "low": close - rng.random(n), "volume": rng.integers(0, 9, n).astype(float)}
        values, states = recurrence.advanced_many(scans, g, lengths, states)
        for i, (end, k) in enumerate(zip(np.cumsum(lengths), lengths, strict=True)):
            if k:
                want, single[i] = live.advanced(scans, {c: x[end - k : end] for c, x in g.items()}, single[i])
                for name in scans:
                    assert np.allclose(want[name], values[name][end - k : end], rtol=1e-9, atol=1e-9, equal_nan=True), (i, name)
        lengths = rng.permutation(lengths)


def test_candles_of_many_symbols_close_by_few_timers(spark, tmp_path):
    rocksdb(spark)
    t0 = dt.datetime(2026, 5, 15, 9, 15)
    tick = lambda i, m, n: (i, f"S{i}", t0 + dt.timedelta(minutes=m, seconds=n), 10 * m + n, 100.0 + (i + m * n) % 7, None, 1.0)
    for part in ([tick(i, m, n) for i in range(SERIES) for m in range(4) for n in (1, 5)], [tick(0, 60, 0)]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    progress, out = drained(live.live_chain(s, "minute", "1 minute", {"ema_2": recurrence.ema(2)}), tmp_path)
    operators = [o for p in progress for o in p["stateOperators"]]
    assert max(int(o["customMetrics"].get("numRegisteredTimers", 0)) for o in operators) <= 2 * live.SHARDS
    assert max(int(o["numRowsTotal"]) for o in operators) <= live.SHARDS
    assert out.where("closed").count() == 4 * SERIES and out.where("closed").select("symbol", "ts").distinct().count() == 4 * SERIES
    assert out.where("closed and (ticks <> 2 or open <> 100 + (cast(substring(symbol, 2) as int) + minute(ts) - 15) % 7)").count() == 0


def test_indicators_of_many_series_keep_few_states(spark, tmp_path):
    rocksdb(spark)
    t0 = dt.datetime(2026, 5, 15, 9, 15)
    rows = [(f"S{i}", "minute", t0 + dt.timedelta(minutes=m), 100.0, 103.0 + (i + m) % 5, 97.0 - i * m % 3, 100.0 + (i * m) % 11, 10.0 + m) for m in range(12) for i in range(SERIES)]
    half = 6 * SERIES
    for part in (rows[:half], rows[half - 5 :]):
        spark.createDataFrame(part, CANDLES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    scans = {"ema_3": recurrence.ema(3), "adx_2": recurrence.adx(2), "obv": live.cursors.obv()}
    s = spark.readStream.schema(CANDLES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    progress, out = drained(live.stream_indicators(s, scans), tmp_path)
    assert max(int(o["numRowsTotal"]) for p in progress for o in p["stateOperators"]) <= live.SHARDS
    got = {(r.symbol, r.ts): r for r in out.collect()}
    want = indicators.add_indicators(spark.createDataFrame(rows, CANDLES), {"obv": indicators.obv()}, {n: s for n, s in scans.items() if n != "obv"}).collect()
    assert out.count() == len(rows) + 5 and len(want) == len(got) == len(rows)
    assert all(near(r[n], got[(r.symbol, r.ts)][n]) for r in want for n in scans)
    assert out.groupBy("symbol", "ts").agg(F.count_distinct("obv").alias("n")).where("n > 1").count() == 0
