"""Streams against the batch forms on closed candles."""

import datetime as dt

from pyspark.sql import functions as F

from candlemill.operators.candles import ticks_to_candles, volume_delta
from candlemill.operators import features, indicators
from candlemill.streaming import live

SCHEMA = "token long, symbol string, event_time timestamp, event_id long, last_price double, volume_traded double, trade_quantity double"


def tick_rows(n=300):
    t0 = dt.datetime(2026, 5, 15, 9, 15)
    return [(i % 3, f"S{i % 3}", t0 + dt.timedelta(seconds=20 * i), i, 100 + (i * 7) % 13 + 0.5, float((i * 11) % 90), 1.0 + i % 4) for i in range(n)]


def feed(spark, tmp_path, rows, schema, cuts=3):
    step = -(-len(rows) // cuts)
    for k in range(cuts):
        spark.createDataFrame(rows[k * step : (k + 1) * step], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def drain(stream, name, tmp_path, mode="append", rocks=True):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")


def test_candles_and_deltas(spark, tmp_path):
    rocksdb(spark)
    rows = tick_rows()
    s = feed(spark, tmp_path, rows, SCHEMA, 1)
    got = drain(live.stream_volume_delta(s), "deltas", tmp_path).collect()
    batch = volume_delta(spark.createDataFrame(rows, SCHEMA), "token", ["event_time", "event_id"])
    assert {r.event_id: r.volume_delta for r in got} == {r.event_id: r.volume_delta for r in batch.collect()}
    s = feed(spark, tmp_path / "c", [(*r, 1.0) for r in rows], SCHEMA + ", volume_delta double", 1)
    got = drain(live.stream_candles(s, "15minute", "1 minute"), "candles", tmp_path).collect()
    want = ticks_to_candles(spark.createDataFrame(rows, SCHEMA).withColumns({"volume_delta": F.lit(1.0), "event_time": F.col("event_time").cast("timestamp_ntz")}), "15minute", order=["event_time", "event_id"])
    want = {(r.symbol, r.ts): (r.open, r.high, r.low, r.close, r.volume) for r in want.collect()}
    assert got and all(want[(r.symbol, r.ts)] == (r.open, r.high, r.low, r.close, r.volume) for r in got)


CANDLES = "symbol string, interval string, ts timestamp, open double, high double, low double, close double, volume double"


def candle_rows(n=90):
    t0 = dt.datetime(2026, 5, 15, 9, 15)
    return [(k, "minute", t0 + dt.timedelta(minutes=i), 100.0 + i % 7, 104.0 + i % 7, 98.0 - i % 3, 100.0 + (i * (5 if k == "A" else 7)) % 11 - i % 2, 1000.0 + i * i % 97) for k in "AB" for i in range(n)]


def near(a, b):
    return (a is None) == (b is None) and (a is None or abs(a - b) < 1e-6)


def test_live_indicators_equal_batch(spark, tmp_path):
    """Micro-batches carry their state; a candle that comes again is evaluated again; an older one is ignored."""
    rocksdb(spark)
    rows = sorted(candle_rows(), key=lambda r: r[2])
    again = (*rows[119][:6], rows[119][6] + 3, rows[119][7])
    fed = [*rows[:60], *rows[60:118], (*rows[119][:6], 1.0, 1.0), rows[118], again, rows[3], *rows[120:]]
    got = drain(live.stream_indicators(feed(spark, tmp_path, fed, CANDLES, 1)), "inds", tmp_path).collect()
    windows, scans = indicators.popular()
    final = [*rows[:119], again, *rows[120:]]
    batch = indicators.add_indicators(spark.createDataFrame(final, CANDLES), windows, scans).collect()
    last = {(r.symbol, r.ts): r for r in got}
    assert len(last) == len(final)
    for r in batch:
        for n in (*windows, *scans):
            assert near(r[n], last[(r.symbol, r.ts)][n]), (r.symbol, r.ts, n)


def test_live_indicators_over_micro_batches(spark, tmp_path):
    """Series = prefix: state carried over batches gives what one pass gives."""
    rocksdb(spark)
    rows = sorted(candle_rows(40), key=lambda r: r[2])
    f = features.Features(["candle_color", "wick_ratios", "log_volume_zscore", "indicators"], rsi_periods=[3], stochastic_periods=[4], stochastic_rsi_periods=[3], period=5, macd=(3, 6))
    got = []
    for cut in (rows[:30], rows[30:]):
        spark.createDataFrame(cut, CANDLES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        s = spark.readStream.schema(CANDLES).parquet(str(tmp_path / "in"))
        live.stream_features(s, f).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    got = {(r.symbol, r.ts): r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = features.encode_features(spark.createDataFrame(rows, CANDLES), f, fill=False).collect()
    assert len(got) == len(want) == len(rows)
    for r in want:
        for n in f.columns():
            assert near(r[n], got[(r.symbol, r.ts)][n]), (r.symbol, r.ts, n)
    assert got[("A", rows[0][2])].log_volume_zscore is None


def test_late_ticks_are_dropped(spark, tmp_path):
    rocksdb(spark)
    rows = [(*r, 1.0) for r in tick_rows(200)]
    schema = SCHEMA + ", volume_delta double"
    for part in (rows[100:], rows[:60]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        s = live.stream_candles(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "5minute", "1 minute")
        s.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert got and min(r.ts for r in got) >= rows[100][2] - dt.timedelta(minutes=5)


def test_upsert_sink(spark, tmp_path):
    """Batches touch their series only; later loads win; two merged batches are kept aside."""
    schema = "symbol string, interval string, ts timestamp_ntz, open double, high double, low double, close double, volume double, load_seq long"
    row = lambda s, i, close, seq: (s, "minute", dt.datetime(2026, 5, 15, 9, 15 + i), 1.0, 2.0, 0.5, close, 1.0, seq)
    batches = [[row("1", i, float(i), 0) for i in range(6)] + [row("B/&", 0, 5.0, 0)], [row("1", 0, 98.0, 1), row("1", 0, 99.0, 2)], [row("1", 7, 7.0, 3)], [row("C", 0, 1.0, 4)]]
    seen = []
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        live.stream_upsert(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "table"), str(tmp_path / "cp")).awaitTermination()
        seen.append({p.name for p in (tmp_path / "table").rglob("*.parquet") if "_merged" not in str(p) and "B" in str(p.parent)})
    got = {(r.symbol, r.ts.minute): r.close for r in spark.read.schema(schema).parquet(str(tmp_path / "table")).collect()}
    assert got == {**{("1", 15 + i): float(i) for i in range(6)}, ("1", 15): 99.0, ("1", 22): 7.0, ("B/&", 15): 5.0, ("C", 15): 1.0}
    assert seen[0] == seen[-1] and len(list((tmp_path / "table" / "_merged").iterdir())) == 2


def test_chain_over_micro_batches(spark, tmp_path):
    """Ticks to indicators in one query of six micro-batches: closed candles are the batch form's, forming ones those
    of the ticks so far; late ticks and unusable ones are counted and dropped; candles leave the state when they close."""
    rocksdb(spark)
    rows = tick_rows(700)
    far = (9, "S9", rows[-1][2] + dt.timedelta(days=2), 10_000, 1.0, None, 1.0)
    cuts = [rows[:150], rows[150:310], [*rows[310:400], (0, "S0", None, 9_000, 5.0, None, 1.0)], rows[400:600], [*rows[600:], (1, "S1", rows[5][2], 9_001, 5.0, None, 1.0)], [far]]
    for part in cuts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    scans = {n: live.popular()[n] for n in ("ma_20", "ema_9", "adx_14", "stochrsi_14_14", "obv")}
    q = live.live_chain(s, "minute", "1 minute", scans).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    deltas = volume_delta(spark.createDataFrame(rows, SCHEMA), "token", ["event_time", "event_id"]).withColumn("event_time", F.col("event_time").cast("timestamp_ntz"))
    order = ["event_time", "event_id"]
    batch = ticks_to_candles(deltas, "minute", order=order)
    windows, recurrences = indicators.popular()
    want = indicators.add_indicators(batch, {n: w for n, w in windows.items() if n in scans}, {n: w for n, w in recurrences.items() if n in scans})
    want = {(r.symbol, r.ts): r for r in want.collect()}
    closed = out.where("closed").collect()
    assert {(r.symbol, r.ts) for r in closed} == set(want) and len(closed) == len(want)
    for r in closed:
        w = want[(r.symbol, r.ts)]
        assert (r.open, r.high, r.low, r.close, r.volume) == (w.open, w.high, w.low, w.close, w.volume)
        assert all(near(w[n], r[n]) for n in scans), (r, w)
    forming = {(r.symbol, r.ts, r.ticks): (r.open, r.high, r.low, r.close, r.volume, r.ma_20) for r in out.where("not closed and symbol <> 'S9'").collect()}
    seen = 0
    for n in (150, 310, 400, 600, 700):
        part = deltas.where(F.col("event_id") < n)
        newest = ticks_to_candles(part, "minute", order=order).join(part.groupBy("symbol").agg(F.max("event_time").alias("m")), "symbol").where("ts > m - interval 1 minute").collect()
        ma = {(r.symbol, r.ts): r.ma for r in indicators.sma(20)(ticks_to_candles(part, "minute", order=order), "ma").collect()}
        for r in newest:
            same = [v for k, v in forming.items() if k[:2] == (r.symbol, r.ts) and v[:5] == (r.open, r.high, r.low, r.close, r.volume)]
            assert same and any(near(ma[(r.symbol, r.ts)], v[5]) for v in same), r
            seen += 1
    assert seen >= 15
    progress = q.recentProgress
    assert len(progress) >= 6 and live.late_ticks(q) == 1
    assert sum(p["observedMetrics"]["ticks"]["unusable"] for p in progress if p["observedMetrics"]) == 1
    # one open candle is left: that of the last tick
    assert progress[-1]["stateOperators"][1]["numRowsTotal"] == 1


def test_idle_series_lose_their_state(spark, tmp_path):
    """A series without candles for a while starts anew. (Processing time never ends by itself: the query is stopped.)"""
    rocksdb(spark)
    schema = CANDLES.replace("ts timestamp", "ts timestamp_ntz") + ", ticks long, closed boolean, end long"
    rows = [(*r, 1, True, 60_000 * (i + 1)) for i, r in enumerate(r for r in candle_rows(30) if r[0] == "A")]
    put = lambda part: spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put(rows[:20])
    s = live.live_indicators(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), {"ema_9": live.popular()["ema_9"]}, idle=1000)
    q = s.writeStream.format("memory").queryName("idle").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(processingTime="1 second").start()
    try:
        for part, n in ((None, 20), (rows[20:], 30)):
            if part:
                q.awaitTermination(4)
                put(part)
            for _ in range(40):
                if spark.table("idle").count() == n:
                    break
                q.awaitTermination(1)
        got = {r.end: r.ema_9 for r in spark.table("idle").collect()}
    finally:
        q.stop()
    assert len(got) == 30 and got[60_000 * 20] is not None and got[60_000 * 21] is None and got[60_000 * 30] is not None
