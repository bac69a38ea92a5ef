"""Golden values, partition invariance, and edge cases of the market-data operators."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from candlemill.functions import geometry, ticks, time, units
from candlemill.operators import dataset, evaluate, features, labels, longseries, recurrence, series
from candlemill.operators import indicators as ind
from candlemill.operators.candles import ticks_to_candles, volume_delta
from candlemill.schemas import CANDLE
from candlemill.sources import store

T0 = dt.datetime(2026, 5, 15, 9, 15)


def candles(spark, rows, symbol="A"):
    """(open, high, low, close, volume) tuples as a minute series."""
    return spark.createDataFrame([(symbol, "minute", T0 + dt.timedelta(minutes=i), *map(float, r)) for i, r in enumerate(rows)], CANDLE)


def trend(spark, n=60):
    rows = []
    for i in range(n):
        c = 100 + 0.7 * i + ((i % 5) - 2) * 0.4 - (1.8 if i % 11 == 0 else 0)
        rows.append((c - 0.4, c + 1.2 + (i % 3) * 0.1, c - 1.0 - (i % 4) * 0.1, c, 1000 + 17 * i))
    return candles(spark, rows)


LABEL_ROWS = [(100, 101, 99, 100, 1000), (100, 106, 99, 100, 1100), (100, 101, 94, 100, 1200), (100, 104, 99, 103, 1300), (103, 104, 102, 104, 1400), (104, 104, 103, 104, 1500)]


def column(df, name):
    return [r[name] for r in df.orderBy("symbol", "ts").collect()]


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_triple_barrier_golden(spark, parts):
    c = candles(spark, LABEL_ROWS).repartition(parts).orderBy(F.rand(1))
    out = labels.triple_barrier(c, labels.Barriers(5, 5, 2))
    assert column(out, "label_lower") == [0, 1, 0, 0, None, None]
    assert column(out, "label_neutral") == [0, 0, 0, 0, None, None]
    assert column(out, "label_upper") == [1, 0, 1, 1, None, None]
    out = labels.triple_barrier(c, labels.Barriers(5, 5, 2, vertical="neutral"))
    assert column(out, "label_neutral") == [0, 0, 1, 1, None, None]
    assert column(out, "label_upper") == [1, 0, 0, 0, None, None]
    assert [None if x is None else round(x, 9) for x in column(labels.return_label(c, 2), "label_return")] == [0.0, 0.03, 0.04, round(104 / 103 - 1, 9), None, None]


def test_labelled_dataset(spark):
    f = features.Features(["wick_ratios"])
    out = labels.labelled_dataset(candles(spark, LABEL_ROWS), f, labels.Barriers(5, 5, 2))
    assert [(r.label_lower, r.label_neutral, r.label_upper) for r in out.orderBy("ts").collect()] == [(0, 0, 1), (1, 0, 0), (0, 0, 1), (0, 0, 1)]
    assert {"upper_wick_to_candle_ratio", "lower_wick_to_candle_ratio", "body_to_candle_ratio"} <= set(out.columns)


def test_single_candles(spark):
    g = geometry.with_geometry(candles(spark, [(98, 110, 90, 102, 1), (100, 100, 100, 100, 1), (102, 108, 90, 106, 1), (100, 112, 98, 104, 1)])).orderBy("ts").collect()
    assert [round(g[0][c], 9) for c in features.WICKS] == [-0.1, -0.1, -0.3]
    assert all(g[1][c] is None for c in features.WICKS)
    assert (g[2].candle_color, g[2].candle_type) == ("green", "hammer")
    assert g[3].candle_color == "red"


def brute_ema(x, p, alpha=None):
    a, out = alpha or 2 / (p + 1), [None] * len(x)
    if len(x) >= p:
        e = sum(x[:p]) / p
        out[p - 1] = e
        for i in range(p, len(x)):
            e += (x[i] - e) * a
            out[i] = e
    return out


def close_to(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert (x is None) == (y is None)
        assert x is None or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)


def test_recurrences_against_loops(spark):
    c = trend(spark)
    rows = c.orderBy("ts").collect()
    close = [r.close for r in rows]
    out = recurrence.with_recurrences(c, {"ema": recurrence.ema(9), "macd": recurrence.macd(3, 5), "adx": recurrence.adx(14)})
    close_to(column(out, "ema"), brute_ema(close, 9))
    close_to(column(out, "macd"), [None if b is None else a - b for a, b in zip(brute_ema(close, 3), brute_ema(close, 5), strict=True)])
    adx = column(out, "adx")
    assert adx[26] is None and adx[27] is not None and all(0 <= v <= 100 for v in adx[27:])
    close_to(column(longseries.scan(c, "ema", longseries.ema(9), 7), "ema"), brute_ema(close, 9))


def test_series_value_equals_prefix_value(spark):
    windows, scans = ind.popular()
    whole = ind.add_indicators(trend(spark), windows, scans).orderBy("ts").collect()
    part = ind.add_indicators(trend(spark, 50), windows, scans).orderBy("ts").collect()[-1]
    for name in [*windows, *scans]:
        close_to([whole[49][name]], [part[name]])


def test_one_exchange_for_windows_and_recurrences(spark):
    windows, scans = ind.popular()
    plan = ind.add_indicators(trend(spark), windows, scans)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_volume_zscore(spark):
    c = candles(spark, [(100, 110, 90, 105, v) for v in (100, 110, 120, 130, 140, 1000, 90)])
    z = column(features.encode_features(c, features.Features(["log_volume_zscore"])), "log_volume_zscore")
    assert z[:5] == [0.0] * 5 and z[5] > 0 and all(-1 <= x <= 1 for x in z)
    flat = candles(spark, [(100, 110, 90, 105, 7)] * 6 + [(100, 110, 90, 105, 9)])
    assert column(features.encode_features(flat, features.Features(["log_volume_zscore"])), "log_volume_zscore")[5:] == [0.0, 1.0]


def test_features_in_bounds_and_empty(spark):
    f = features.Features(["candle_color", "candle_type", "indicators", "nonsense", "stoch"])
    out = features.encode_features(trend(spark), f)
    assert out.columns[-len(f.columns()):] == f.columns()
    for r in out.collect():
        assert r.nonsense is None
        assert all(-1 <= r[c] <= 1 for c in f.columns() if c != "nonsense")
    empty = features.encode_features(trend(spark).limit(0), f)
    assert empty.count() == 0 and empty.columns == out.columns


def test_context_windows(spark):
    rows = [(T0 + dt.timedelta(minutes=i), float(i), i / 2, *hot) for i, hot in enumerate([(1, 0, 0), (0, 0, 1), (0, 1, 0), (0, 0, 1), (1, 0, 0)])]
    df = spark.createDataFrame([("A", "minute", *r) for r in rows], "symbol string, interval string, ts timestamp_ntz, f0 double, f1 double, lower int, neutral int, upper int")
    w = dataset.context_windows(df, ["f0", "f1"], dataset.class_index(["lower", "neutral", "upper"]), 2, 1)
    got = w.orderBy("ts").collect()
    assert [list(map(list, r.window)) for r in got][0] == [[0.0, 0.0], [1.0, 0.5]]
    assert [r.target for r in got] == [1, 2, 0]
    assert [r.n for r in dataset.label_counts(w, 3).orderBy("class_index").collect()] == [1, 1, 1]
    assert [r.weight for r in dataset.class_weights(dataset.label_counts(w, 3)).collect()] == [1.0, 1.0, 1.0]
    assert [r.weight for r in dataset.class_weights(dataset.label_counts(w, 4)).collect()] == [None] * 4
    with pytest.raises(Exception, match="unknown value"):
        df.select(dataset.label_index("upper", [5])).collect()


def test_splits(spark):
    df = spark.createDataFrame([(f"S{i}", "minute", T0 + dt.timedelta(minutes=j)) for i in range(10) for j in range(5)], "symbol string, interval string, ts timestamp_ntz")
    s = dataset.split_by_series(df, 3)
    assert s.filter("part = 'train'").select("symbol").distinct().count() == 8 and s.count() == 50
    one = dataset.split_by_series(df.filter("symbol = 'S1'"), 3)
    assert one.count() == 10
    w = dataset.split_by_window(df, 3, 0.25)
    assert w.filter("part = 'validation'").count() == 12 and w.count() == 50


def test_halo_equals_whole(spark):
    from pyspark.sql import Window

    c = trend(spark)
    dealt = series.halo(series.number_rows(c, "hour"), 8, 4, 3)
    w = Window.partitionBy("symbol", "interval", "chunk").orderBy("rn")
    part = dealt.withColumn("v", F.sum("close").over(w.rowsBetween(-4, 3))).filter("core").orderBy("ts").collect()
    whole = c.withColumn("v", F.sum("close").over(series.frame(4, 3))).orderBy("ts").collect()
    close_to([r.v for r in part], [r.v for r in whole])


def test_merge_recent_and_upsert(spark):
    base = trend(spark, 10)
    new = base.withColumns({"close": F.lit(1.0), "load_seq": F.lit(1)})
    more = new.withColumns({"close": F.lit(2.0), "load_seq": F.lit(2), "ts": F.col("ts") + F.expr("interval 1 minute")})
    out = series.merge_recent(base, new.unionByName(more), 10).orderBy("ts").collect()
    assert len(out) == 10 and out[-1].close == 2.0 and out[-2].close == 2.0 and out[0].ts == T0 + dt.timedelta(minutes=1)
    up = store.upsert_candles(base, new.unionByName(more)).orderBy("ts").collect()
    assert len(up) == 11 and up[0].close == 1.0 and all(r.close == 2.0 for r in up[1:])


def test_ticks(spark):
    rows = [(1, 10.0, 100.0, 5.0, 0), (1, 11.0, 130.0, 5.0, 20), (1, 12.0, 20.0, 7.0, 50), (1, 9.0, None, 3.0, 70), (1, 8.0, 25.0, 1.0, 80)]
    df = spark.createDataFrame([(t, p, v, q, T0 + dt.timedelta(seconds=s), "A") for t, p, v, q, s in rows], "instrument_token long, last_price double, volume_traded double, trade_quantity double, event_time timestamp_ntz, symbol string")
    d = volume_delta(df)
    assert [r.volume_delta for r in d.orderBy("event_time").collect()] == [5.0, 30.0, 7.0, 3.0, 5.0]
    c = ticks_to_candles(d, "minute").orderBy("ts").collect()
    assert [(r.open, r.high, r.low, r.close, r.volume) for r in c] == [(10.0, 12.0, 10.0, 12.0, 42.0), (9.0, 9.0, 8.0, 8.0, 8.0)]


def test_time_functions(spark):
    one = spark.range(1)
    at = F.lit("2026-05-15 09:14:59").cast("timestamp_ntz")
    got = one.select(*[time.candle_bucket(at, F.lit(i)).alias(i) for i in ("1h", "day", "week", "1s", "bad")]).first()
    assert got["1h"] == dt.datetime(2026, 5, 15, 8, 15) and got["day"] == T0 and got["week"] == dt.datetime(2026, 5, 11, 9, 15)
    assert got["1s"] == dt.datetime(2026, 5, 15, 9, 14, 59) and got["bad"] is None
    b = one.select(time.parse_bound(F.lit("2026-05-15"), True).alias("e"), time.parse_bound(F.lit("2026-05-15T03:45:00Z")).alias("z"), time.parse_bound(F.lit("2026-05-15T09:15:00+05:30")).alias("i"), time.parse_bound(F.lit("2026-05-15T09:15:00")).alias("n")).first()
    assert b.e == dt.datetime(2026, 5, 15, 23, 59, 59, 999999) and b.z == T0 and b.i == T0 and b.n == T0
    with pytest.raises(Exception, match="unsupported interval"):
        one.select(time.interval_minutes(F.lit("2h"), strict=True)).collect()
    x, s = ticks.parse_symbol(F.lit("bse:abc"))
    assert tuple(one.select(x, s).first()) == ("BSE", "ABC")
    assert one.select(units.indicator_unit(F.lit("MACDHIST_12"))).first()[0] == "volatility"


def test_csv_round_trip_and_paths(spark, tmp_path):
    c = trend(spark, 5)
    (tmp_path / "in").mkdir()
    lines = ["timestamp,open,high,low,close,volume", "2026-05-15T09:15:00+05:30,1,2,0.5,1.5,10"]
    (tmp_path / "in" / "M&M-X_60minute_2020-01-01_2026-01-01.csv").write_text("\n".join(lines))
    r = store.read_candles_csv(spark, str(tmp_path / "in")).first()
    assert (r.symbol, r.interval, r.ts, r.close) == ("M&M-X", "60minute", T0, 1.5)
    store.write_candles(c, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 5 and "candle_type" in back.columns
    done = store.write_dataset(c, str(tmp_path / "set"), ["close"])
    assert done.count() in (5, 0)
    both = c.unionByName(c.withColumn("symbol", F.lit("B")))
    store.write_dataset(both, str(tmp_path / "set"), ["close"])
    assert spark.read.parquet(str(tmp_path / "set")).groupBy("symbol").count().count() == 2


def test_audit_and_instruments(spark):
    c = trend(spark, 5)
    got = store.coverage_audit(c, spark.createDataFrame([("A",), ("B",)], "symbol string"), ["minute", "day"]).collect()
    assert {(r.symbol, r.interval) for r in got} == {("A", "day"), ("B", "minute"), ("B", "day")}
    master = spark.createDataFrame([("NSE", "abc", 7, 1), ("NSE", "ABC", 3, 2)], "exchange string, tradingsymbol string, instrument_token long, position int")
    wanted = spark.createDataFrame([("NSE", "ABC"), ("NSE", "NONE")], "exchange string, symbol string")
    assert {r.symbol: r.instrument_token for r in store.resolve_instruments(wanted, master).collect()} == {"ABC": 7, "NONE": None}
    assert [r.symbol for r in store.unresolved(wanted, master).collect()] == ["NONE"]


def test_softmax(spark):
    s = evaluate.softmax_argmax(spark.createDataFrame([([1.0, 3.0, 3.0],)], "logits array<double>")).first()
    assert s.predicted == 1 and math.isclose(sum(s.probs), 1.0)


def test_csv_names_of_files_and_folders(spark, tmp_path):
    row = "timestamp,open,high,low,close,volume\n2026-05-15T09:15:00+05:30,1,2,0.5,1.5,10\n"
    (tmp_path / "M&M_5minute_2026_2027.csv").write_text(row)
    folder = tmp_path / "series=A-B_day_all"
    folder.mkdir()
    (folder / "part-0.csv").write_text(row)
    got = store.read_candles_csv(spark, f"{tmp_path}/*").collect()
    assert {(r.symbol, r.interval, str(r.ts), r.close) for r in got} == {("M&M", "5minute", "2026-05-15 09:15:00", 1.5), ("A-B", "day", "2026-05-15 09:15:00", 1.5)}


def test_datasets_are_written_once(spark, tmp_path):
    rows = [(s, "day", dt.datetime(2026, 1, d), float(d)) for s in "AB" for d in range(1, 4)]
    df = spark.createDataFrame(rows, "symbol string, interval string, ts timestamp_ntz, x double")
    path = str(tmp_path / "data")
    assert store.write_dataset(df.filter("symbol = 'A'"), path, ["x"]).count() == 3
    assert {r.symbol for r in store.write_dataset(df, path, ["x"]).collect()} == {"B"}
    assert spark.read.parquet(path).count() == 6


def test_recurrences_do_not_depend_on_batches(spark):
    """Scans carry their state over Arrow batches of any size, over series, and over nulls."""
    rows = [(s, "day", dt.datetime(2026, 1, 1) + dt.timedelta(days=i), 10.0 + (i * k) % 7, 9.0 - (i % 3), None if i == 41 else 9.5 + (i * k) % 5, 1.0) for k, s in enumerate("ABC", 2) for i in range(60 if s != "C" else 3)]
    df = spark.createDataFrame(rows, "symbol string, interval string, ts timestamp_ntz, high double, low double, close double, volume double")
    specs = {"e": recurrence.ema(5), "h": recurrence.macd_hist(3, 6, 4), "a": recurrence.adx(4), "s": recurrence.ema_slope(4, 2)}
    seen = []
    for n in (1, 7, 10000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
        seen.append(sorted((r.symbol, r.ts, *(None if r[c] is None else round(r[c], 9) for c in specs)) for r in recurrence.with_recurrences(df, specs).collect()))
    assert seen[0] == seen[1] == seen[2] and any(r[3] is not None for r in seen[0])
    assert all(v is None for r in seen[0] if r[0] == "C" for v in r[2:])
