"""Recurrences and running sums by chunks against the whole-series forms, and who holds how much."""

import datetime as dt
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlemill.operators import indicators, labels, longseries, recurrence
from candlemill.schemas import CANDLE

T0 = dt.datetime(2026, 1, 5, 9, 15)


def rows(n, symbol, seed, flat=()):
    r, close, out = random.Random(seed), 100.0, []
    for i in range(n):
        if any(a <= i < b for a, b in flat):
            o = h = low = close
        else:
            o, close = close, round(close + r.uniform(-3, 3.1), 2)
            h, low = round(max(o, close) + r.random(), 2), round(min(o, close) - r.random(), 2)
        out.append((symbol, "minute", T0 + dt.timedelta(hours=7 * i), o, h, low, close, float(r.randint(0, 90))))
    return out


@pytest.fixture(scope="module")
def candles(spark):
    data = rows(700, "ONE", 1, flat=[(0, 40), (200, 260)]) + rows(65, "A", 2) + rows(64, "B", 3) + rows(5, "C", 4) + rows(1, "D", 5) + rows(90, "E", 6, flat=[(0, 90)])
    random.Random(9).shuffle(data)
    return spark.createDataFrame(data, CANDLE).repartition(5).cache()


FORMS = {
    "ema": (recurrence.ema(9), lambda c, n: longseries.scan(c, "x", longseries.ema(9), n)),
    "vema": (recurrence.ema(9, "volume"), lambda c, n: longseries.scan(c, "x", longseries.ema(9, "volume"), n)),
    "macd": (recurrence.macd(5, 12), lambda c, n: longseries.scan(c, "x", longseries.macd(5, 12), n)),
    "macd_hist": (recurrence.macd_hist(5, 12, 6), lambda c, n: longseries.scan(c, "x", longseries.macd_hist(5, 12, 6), n)),
    "macd_hist_scaled": (recurrence.macd_hist(5, 12, 6, True), lambda c, n: longseries.scan(c, "x", longseries.macd_hist(5, 12, 6, True), n)),
    "adx": (recurrence.adx(7), lambda c, n: longseries.adx(c, "x", 7, size=n)),
    "adx_scaled": (recurrence.adx(7, True), lambda c, n: longseries.adx(c, "x", 7, True, size=n)),
}


def values(df):
    return {(r.symbol, r.ts): r.x for r in df.select("symbol", "ts", "x").collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert (got[k] is None) == (w is None) and (w is None or abs(got[k] - w) <= 1e-8 * max(1.0, abs(w))), (k, got[k], w)


@pytest.mark.parametrize("name", FORMS)
@pytest.mark.parametrize("size", [16, 1000])
def test_scans_by_chunks(candles, name, size):
    """Warm-ups that span chunks, skipped DX at the start and inside, series of one row."""
    whole, chunks = FORMS[name]
    same(values(chunks(candles, size)), values(recurrence.with_recurrences(candles, {"x": whole})))


@pytest.mark.parametrize("size", [1, 16, 1000])
def test_running_sums_by_chunks(candles, size):
    same(values(longseries.vwap(candles, "x", size)), values(indicators.vwap()(candles, "x")))
    same(values(longseries.obv(candles, "x", size)), values(indicators.obv()(candles, "x")))


def test_first_reached():
    """Every horizon against the plain search, ties and rows without an answer included."""
    r = np.random.default_rng(3)
    for most in [*range(1, 20), 31, 32, 33, 100]:
        x = r.integers(0, 12, 60).astype(float)
        least = r.integers(0, 14, 60).astype(float)
        want = [next((k for k in range(1, most + 1) if i + k < 60 and x[i + k] >= least[i]), most + 1) for i in range(60)]
        assert longseries.first_reached(x, least, most).tolist() == want, most


@pytest.mark.parametrize("b", [labels.Barriers(2, 3, 1), labels.Barriers(2, 3, 5, tie="upper"), labels.Barriers(9, 9, 35, vertical="neutral"), labels.Barriers(12, 12, 200, tie="neutral")])
@pytest.mark.parametrize("size", [8, 4096])
def test_barriers_by_chunks(candles, b, size):
    odd = candles.withColumns({"high": F.when(F.col("volume") != 13, F.col("high")), "close": F.when(F.col("volume") == 14, 0.0).when(F.col("volume") != 15, F.col("close"))})
    pick = lambda df: {(r.symbol, r.ts): (r.label_lower, r.label_neutral, r.label_upper) for r in df.collect()}
    assert pick(longseries.triple_barrier(odd, b, size)) == pick(labels.triple_barrier(odd, b))


def test_empty(spark):
    empty = spark.createDataFrame([], CANDLE)
    assert longseries.adx(empty, "x").count() == longseries.scan(empty, "x", longseries.macd()).count() == longseries.obv(empty, "x").count() == longseries.vwap(empty, "x").count() == 0


def test_no_task_holds_a_long_series(spark, candles):
    """Rows are dealt by chunk: no task puts out most of the long series, and no exchange deals candles by series alone."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for make in (lambda c: longseries.scan(c, "x", longseries.macd_hist(), 16), lambda c: longseries.adx(c, "x", size=16), lambda c: longseries.obv(c, "x", 16), lambda c: longseries.vwap(c, "x", 16)):
            out = make(candles)
            got = out.select("symbol", "x", F.spark_partition_id().alias("p")).collect()
            most = max(Counter(r.p for r in got if r.symbol == "ONE").values())
            assert most < 700 / 3
            plan = out._jdf.queryExecution().executedPlan().toString()
            for line in plan.splitlines():
                # only tables with a row a chunk or unit (no prices) meet by series
                if re.search(r"Exchange hashpartitioning\(symbol#\d+, interval#\d+, \d+\)", line):
                    below = plan[plan.index(line) :].splitlines()[1]
                    # a map lists its input, too: its output is the last list
                    assert "close#" not in below.rsplit("[", 1)[-1], below
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_what_a_scan_leaves_behind(spark, candles):
    """One table of chunks stays of an ADX, that its result reads; rows carry no column twice; shuffle files of written steps go."""
    import os

    from candlemill.session import shared_dir

    tables = lambda: {d for d in os.listdir(f"{shared_dir(spark)}/candlemill") if d.startswith("chunks-")} if os.path.isdir(f"{shared_dir(spark)}/candlemill") else set()
    held = lambda: sum(f.startswith("shuffle_") and f.endswith(".data") for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs() for _, _, fs in os.walk(d.getPath()) for f in fs)
    before, files = tables(), held()
    out = longseries.adx(candles, "x", 7, size=16)
    assert len(tables() - before) == 1
    assert "_x0" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert held() <= files
    same(values(out), values(recurrence.with_recurrences(candles, {"x": recurrence.adx(7)})))
