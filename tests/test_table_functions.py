"""A user's scan from SQL, in the batch registry and live: the same values."""

import datetime as dt

import pytest

from candlemill.operators import recurrence, registry
from candlemill.schemas import CANDLE


@pytest.mark.parametrize("at_once", [3, 1024])
def test_scan_from_sql(spark, monkeypatch, at_once):
    monkeypatch.setattr(registry, "ROWS_AT_ONCE", at_once)
    rows = [(s, "day", dt.datetime(2026, 1, 1) + dt.timedelta(days=i), 1.0, 2.0, 0.5, float((i * 7) % 11), float(i % 5)) for s, n in (("A", 40), ("B", 3), ("C", 12)) for i in range(n)]
    df = spark.createDataFrame(rows[::-1], CANDLE).repartition(4)
    df.createOrReplaceTempView("some_candles")
    scans = {"my_macd": recurrence.macd_hist(3, 6, 4), "my_adx": recurrence.adx(4)}
    want = {(r.symbol, r.ts): r for r in recurrence.with_recurrences(df, scans).collect()}
    for name, scan in scans.items():
        registry.table_function(spark, name, scan)
        got = spark.sql(f"select * from {name}(table(some_candles)) where symbol <> 'Z'")
        assert got.columns == [*df.columns, name]
        seen = {(r.symbol, r.ts): r[name] for r in got.collect()}
        assert len(seen) == len(rows)
        for k, v in seen.items():
            w = want[k][name]
            assert (v is None) == (w is None) and (v is None or abs(v - w) < 1e-9)
