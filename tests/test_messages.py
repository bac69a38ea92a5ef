"""Tick messages: one tick, lists, and what is no message."""

import datetime as dt

from candlemill.sources import store


def test_messages(spark):
    tick = '{"instrument_token": 7, "last_price": 5.5, "quantity": 2, "timestamp": "2026-05-15T09:15:00+05:30", "depth": {"buy": []}}'
    naive = '{"instrument_token": 8, "last_price": 6, "last_quantity": 0, "quantity": 4.5, "last_trade_time": "2026-05-15 09:16:00"}'
    texts = [tick, f" [{tick}, {naive}] ", "[]", None, "", "7", '"text"', "{broken", f"[{tick},", '{"last_price": 5}', '{"timestamp": "2026-05-15T09:15:00", "last_price": "x"}', f"{tick}\n"]
    good, bad = store.parse_messages(spark.createDataFrame(list(enumerate(texts)), "n int, value string"))
    at = lambda m: dt.datetime(2026, 5, 15, 9, m)
    assert sorted((r.n, r.instrument_token, r.last_price, r.trade_quantity, r.event_time) for r in good.collect()) == [
        (0, 7, 5.5, 2.0, at(15)), (1, 7, 5.5, 2.0, at(15)), (1, 8, 6.0, 4.5, at(16)), (11, 7, 5.5, 2.0, at(15)),
    ]
    assert sorted((r.n, r.value) for r in bad.collect()) == sorted((i, texts[i]) for i in (3, 4, 5, 6, 7, 8)), bad.collect()
