"""Exchange rounds of the class model: units meet their neighbours once, in one exchange."""

from collections import Counter

import numpy as np
import pyarrow as pa

from candlemill.llm import classlm
from candlemill.llm.blocks import blocks


def texts(spark, words):
    r = np.random.default_rng(11)
    rows = [(" ".join(f"w{i}" for i in r.zipf(1.3, 40) % words),) for _ in range(400)] + [("",), (None,), ("w1 w1 w1",)]
    return spark.createDataFrame(rows, "text string").repartition(7)


def test_rounds_share_one_exchange(spark, monkeypatch):
    calls, spread = [], classlm.spread

    def counted(df, count=None, *columns):
        calls.append(columns)
        return spread(df, count, *columns)

    monkeypatch.setattr(classlm, "spread", counted)
    classlm.train(texts(spark, 300), config=classlm.Config(least=2, buckets=16, classes=6, rounds=3))
    assert len(calls) == 1


def test_neighbours_hold_every_bigram_twice(spark):
    docs, c = texts(spark, 300), classlm.Config(buckets=16)
    b = next(iter(blocks(pa.array([" ".join(f"w{i}" for i in range(200))]))))
    _, codes = classlm.block_codes(b, c.buckets)
    codes = np.sort(codes)
    ids, heads = np.arange(1, 1 + len(codes), dtype=np.int32), len(codes)
    units = 1 + heads + c.buckets
    expected = Counter()
    for t in docs.collect():
        b = next(iter(blocks(pa.array([t.text or ""]))))
        seq = [0, *classlm.unit_ids(classlm.block_codes(b, c.buckets)[1], classlm.Lookup(codes), ids, heads).tolist(), 0]
        expected.update(zip(seq, seq[1:], strict=False))
    after, before, seen = Counter(), Counter(), Counter()
    for r in classlm.neighbours(classlm.unit_bigrams(docs, "text", (codes, ids), c), units).collect():
        unit = np.frombuffer(r.unit, np.int32)
        seen.update(unit.tolist())
        for out, many, other, n in ((after, r.follow, r.v, r.n), (before, r.precede, r.w, r.m)):
            own = np.repeat(unit, np.frombuffer(many, np.int32)).tolist()
            for x, y, k in zip(own, np.frombuffer(other, np.int32).tolist(), np.frombuffer(n, np.int64).tolist(), strict=True):
                out[(x, y) if out is after else (y, x)] += k
    assert after == expected and before == expected and set(seen.values()) == {1}
