import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from candlemill.llm import sharding


def cell(key):
    return int(hashlib.md5(("" if key is None else str(key)).encode()).hexdigest()[:3], 16)


def brute(rows, shards, nodes):
    """The ring walked row by row, own rows before waiting ones: (row, shard, slot) of each."""
    ring = sharding.ring(shards, nodes)
    by_arc = defaultdict(list)
    for r in rows:
        ahead = [i for i, (c, _) in enumerate(ring) if c >= cell(r.doc_id)]
        by_arc[ahead[0] if ahead else 0].append(r)
    q, r = divmod(len(rows), shards)
    room = [q + (s < r) for s in range(shards)]
    waiting, counts, out = [], [0] * shards, []
    for lap in range(2):
        for a, (_, s) in enumerate(ring):
            come = by_arc[a] if lap == 0 else []
            own = min(len(come), room[s] - counts[s])
            waiting += come[own:]
            take = min(len(waiting), room[s] - counts[s] - own)
            for x in come[:own] + waiting[:take]:
                out.append((x, s, counts[s]))
                counts[s] += 1
            waiting = waiting[take:]
    assert not waiting
    return out


def in_ring_order(spark, df):
    """Rows as the operator orders them: by cell from the first arc, slice, id hash, id, crc, size."""
    turn = sharding.ring(8)[-1][0] + 1
    crc, size = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    rows = df.select("doc_id", size.alias("size"), crc.alias("crc"), F.xxhash64("doc_id").alias("h"), F.pmod(F.xxhash64(crc, size), F.lit(sharding.SLICES)).alias("slice")).collect()
    return sorted(rows, key=lambda r: ((cell(r.doc_id) - turn) % sharding.CELLS, r.slice, r.h, r.doc_id is not None, r.doc_id or 0, r.crc, r["size"]))


def check(spark, df):
    got = sharding.assign(df, shards=8).collect()
    want = brute(in_ring_order(spark, df), 8, 64)
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in got) == Counter((r.doc_id, r["size"], r.crc, s, k) for r, s, k in want)
    return got


@pytest.mark.parametrize("n", [0, 1, 5, 8, 999])
def test_rows_law(spark, n):
    df = spark.createDataFrame([(i, "x" * (i % 7) if i % 5 else None, "e") for i in range(n)], "doc_id long, text string, size string")
    got = check(spark, df)
    assert sorted(r.doc_id for r in got) == list(range(n))
    counts = [sum(r.shard == s for r in got) for s in range(8)]
    assert max(counts) - min(counts) <= 1
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    for r in got:
        assert r.text_crc32 == zlib.crc32(b"x" * (r["size"] - 1))
        assert r["size"] == 1 + (r.doc_id % 7 if r.doc_id % 5 else 0)
        assert r.law == "rows" and r.grown_shard is None


def test_few_rows_leave_their_arc(spark):
    got = sharding.assign(spark.range(20000).selectExpr("id doc_id", "'a' text"), shards=8)
    assert got.filter("overflowed").count() < 0.2 * 20000


@pytest.mark.parametrize("run", [7, 1 << 16])
def test_repeated_and_null_ids(spark, run, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", run)
    rows = [(None, "a")] * 500 + [(1, "b")] * 11 + [(2, None), (2, "")] * 3 + [(3, f"text {i}") for i in range(300)] + [(None, f"é{i}") for i in range(90)]
    got = check(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    counts = [sum(r.shard == s for r in got) for s in range(8)]
    assert len(got) == len(rows) and max(counts) - min(counts) <= 1
    assert len({(r.shard, r.slot) for r in got}) == len(rows)
