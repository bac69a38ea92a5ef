"""Embedding near-duplicates meet block by block: nothing is written or exchanged for a pair of blocks."""

import numpy as np

from candlemill.llm import embeddings


def test_blocks_meet_where_they_lie(spark, monkeypatch):
    for name, value in (("PER_PIVOT", 16), ("BLOCK", 8), ("MET", 3)):
        monkeypatch.setattr(embeddings, name, value)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(120, 6))
    v = np.concatenate([base, base[:40] + rng.normal(size=(40, 6)) * 0.2])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    units = embeddings.distinct_vectors(embeddings.named(df, "vec_id", "embedding"))
    points, radius = embeddings.pivots(units), float(np.sqrt(0.2)) + 1e-9
    blocks = embeddings.packed(embeddings.cells(units, points), points, radius).localCheckpoint()
    held = [len(r.names) // 24 for r in blocks.collect()]
    assert sum(held) == len(v) and max(held) <= 8 and len(held) >= 20
    plan = embeddings.block_links(blocks, points, radius, 0.9)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and ("CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan)
    u = v / np.linalg.norm(v, axis=1)[:, None]
    links = (u @ u.T >= 0.9).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(df).collect()}
    assert got == dict(enumerate(links.tolist())) and links.max() > 0
