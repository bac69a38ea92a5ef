"""Op 6 tells of repeated passages of over 50 words beside its strings of 400 bytes."""

import random
from collections import Counter

import pytest

from candlemill.llm import catalog, substrings

from .test_operators import brute_repeats


def brute_passages(texts, words):
    """(spans, bytes) under passages of so many words that start anywhere else; texts of ASCII words with one space between."""
    cut = [t.split(" ") if t else [] for t in texts]
    count = Counter(tuple(w[i : i + words]) for w in cut for i in range(len(w) - words + 1))
    out = []
    for w in cut:
        edge = [0]
        for x in w:
            edge.append(edge[-1] + len(x) + 1)
        spans = []
        for i in range(len(w) - words + 1):
            if count[tuple(w[i : i + words])] > 1:
                a, b = edge[i], edge[i + words] - 1
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = b
                else:
                    spans.append([a, b])
        out.append((len(spans), sum(b - a for a, b in spans)))
    return out


def rows(seed):
    r = random.Random(seed)
    fresh = lambda n: [f"{r.choice('abcdefgh')}{r.randrange(36**3):x}" for _ in range(n)]
    pool = [fresh(n) for n in (45, 51, 55, 60, 70, 75, 80, 120, 200)]
    out = ["", *(" ".join(fresh(n)) for n in (50, 51, 300, 300))]
    for _ in range(240):
        p = list(r.choice(pool))
        # parts of passages, some with a word changed, so that one anchor has strings alike on either side
        a = r.randrange(len(p) // 3)
        p = p[a * r.randrange(2) : len(p) - r.randrange(len(p) // 3) * r.randrange(2)]
        for _ in range(r.randrange(3)):
            p[r.randrange(len(p))] = fresh(1)[0]
        out.append(" ".join([*fresh(r.randrange(40)), *p, *fresh(r.randrange(40))]))
    return out


@pytest.mark.parametrize("variants", [None, 1])
def test_strings_and_passages(spark, variants, monkeypatch):
    if variants:
        monkeypatch.setattr(substrings, "VARIANTS", variants)
    texts = rows(5)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = [(i, *a, *b) for i, (a, b) in enumerate(zip(brute_repeats(texts, 400), brute_passages(texts, 51), strict=True))]
    assert sum(x[2] > 0 for x in want) > 20 and sum(x[5] > 0 and not x[2] for x in want) > 20
    assert sorted(map(tuple, substrings.summary(df, passage=51).collect())) == want
    assert sorted(map(tuple, substrings.summary(df).collect())) == [x[:5] for x in want]


def test_query_tells_passages_of_under_400_bytes(spark, tmp_path):
    r = random.Random(2)
    fresh = lambda n: " ".join(f"{r.choice('abcdefgh')}{r.randrange(36**3):x}" for _ in range(n))
    passage = fresh(55)
    assert len(passage) < 330
    texts = [f"{fresh(80)} {passage} {fresh(80)}", f"{fresh(70)} {passage}", fresh(200), None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {d.doc_id: (d.n_removed, d.n_passages, d.passage_bytes) for d in catalog.QUERIES["op6_suffix_array_dedup"](spark, str(tmp_path)).collect()}
    assert got == {0: (0, 1, len(passage)), 1: (0, 1, len(passage)), 2: (0, 0, 0), 3: (0, 0, 0)}
