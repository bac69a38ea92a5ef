"""The pipeline's stages keep columns, act on every row, and agree with the operators."""

import pytest

from . import corpus

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    rows = [*corpus.rows(), (500, "12 34", "en", "s", 5, "c", "c", 1)]
    spark.createDataFrame(rows, corpus.SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    hit = next(r[1] for r in rows if r[1] and len(corpus.plain_words(r[1])) == 120 or r[1] and len(corpus.plain_words(r[1])) > 60)
    spark.createDataFrame([(1, hit)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if i + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"s{i}"))
        docs = spark.read.parquet(str(tmp_path / f"s{i}"))
        seen[name] = docs
    ids = lambda name: [r.doc_id for r in seen[name].select("doc_id").collect()]
    first = ids("language_id")
    assert 500 not in first and 0 not in first and 1 not in first and 45 in first
    one = ids("ngram_jaccard_join")
    assert len(one) == len(set(one)) and set(one) <= set(first)
    texts = [r.text for r in seen["ngram_jaccard_join"].collect()]
    assert len(set(texts)) == len(texts)
    cut = seen["suffix_array_dedup"].collect()
    assert all(r.n_chars == len(r.text) for r in cut) and len(cut) <= len(one)
    assert hit not in [r.text for r in seen["benchmark_decontamination"].collect()]
    assert set(ids("benchmark_decontamination")) <= set(ids("suffix_array_dedup"))
    last = seen["sentencepiece"].collect()
    assert last and all(r.round_trip and r.n_ids == len(r.ids) for r in last)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(last)


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], corpus.SCHEMA)
    spark.createDataFrame([(1, "some words")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


@pytest.mark.parametrize("variants", [None, 1])
def test_short_passages_are_cut(spark, variants, monkeypatch):
    """Passages of over 50 words go, whatever bytes they have; those of 50 stay."""
    import random

    if variants:
        monkeypatch.setattr(corpus_pipeline.substrings, "VARIANTS", variants)
    r = random.Random(8)
    fresh = lambda n: [f"{r.choice('abcdefgh')}{r.randrange(36**3):x}" for _ in range(n)]
    rows, passages = [], {}
    for n in [50, *range(51, 66)]:
        passages[n] = fresh(n) if n % 2 else [w[:2] for w in fresh(n)]
        for copy in range(2):
            # other neighbours, spaces and punctuation in each copy
            mid = " ".join(passages[n]) if not copy else f"({'  '.join(passages[n])})."
            rows.append((100 * n + copy, " ".join([*fresh(70), mid, *fresh(70)]), "en", "s", 0))
    wide = "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(60))
    rows += [(50 + i, "".join(chr(0x7000 + r.randrange(2000)) for _ in range(80)) + wide + "。" * (i + 1) + " end", "zh", "s", 0) for i in range(2)]
    rows += [(1, " ".join(["é"] + fresh(200)), "en", "s", 0), (2, None, "en", "s", 0), (3, "— - ...", "en", "s", 0), (4, "y" * 900, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    before = {d[0]: d[1] for d in rows}
    got = {d.doc_id: d.text for d in corpus_pipeline.cut_repeats(spark, docs, "").collect()}
    for n, p in passages.items():
        for copy in range(2):
            key, gap = 100 * n + copy, "  " if copy else " "
            want = before[key] if n == 50 else before[key].replace(gap.join(p), "")
            assert got[key] == want, (n, copy)
    for i in (50, 51):
        assert got[i] == before[i].replace(wide + "。", "")
    assert got[1] == before[1] and got[2] is not None and got[3] == before[3] and got[4] == before[4]


def test_words_of_scripts_without_spaces():
    import numpy as np

    from candlemill.llm.blocks import Block
    from candlemill.llm.substrings import words_of

    raw = "x(漢字、ab) ..。cd— ééé,".encode()
    b = Block(0, np.frombuffer(raw + b"zz", np.uint8), np.array([0, len(raw), len(raw) + 2]))
    u = words_of(b)
    cut = [(raw + b"zz")[i:j].decode() for i, j in zip(u.begin, u.stop, strict=True)]
    assert cut == ["x", "漢", "字", "、", "ab", "。", "cd—", "ééé", "zz"] and u.first.tolist() == [0, 8, 9]
    # parsing the units again gives them again
    again = words_of(Block(0, u.data, np.array([0, len(u.data)])))
    assert bytes(again.data).split() == bytes(u.data).split()
    text = bytes(u.data[u.start[1] : u.end[4]])
    assert bytes(words_of(Block(0, np.frombuffer(text, np.uint8), np.array([0, len(text)]))).data) == text
