"""Hard negatives, token counts and vector codes against brute force, with awkward rows and on empty tables."""

import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from candlemill.llm import codebooks, integers, negatives, tokencounts

from . import corpus

SPEC = tokencounts.definition(tokencounts.default_tokenizer())
NAN, INF = float("nan"), float("inf")


def multiset(rows):
    return Counter(map(tuple, rows))


def library_count(text):
    return len(tokencounts.library(SPEC).encode(text or "", add_special_tokens=False).ids)


def test_pretokens_like_the_library():
    """Random texts of letters, digits, blanks, marks and special strings are cut where the library cuts them."""
    r = random.Random(3)
    parts = [*"abstredlvm12 ''  \n\t!.-é龘٣ \x1c😀 SLL", "'s", "'re", " '", "<|endoftext|>", "'ll", "  ", "\r\n", "'ve", "<|endof", "text|>"]
    cut, ask = tokencounts.Cutter(SPEC), tokencounts.library(SPEC).pre_tokenizer.pre_tokenize_str
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(8000)]
    raw = [t.encode() for t in texts]
    off = np.cumsum([0, *map(len, raw)])
    data = np.frombuffer(b"".join(raw), np.uint8)
    got = cut.cut(data, off)
    found = [[] for _ in texts]
    for s, e, i in zip(got.start, got.end, got.row, strict=True):
        found[i].append(bytes(data[s:e]).decode())
    for t, f, n in zip(texts, found, got.special, strict=True):
        pieces = t.split("<|endoftext|>")
        assert (f, n) == ([p[s:e] for p in pieces for _, (s, e) in ask(p)], len(pieces) - 1), t


@pytest.mark.parametrize("hot", [tokencounts.HOT, 40, 0])
def test_token_counts(spark, hot):
    """All pre-tokens by broadcast, some, and none."""
    r = random.Random(5)
    texts = [t for _, t, *_ in corpus.rows()]
    texts += ["<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endof", "text|>", "don't 'tis  \n\n x ", "日本語" * 900, "퟿�", "a" * 20_000, "token " * 200_000]
    texts += ["".join(r.choice("ab é!\n9'") for _ in range(50)) for _ in range(50)]
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)] + [(3, texts[3], "x", "y"), (None, "no id", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, token string, n string").repartition(5)
    got = tokencounts.count(df, carry=["doc_id", "token", "n"], hot=hot)
    assert got.columns == ["doc_id", "token", "n", "n_bytes", "n_tokens", "over_limit"]
    want = multiset((i, a, b, len((t or "").encode()), library_count(t), library_count(t) > 512) for i, t, a, b in rows)
    assert multiset(got.collect()) == want


def test_token_counts_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert tokencounts.count(empty).collect() == []
    nulls = spark.createDataFrame([(1, None), (None, None), (2, "")], "doc_id long, text string")
    assert multiset(tokencounts.count(nulls).collect()) == multiset([(1, 0, 0, False), (None, 0, 0, False), (2, 0, 0, False)])


def test_long_texts_are_cut_between_words():
    """Blocks far smaller than the texts give the same pre-tokens."""
    r = random.Random(8)
    texts = ["".join(r.choice(["word", " ", ".", "-", "'s", "7", "\n", "é", "<|endoftext|>"]) for _ in range(3000)) for _ in range(3)] + ["x" * 5000, ""]
    column = pa.array(texts, pa.string())

    def total(limit):
        out = Counter()
        for f in tokencounts.frequencies(column, SPEC, limit):
            for row, s, e, n in zip(f.row, f.start, f.end, f.n, strict=True):
                out[int(row), bytes(f.data[s:e])] += int(n)
            for row, n in zip(f.special_row, f.special, strict=True):
                out[int(row), "special"] += int(n)
        return +out

    assert total(200) == total(1 << 20)


def test_other_tokenizers_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        tokencounts.definition(public_tokenizers.path("word_bpe_49k.json"))


def test_transform():
    x = np.random.default_rng(1).integers(-50, 50, (5, 16))
    y = integers.walsh_hadamard(x)
    assert ((y**2).sum(axis=1) == 16 * (x**2).sum(axis=1)).all()
    order = integers.sequency_order(16)
    rows = integers.walsh_hadamard(np.eye(16, dtype=np.int64))[order]
    assert [int((np.diff(row) != 0).sum()) for row in rows] == list(range(16))


def vectors(n, dim, seed, labels=4):
    g = np.random.default_rng(seed)
    x = np.round(g.normal(size=(n, dim)) / 4, 3)
    x[n // 2 :] = np.round(x[: n - n // 2] + g.normal(size=(n - n // 2, dim)) / 40, 3)
    return [(i, x[i].tolist(), int(g.integers(labels))) for i in range(n)]


ODD = [
    (900, None, 1), (901, [], 2), (902, [1.0, None], 1), (903, [NAN, 1.0], 1), (904, [INF], 1), (905, [0.5] * 3, 2), (906, [0.25] * 8, None), (None, [0.1] * 8, 1),
    (900, [0.5] * 8, 1), (900, [0.5] * 8, 1), (910, [0.25] * 8, 1), (920, [0.25] * 8, 2), (907, [0.25] * 8, 3), (908, [0.0] * 8, 2), (930, [-0.5] * 8, 77),
]


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def whole(v, width, scale):
    return np.array([int(np.floor(scale * x)) for x in v] + [0] * (width - len(v)), np.int64)


def brute_negatives(rows, every, width):
    use = [(i, lab, whole(v, width, 256)) for i, v, lab in rows if i is not None and lab is not None and usable(v)]
    out, seen = Counter(), set()
    for a, lab, q in use:
        if a % every or (a, lab, tuple(q)) in seen:
            continue
        seen.add((a, lab, tuple(q)))
        scored = sorted((-int(q @ p), i, other) for i, other, p in use if i != a or other != lab)
        for s, p, _ in [x for x in scored if x[2] == lab and x[1] != a][:5]:
            inside = [x for x in scored if x[2] != lab and 80 * -s <= -100 * x[0] <= 100 * -s][:5]
            out.update((a, p, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(inside))
    return out


@pytest.mark.parametrize(("block", "planes"), [(None, 8), (64 * 40, 8), (64 * 40, 2)])
def test_hard_negatives(spark, monkeypatch, block, planes):
    """One block and many, fine and coarse planes: the rows are those of the plain definition."""
    if block:
        monkeypatch.setattr(negatives, "BLOCK_COMPONENTS", block)
    rows = vectors(300, 8, 4) + ODD
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "vec_id long, embedding array<double>, label int, lab int, kind string").repartition(4)
    got = negatives.mine(df, F.col("id") % 10 == 0)
    assert multiset(got.collect()) == brute_negatives(rows, 10, 8)


def test_copies_of_one_row_spread(spark, monkeypatch):
    """A third of all rows are copies of one row and another third copies of an anchor: blocks stay even, and the rows are right."""
    monkeypatch.setattr(negatives, "BLOCK_COMPONENTS", 64 * 60)
    rows = vectors(100, 8, 14) + [(3, [0.25, 0.5] * 4, 1)] * 100 + [(10, [0.5, 0.25] * 4, 2)] * 100
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    sizes = [r["count"] for r in negatives.dealt(negatives.index(df, "vec_id", "embedding", "label", 256), 5).groupBy("block").count().collect()]
    assert sum(sizes) == 300 and max(sizes) < 90
    assert multiset(negatives.mine(df, F.col("id") % 10 == 0).collect()) == brute_negatives(rows, 10, 8)


def test_intervals_hold_the_products():
    """Every interval, at every level, holds the exact inner product."""
    g = np.random.default_rng(6)
    q = g.integers(-200, 200, (40, 70))
    y = negatives.rotated(q, 128)
    assert (y @ y.T == 128 * (q @ q.T)).all()
    code, align, rest = negatives.codes(y)
    one = lambda x: pa.array([[x]] * 40)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(40)), pa.array(range(40)), pa.array([0] * 40), pa.array(q.tolist()), one(0), one(0), one(0)], names=["id", "h", "lab", "q", "rank", "low", "high"]
    )
    a, all_ = negatives.Anchors(batch, 128, 5, True), np.arange(40)
    estimate, spread, widths = 0.0, 0.0, []
    for level in range(negatives.LEVELS):
        bits = np.bitwise_count(a.planes[:, None] & code[None, :, level][:, :, None, :]).sum(axis=3).astype(np.int64)
        count, own = (bits << np.arange(negatives.PLANES)).sum(axis=2), np.bitwise_count(code[:, level]).sum(axis=1).astype(np.int64)
        estimate, spread, room = negatives.interval(a, all_[:, None], count, own[None], align[None, :, level], estimate, spread, rest[None, :, level])
        assert (np.abs(estimate - y @ y.T) <= room).all()
        widths.append(room.mean())
    assert all(b < 0.8 * a for a, b in itertools.pairwise(widths))


def test_hard_negatives_of_nothing(spark):
    schema = "vec_id long, embedding array<float>, label int"
    for rows in ([], [(0, None, 1), (100, [NAN], 1)], [(0, [1.0], 1), (1, [1.0], 2)], [(0, [1.0], 1), (1, [-1.0], 1), (2, [-1.0], 2)]):
        assert negatives.mine(spark.createDataFrame(rows, schema), F.col("id") % 100 == 0).collect() == []
    with pytest.raises(Exception, match="exact sums need"):
        negatives.mine(spark.createDataFrame([(0, [1e30], 1), (1, [1e30], 1)], schema.replace("float", "double")), F.col("id") % 100 == 0).collect()


def brute_codes(rows, width):
    use = [(i, lab, whole(v, width, 1024)) for i, v, lab in rows if usable(v)]
    use.sort(key=lambda r: (r[0] is None, r[0] or 0, tuple(r[2])))
    x = np.array([q for *_, q in use]).reshape(len(use), 4, -1)
    books = x[:256].transpose(1, 0, 2).copy()

    def assigned():
        d = ((x.transpose(1, 0, 2)[:, :, None] - books[:, None]) ** 2).sum(axis=3)
        return d.argmin(axis=2), d.min(axis=2)

    for _ in range(4):
        code, _ = assigned()
        for p in range(4):
            for k in set(code[p].tolist()):
                books[p, k] = x[code[p] == k, p].sum(axis=0) // (code[p] == k).sum()
    code, error = assigned()
    sums = Counter()
    for n, (_, lab, _) in enumerate(use):
        sums[lab] += int(error[:, n].sum())
    sha = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return Counter((i, "".join(f"{c:02x}" for c in code[:, n]), int(error[:, n].sum()), sums[lab], sha) for n, (i, lab, _) in enumerate(use))


@pytest.mark.parametrize("n", [20, 700])
def test_vector_codes(spark, n):
    rows = vectors(n, 8, 7, labels=30) + ODD
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "vec_id long, embedding array<double>, label int, code string, error int").repartition(3)
    assert multiset(codebooks.compress(df).collect()) == brute_codes(rows, 8)


def test_vector_codes_of_odd_lengths_and_rare_labels(spark, monkeypatch):
    """Lengths that four does not divide; labels matched by shuffle instead of broadcast."""
    monkeypatch.setattr(codebooks, "HOT_SHARE", 0.2)
    rows = [(i, v[: 5 + i % 2], lab if i % 3 else None) for i, v, lab in vectors(90, 6, 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    # six components make four parts of two
    assert multiset(codebooks.compress(df).collect()) == brute_codes(rows, 8)


def test_vector_codes_of_nothing(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert codebooks.compress(spark.createDataFrame([], schema)).collect() == []
    assert codebooks.compress(spark.createDataFrame([(1, None, 1), (2, [NAN], None)], schema)).collect() == []
    (one,) = codebooks.compress(spark.createDataFrame([(1, [], 1)], schema)).collect()
    assert (one.code, one.error, one.label_error) == ("00000000", 0, 0)


def test_search_gives_up_no_tie():
    """Equal entries and equal distances: the lower index, as in the plain search."""
    g = np.random.default_rng(2)
    x, books = g.integers(-2, 3, (200, 4, 4)), g.integers(-2, 3, (4, 37, 4))
    shape = codebooks.Shape(4, 4, 1)
    code, error = codebooks.assign(x, books, shape)
    d = ((x.transpose(1, 0, 2)[:, :, None] - books[:, None]) ** 2).sum(axis=3)
    assert (code == d.argmin(axis=2).T).all() and (error == d.min(axis=2).T).all()
