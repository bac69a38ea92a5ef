"""Every operator against brute force on a small corpus with awkward rows, and on an empty table."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from candlemill.llm import chat, classlm, contamination, embeddings, jaccard, language, licenses, pieces, substrings
from candlemill.llm.jobs import components, fold

from . import corpus


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus.rows(), corpus.SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], corpus.SCHEMA)


def multiset(rows):
    return Counter(map(tuple, rows))


def test_licenses(docs, empty):
    want = []
    for d in docs.collect():
        w, at, names = corpus.plain_words(d.text), [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            here = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
            at += here
            names |= {label} if here else set()
        want.append((d.doc_id, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(names))))
    got = licenses.report(licenses.scan(docs))
    assert multiset(got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()) == multiset(want)
    assert licenses.report(licenses.scan(empty)).count() == 0


def test_license_notice_with_changed_words(spark):
    text = "intro words here. Permission is hereby GRANTED, free of cost, to any person obtaining one copy of this software and associated files"
    got = licenses.report(licenses.scan(spark.createDataFrame([(1, text), (2, "permission to leave")], "doc_id long, text string")))
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[1].labels == "mit" and 0.6 <= rows[1].score < 1 and rows[2].labels == ""


def brute_notices(text):
    """Labels and the best score by comparing every place of a text with every notice."""
    w, names, best = corpus.plain_words(text), set(), 0.0
    for notice, label in licenses.TEMPLATES.items():
        t = notice.split()
        for i in range(len(w)):
            have = [x.encode() for x in w[i : i + len(t) + 2 * licenses.drift(len(t))]]
            share = licenses.in_order(have, [x.encode() for x in t]) / len(t)
            if share >= licenses.SHARE:
                names, best = names | {label}, max(best, share)
    return names, best


def test_license_notices_against_all_places(spark):
    """Scattered edits, words put in, and plain texts: what is found is what comparing all places finds."""
    r = __import__("random").Random(12)
    mit = next(iter(licenses.TEMPLATES)).split()
    scattered = [x if i % 4 != 2 else "changed" for i, x in enumerate(mit)]
    rows = [" ".join(scattered), " ".join([*mit[:10], "three", "new", "words", *mit[10:]]), " ".join(mit[:6]), "under the sea of the", None, ""]
    notices = list(licenses.TEMPLATES)
    for k in range(40):
        w = notices[k % len(notices)].split()
        for _ in range(r.randint(0, max(1, len(w) // 4))):
            w[r.randrange(len(w))] = "other"
        rows.append(f"{corpus.sentence(r, r.randint(0, 30))} {' '.join(w)} {corpus.sentence(r, r.randint(0, 30))}")
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for d in licenses.report(licenses.scan(df, phrases={})).collect():
        names, best = brute_notices(rows[d.doc_id])
        found = set(filter(None, d.labels.split(",")))
        # overlapping notices give way to the best one
        assert found <= names and bool(found) == bool(names) and math.isclose(d.score, best), (rows[d.doc_id], found, names, d.score, best)
    places = {s.label: (s.first, s.last, s.score) for d in licenses.scan(df).filter("doc_id < 2").collect() for s in d.spans if s.label == "mit"}
    assert places["mit"] == (0, len(mit) + 2, 1.0)


def brute_components(rows, linked):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    keys = sorted(rows)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if linked(rows[a], rows[b]):
                x, y = find(a), find(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def shingles(text):
    w = corpus.space_words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.mark.parametrize("hold", [None, 3])
def test_jaccard(docs, empty, hold, monkeypatch):
    if hold:
        monkeypatch.setattr(jaccard, "HOLD_SKETCHES", hold)
        monkeypatch.setattr(jaccard, "HOLD_SETS", hold)
    sets = {d.doc_id: shingles(d.text) for d in docs.collect() if d.doc_id is not None}
    comp = brute_components(sets, lambda a, b: a and b and 100 * len(a & b) >= 75 * len(a | b))
    got = jaccard.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), comp[r.doc_id])
    assert jaccard.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("fraction", [0.01, *jaccard.FRACTIONS])
def test_signatures_are_complete(fraction):
    """Any two similar sets share a signature: all small sizes, larger ones, pairs across bands, and the worst allowed difference."""
    rng = np.random.default_rng(5)
    cells = np.full(len(jaccard.BANDS), fraction)
    linked = 0
    for n in [*range(1, 26)] * 12 + rng.integers(26, 400, 150).tolist():
        # crowded sets have many shingles in few cells
        span = int(rng.choice([1 << 64, 1 << 58])) - 1
        a = np.unique(rng.integers(0, span, n, dtype=np.uint64))
        b = a.copy()
        worst = int(rng.integers(0, 2))
        for _ in range(n // 3 if worst else int(rng.integers(0, n // 3 + 1))):
            kind = rng.integers(0, 2)
            c = np.delete(b, rng.integers(len(b))) if kind and len(b) > 1 else np.append(b, rng.integers(0, span, 1, dtype=np.uint64))
            if worst and 4 * len(np.intersect1d(a, c)) < 3 * len(np.union1d(a, c)):
                break
            b = c
        if 4 * len(np.intersect1d(a, b)) >= 3 * len(np.union1d(a, b)):
            linked += 1
            b = np.unique(b)
            g, first = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
            sig, row, table = jaccard.signatures(g, first, cells)
            assert set(sig[row == 0].tolist()) & set(sig[row == 1].tolist()), (len(a), len(b))
            alone, _, _ = jaccard.signatures(b, np.array([0, len(b)]), cells)
            assert sorted(alone.tolist()) == sorted(sig[row == 1].tolist()) and len(table) == len(sig)
    assert linked > 250


def test_allocation_is_measured(spark, docs, empty):
    """The allocator chooses among its fractions; no choice changes the result."""
    cells = jaccard.allocate(docs, "text")
    assert set(cells) <= set(jaccard.FRACTIONS) and len(cells) == len(jaccard.BANDS)
    assert set(jaccard.allocate(empty, "text")) == {jaccard.FRACTIONS[1]}


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1000 + i + 1) for i in range(40)]
    comp = brute_components({k: k for e in edges for k in e}, lambda a, b: (a, b) in pairs or (b, a) in pairs) if (pairs := set(edges)) else {}
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(k, k) == v for k, v in comp.items())
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def check_scores(training, got, texts, model, count, n, v, c):
    """Scores from the classes alone: transitions and emissions are counted anew, token by token."""
    import pyarrow as pa

    from candlemill.llm.blocks import blocks

    known = sorted(set(count) - {"\0"} | {w for t in texts.values() for w in corpus.space_words(t)})
    cls = {"\0": 0}
    for w in known:
        b = next(iter(blocks(pa.array([w]))))
        _, codes = classlm.block_codes(b, c.buckets)
        cls[w] = int(model.classes[classlm.unit_ids(codes, model.words, model.unit, model.heads)[0]])
    steps, types = Counter(), Counter(cls[w] for w in count)
    for d in training.collect():
        t = ["\0", *corpus.space_words(d.text), "\0"]
        steps.update((cls[a], cls[b]) for a, b in zip(t, t[1:], strict=False))
    left, right = Counter(), Counter()
    for (a, b), k in steps.items():
        left[a] += k
        right[b] += k
    for r in got:
        t = ["\0", *corpus.space_words(texts[r.doc_id]), "\0"]
        total = 0.0
        for a, b in zip(t, t[1:], strict=False):
            x, y = cls[a], cls[b]
            step = (steps[x, y] + 0.5) / (left[x] + 0.5 * c.classes)
            emit = (count[b] + 0.1) / (right[y] + 0.1 * (types[y] + 1))
            total += math.log10(c.lam * step * emit + (1 - c.lam) * (count[b] + 0.1) / (n + 0.1 * (v + 1)))
        assert math.isclose(r.score, total, rel_tol=1e-9), (r.doc_id, r.score, total)


def test_best_class_is_the_likeliest():
    """A unit's move against the likelihood of every possible assignment of it."""
    r = np.random.default_rng(3)
    k, units = 4, 9
    big = r.integers(0, 6, (units, units)).astype(float)
    cls = np.array([0, *(1 + r.integers(0, k - 1, units - 1))])

    def likelihood(cls):
        n = np.zeros((k, k))
        np.add.at(n, (cls[:, None], cls[None, :]), big)
        return sum(classlm._f(n).ravel()) - sum(classlm._f(n.sum(axis=1))) - sum(classlm._f(n.sum(axis=0))), n

    before, n = likelihood(cls)
    for u in range(1, units):
        after, pre = np.zeros(k), np.zeros(k)
        np.add.at(after, cls, big[u])
        np.add.at(pre, cls, big[:, u])
        to = classlm.best_classes(cls[[u]], after[None], pre[None], np.array([big[u, u]]), n)[0]
        value = [likelihood(np.where(np.arange(units) == u, b, cls))[0] for b in range(1, k)]
        assert math.isclose(value[to - 1], max(value))


def test_class_model(docs, empty):
    training = docs.filter(fold("doc_id", 10) != 0)
    count, tokens = Counter(), lambda t: [*corpus.space_words(t), "\0"]
    for d in training.collect():
        count.update(tokens(d.text))
    n, v = sum(count.values()), len(count)
    small = classlm.Config(least=3, buckets=16, classes=6, rounds=3, fast=64)
    model, vocab = classlm.train(training, config=small)
    got = classlm.score(docs, model, vocab).collect()
    assert (model.tokens, model.types) == (n, v) and len(got) == docs.count()
    texts = {d.doc_id: d.text for d in docs.collect()}
    for r in got:
        t = tokens(texts[r.doc_id])
        assert r.n_tokens == len(t) and r.n_known == sum(count[x] > 0 for x in t) and r.train_tokens == n
        assert math.isclose(r.base_score, sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t), rel_tol=1e-9)
        assert r.score < 0
    check_scores(training, got, texts, model, count, n, v, small)
    none, words = classlm.train(empty, config=small)
    assert classlm.score(docs, none, words).count() == docs.count() and classlm.score(empty, model, vocab).count() == 0


def test_exchange_finds_alternating_classes(spark):
    r = __import__("random").Random(6)
    left, right = [f"l{i}x" for i in range(20)], [f"r{i}y" for i in range(20)]
    rows = [(" ".join(f"{r.choice(left)} {r.choice(right)}" for _ in range(50)),) for _ in range(60)]
    model, _ = classlm.train(spark.createDataFrame(rows, "text string"), config=classlm.Config(buckets=4, classes=5, rounds=8))
    import pyarrow as pa

    from candlemill.llm.blocks import blocks

    b = next(iter(blocks(pa.array([" ".join(left + right)]))))
    _, codes = classlm.block_codes(b, 4)
    cls = model.classes[model.unit[model.words.find(codes)]].tolist()
    assert not set(cls[:20]) & set(cls[20:])


def test_chat(spark):
    mark = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "user", mark), (1, 1, "assistant", mark), (2, 1, "assistant", "b"), (2, 0, None, None), (2, 1, "assistant", "b"), (None, None, "system", "\\"), (3, 0, "a\n[ROLE]b\\", "x\n")]
    rows += [(4, i, ("user", "assistant")[i % 2], f"turn {i} [OUT]") for i in range(50)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, output int")
    got = {r.conv_id: r for r in chat.digests(chat.render(df)).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    for c, r in got.items():
        mine = sorted(((t is not None, t or 0, role or "null", text or "") for k, t, role, text in rows if k == c))
        whole = "".join(f"{role}\n{text}\n" for _, _, role, text in mine)
        loss = "".join(text for _, _, role, text in mine if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(mine), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256, r.rewrote) == (len(loss), hashlib.sha256(loss.encode()).hexdigest(), False)
    assert chat.digests(chat.render(df.limit(0))).count() == 0


def chat_rows(spark, turns):
    rows = [(c, i, ("user", "assistant")[i % 2], f"turn {i} of {c}") for c in range(3) for i in range(turns if c else 4)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def numbered(turns, opening):
    return "<s>" * opening + "".join(f"{i}:[INST]{t}[/INST]" for i, (_, t) in enumerate(turns))


def forgets(turns, opening):
    return chat.instruct(turns if len(turns) <= 30 else turns[-30:], opening)


def test_chat_renders_true_prefixes(spark):
    """A template that numbers turns gets its whole prefix; one that drops turns late is flagged; so is a false declaration."""
    df = chat_rows(spark, 40)
    got = {r.conv_id: r for r in chat.render(df, numbered).collect()}
    for c, r in got.items():
        turns = [(("user", "assistant")[i % 2], f"turn {i} of {c}") for i in range(40 if c else 4)]
        assert r.output == numbered(turns, True) and not r.rewrote and r["last"] and r.run == 0
        assert [r.output[s.text_start : s.text_end] for s in r.turns] == [t for _, t in turns]
    late = {r.conv_id: r for r in chat.digests(chat.render(df, forgets)).collect()}
    assert {c: r.rewrote for c, r in late.items()} == {0: False, 1: True, 2: True} and late[1].turns_sha256 is None and late[0].n_turns == 4
    for template in (numbered, forgets):
        false = {r.conv_id: r.rewrote for r in chat.digests(chat.render(df, template, additive=True)).collect()}
        assert false == {0: False, 1: True, 2: True}, template


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("variants", [None, 1])
def test_substrings(docs, empty, variants, monkeypatch):
    if variants:
        monkeypatch.setattr(substrings, "VARIANTS", variants)
    rows = docs.collect()
    want = [(d.doc_id, *x) for d, x in zip(rows, brute_repeats([d.text for d in rows], 400), strict=True)]
    assert multiset(substrings.summary(docs).collect()) == multiset(want)
    if not variants:
        cut = substrings.remove(docs)
        assert cut.columns == [*docs.columns, "_spans"] and cut.count() == len(rows)
        assert substrings.summary(empty).count() == 0


def test_pieces(docs, empty):
    sentencepiece = pytest.importorskip("sentencepiece")
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    got = pieces.decode(pieces.encode(docs.drop("ids"))).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.ids == sp.encode(r.text or "") and r.decoded == (r.text or "")
    assert pieces.summary(empty).count() == 0
    with pytest.raises(ValueError):
        pieces.encode(docs.selectExpr("text", "1 ids"))


def test_pieces_of_unspaced_texts():
    sentencepiece = pytest.importorskip("sentencepiece")
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    rng = np.random.default_rng(7)
    letters = [*"abcdethe é日本のคง\n ", *map(chr, range(0x4E00, 0x4E40))]
    texts = ["".join(rng.choice(letters, n)) for n in rng.integers(0, 300, 200)]
    # one unit of over two million bytes, and one that no cut shortens
    texts += ["".join(rng.choice(list("日本語中国人大小"), 700_000)), "a" * 3000, "ab" * 999]
    coder = pieces.Encoder(pieces.vocabulary(pieces.default_model()))
    ids, first = coder.encode(*pieces.unmarked(pa.array(texts)))
    for i, t in enumerate(texts):
        assert ids[first[i] : first[i + 1]].tolist() == sp.encode(t)


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 8))
    v = np.concatenate([base, base[:30] + rng.normal(size=(30, 8)) * 0.15, np.repeat(base[:1], 20, axis=0)])
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)]
    bad = [(900, None, 0), (901, [], 0), (902, [0.0] * 8, 0), (903, [float("nan")] * 8, 0), (904, [float("inf")] + [1.0] * 7, 0), (905, [None] + [1.0] * 7, 0), (906, [1.0, 2.0], 0), (907, [1.0, 2.0], 0), (908, [1e-300] * 8, 0), (909, [1e300] * 8, 0)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, id int")
    good = {r[0]: np.array(r[1]) / np.max(np.abs(r[1])) for r in rows + [b for b in bad if b[0] >= 906]}
    linked = lambda a, b: len(a) == len(b) and a @ b >= 0.9 * np.sqrt((a @ a) * (b @ b))
    comp = brute_components(good, linked)
    for per in (embeddings.PER_PIVOT, 8):
        embeddings.PER_PIVOT, old = per, embeddings.PER_PIVOT
        got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
        embeddings.PER_PIVOT = old
        assert len(got) == len(rows + bad)
        for k, r in got.items():
            links = sum(linked(good[k], good[j]) for j in good if j != k) if k in good else 0
            assert (r.n_links, r.component_id, r.kept) == (links, comp.get(k, k), comp.get(k, k) == k), k
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_embedding_copies_and_repeated_ids(spark):
    """Rows of one vector link with each other; a row counts for itself, rows of one id share their component."""
    x, y, z = [1.0, 0.0], [2.0, 0.0], [0.0, 1.0]
    rows = [(i, x) for i in range(10, 40)] + [(5, y), (7, z), (7, z), (12, z), (None, x), (None, None), (3, None), (3, [1.0, 1.0]), (2, []), (2, [1.0, 1.0, 0.0]), (2, [0.0, 0.0, 1.0]), (1, [0.0, 0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()), key=str)
    want = [(i, 30, 5, False) for i in range(10, 40)] + [(5, 30, 5, True), (7, 2, 5, False), (7, 2, 5, False), (12, 2, 5, False)]
    want += [(None, 0, None, True), (None, 0, None, True), (3, 0, 3, True), (3, 0, 3, True)]
    # row 2 has no vector once, and ties two others that do not link
    want += [(2, 0, 2, True), (2, 0, 1, False), (2, 1, 1, False), (1, 1, 1, True)]
    assert got == sorted(want, key=str)


def test_language(spark, docs, empty):
    en, de = "the and of that with this was from have".split(), "und der die das nicht ein ist mit sich".split()
    r = __import__("random").Random(4)
    rows = [(i, corpus.sentence(r, 40, en if i % 2 else de), "en" if i % 2 else "de") for i in range(60)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    test = spark.createDataFrame([(1, corpus.sentence(r, 30, en)), (2, corpus.sentence(r, 30, de)), (3, corpus.sentence(r, 30, en) + " " + corpus.sentence(r, 8, de)), (4, None), (5, ""), (6, "12 34 !?"), (7, "…—"), (8, "THE AND")], "doc_id long, text string")
    got = {r.doc_id: r for r in language.identify(test, train).collect()}
    assert [got[i].lang_pred for i in range(1, 9)] == ["en", "de", "en", "und", "und", "und", "und", "en"]
    assert got[1].score > 0.99 > got[3].score > 0.5 and got[4].score == 0
    assert {r.lang_pred for r in language.identify(test, train.limit(0)).collect()} == {"und"}
    assert language.identify(empty, docs).count() == 0 and language.identify(docs, docs).count() == docs.count()


def test_language_sees_one_text_at_a_time(spark):
    """Training counts and predictions do not depend on the rows beside a text."""
    import pyarrow as pa

    from candlemill.llm.blocks import blocks

    r = __import__("random").Random(9)
    texts = ["de", "the end", "zum", "a", "", None, "é", "x y", "de", *(corpus.sentence(r, r.randint(1, 6)) for _ in range(60))]
    alone = {}
    for t in texts:
        for b in blocks(pa.array([t], pa.string())):
            alone[t] = language.trigrams(b.data, b.offsets).tolist()
    for _ in range(3):
        r.shuffle(texts)
        for b in blocks(pa.array(texts, pa.string())):
            got = language.trigrams(b.data, b.offsets)
            for i, t in enumerate(texts):
                assert got[b.offsets[i] : b.offsets[i + 1]].tolist() == alone[t], t
    rows = [(i, t, "en" if i % 3 else "de") for i, t in enumerate(texts)]
    make = lambda x, n: spark.createDataFrame(x, "doc_id long, text string, lang string").repartition(n)
    seen = [{d.doc_id: (d.lang_pred, round(d.score, 9)) for d in language.identify(make(x, n), make(x, n)).collect()} for x, n in ((rows, 1), (rows[::-1], 4), (rows, len(rows)))]
    assert seen[0] == seen[1] == seen[2]


def test_contamination(spark, docs, empty, monkeypatch):
    source = [d.text for d in docs.collect() if d.text]
    long = max(source, key=len)
    w = corpus.plain_words(long)
    items = [(0, " ".join(w[100:140])), (1, " ".join(w[100:140])), (2, "two words"), (3, None), (4, "..."), (10, " ".join(w[5:17])), (11, "not in there at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def want(text):
        w, hit, found = corpus.plain_words(text), set(), set()
        for item, t in items:
            p = corpus.plain_words(t)
            m = min(13, len(p))
            wins = {tuple(p[i : i + m]) for i in range(len(p) - m + 1)} if p else set()
            for i in range(len(w) - m + 1):
                if m and tuple(w[i : i + m]) in wins:
                    hit |= set(range(i, i + m))
                    found.add(str(item))
        return (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))

    expect = multiset((d.doc_id, *want(d.text)) for d in docs.collect())
    assert multiset(contamination.contamination(docs, bench).collect()) == expect
    several = list(contamination.parts(bench, "item_id", "text", 5))
    assert len(several) > 1
    monkeypatch.setattr(contamination, "parts", lambda *a: iter(several))
    assert multiset(contamination.contamination(docs, bench).collect()) == expect
    monkeypatch.undo()
    assert contamination.contamination(docs, bench.limit(0)).filter("n_hit > 0").count() == 0
    assert contamination.contamination(empty, bench).count() == 0


def test_fold(spark):
    rows = spark.range(50).withColumnRenamed("id", "doc_id")
    assert [r[0] for r in rows.select(fold("doc_id", 10)).collect()] == [zlib.crc32(str(i).encode()) % 10 for i in range(50)]


def test_long_merged_spans(spark):
    """Two hundred thousand words that keep hitting a notice: linear work, and the ends of the plain definition."""
    text = "under the " * 100_000 + "mit license"
    began = time.time()
    (row,) = licenses.report(licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"))).collect()
    assert row.n_words == 200_002 and time.time() - began < 60
    r = __import__("random").Random(2)
    for _ in range(500):
        want, have = ([r.choice("abcdef").encode() for _ in range(r.randint(1, n))] for n in (9, 25))
        score, lo, hi = licenses.place(have, want)
        most = licenses.in_order(have, want)
        if most < licenses.SHARE * len(want):
            assert score == 0
            continue
        inside = [(-i, j) for i in range(len(have)) for j in range(i, len(have)) if licenses.in_order(have[i : j + 1], want) == most]
        assert (score, -lo, hi) == (most / len(want), *min(inside))


def test_many_equal_rows(spark):
    """Twenty thousand rows of one id and text, and of a null id, cost what as many different ids cost."""
    r = __import__("random").Random(7)
    text = corpus.sentence(r, 900)
    n = 20_000
    took = []
    for key in ("cast(null as long)", "id", "7L"):
        df = spark.range(n).selectExpr(f"{key} as doc_id").withColumn("text", F.lit(text)).repartition(8)
        began = time.time()
        rows = substrings.summary(df).groupBy("n_removed", "n_spans").count().collect()
        took.append(time.time() - began)
        assert [tuple(x) for x in rows] == [(len(text), 1, n)]
    assert took[2] < 3 * took[1] + 20


def test_clashing_columns(spark):
    """Columns named like the operators' own inner ones are carried unchanged."""
    r = __import__("random").Random(3)
    shared = corpus.sentence(r, 120)
    names = ["_k1", "_k2", "_text", "_h", "_i", "c0", "text2", "at", "from", "anchor", "cut", "spans"]
    rows = [(i, f"{corpus.sentence(r, 30)} {shared}", *[f"keep{i}{n}" for n in names]) for i in range(6)]
    df = spark.createDataFrame(rows, ["doc_id", "text", *names])
    want = {x[0]: x[2:] for x in rows}
    bench = spark.createDataFrame([(1, shared)], "item_id long, text string")
    model = language.train(df.withColumn("lang", F.lit("en")))
    for out, own in ((substrings.remove(df), ["_spans"]), (contamination.matches(df, bench), ["_n_words", "_hits", "_items"]), (language.predict(df, model), ["lang_pred", "score"])):
        assert out.columns == [*df.columns, *own]
        assert {x.doc_id: tuple(x[n] for n in names) for x in out.collect()} == want
    # a carried column with the name of a result gives way to it
    assert contamination.matches(df.withColumn("_hits", F.lit("x")), bench).filter("size(_hits) > 0").count() == 6
    assert language.predict(df.withColumn("score", F.lit("x")), model).filter("score >= 0").count() == 6
    assert substrings.remove(df.withColumn("_spans", F.lit("x"))).filter("_spans = 1").count() == 6
