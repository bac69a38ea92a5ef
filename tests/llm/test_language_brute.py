"""The language mixture against loops over single texts: trigrams, model, expectation-maximisation, and the choice of the set."""

import math
import random
from collections import Counter, defaultdict

from candlemill.llm import language

from . import corpus


def buckets(text):
    """Bucket of the trigram at each byte; other bytes than letters and those past the end are one space."""
    raw = (text or "").encode()
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in raw)
    x = [c if 0x61 <= c <= 0x7A or c >= 0x80 else 32 for c in raw] + [32, 32]
    out = []
    for i in range(len(raw)):
        h = (x[i] * 0x9E3779B1 + x[i + 1] * 0x85EBCA77 + x[i + 2] * 0xC2B2AE3D) % 2**32
        h = (h ^ (h >> 15)) * 0x2C1B3C6D % 2**32
        out.append(h >> 18)
    return out


def learned(rows):
    counts = defaultdict(Counter)
    for _, text, lang in rows:
        if text is not None and lang is not None:
            counts[lang].update(buckets(text))
    names = sorted(lang for lang, c in counts.items() if c)
    return names, {n: (counts[n], math.log(sum(counts[n].values()) + 0.5 * language.BUCKETS)) for n in names}


def proportions(text, names, model):
    b = buckets(text)
    parts = [b[i : i + language.SEGMENT] for i in range(0, len(b), language.SEGMENT)]
    likes = []
    for part in parts:
        score = [sum(math.log(model[n][0][k] + 0.5) - model[n][1] for k in part) for n in names]
        likes.append([math.exp(max(s - max(score), -60.0)) for s in score])

    def step(p):
        new, ll = [0.0] * len(names), 0.0
        for like in likes:
            z = max(sum(a * q for a, q in zip(like, p, strict=True)), 1e-300)
            ll += math.log(z)
            for i, (a, q) in enumerate(zip(like, p, strict=True)):
                new[i] += a * q / z
        return [x / len(likes) for x in new], ll

    p = [1.0 / len(names)] * len(names)
    for _ in range(12):
        p, _ = step(p)
    while sum(x > 0 for x in p) > 1:
        weakest = min((x, i) for i, x in enumerate(p) if x > 0)[1]
        cut = [0.0 if i == weakest else x for i, x in enumerate(p)]
        cut = [x / max(sum(cut), 1e-300) for x in cut]
        for _ in range(2):
            cut, ll_cut = step(cut)
        _, ll = step(p)
        if ll - ll_cut >= math.log(len(likes) + 1):
            break
        p = cut
    return p


def test_mixture_against_loops(spark):
    r = random.Random(21)
    vocab = {n: ["".join(r.choice(s) for _ in range(r.randint(2, 7))) for _ in range(60)] for n, s in (("aa", "abcdeinost"), ("bb", "eghklmrtuw"), ("cc", "aioruvzxjé"), ("dd", "äöüßnstrei"))}
    say = lambda n, k: corpus.sentence(r, k, vocab[n])
    rows = [(i, say(n, r.randint(3, 80)), n) for i, n in enumerate(list(vocab) * 12)]
    mixed = [" ".join(say(n, r.randint(1, 40)) for n in r.sample(list(vocab), r.randint(1, 4))) for _ in range(40)]
    texts = [*mixed, *(t for _, t, _ in rows[:10]), "", None, "12 !? 34", "…", "a", "É", mixed[0].upper(), mixed[0], say("aa", 400) + " 123 " + say("bb", 90)]
    train = spark.createDataFrame([*rows, (900, None, "aa"), (901, "no language", None)], "doc_id long, text string, lang string").repartition(3)
    test = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    names, model = learned(rows)
    for d in language.identify(test, train).collect():
        text = texts[d.doc_id]
        if not any(c.isalpha() for c in text or ""):
            assert (d.lang_pred, d.score) == ("und", 0.0), text
            continue
        p = proportions(text, names, model)
        best = max(range(len(p)), key=lambda i: (p[i], -i))
        assert d.lang_pred == names[best] and abs(d.score - min(1.0, max(p))) < 1e-3, (text, d, p)
