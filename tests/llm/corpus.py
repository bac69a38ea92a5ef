"""A small corpus with the awkward cases: null, empty and long texts, copies, near copies, clashing columns."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, _lang string, spans int"
WORDS = [a + b + c for a in ("th", "er", "an", "ou") for b in ("in", "ti", "ea", "s") for c in ("e", "on", "", "ly")]


def sentence(r: random.Random, n: int, words=WORDS) -> str:
    return " ".join(r.choice(words) for _ in range(n))


def rows(seed: int = 1) -> list[tuple]:
    r = random.Random(seed)
    base = [sentence(r, r.randint(1, 120)) for _ in range(40)]
    texts: list[str | None] = [None, "", " ", "\n\t", "one", "two words", "a b c d", "A b C d", "a b c d e", *base, *base[:8]]
    long = sentence(r, 4000)
    texts += [long, long + " tail", "x" * 3000, "=" * 1500, "é龘ß " * 300, "CC BY all rights reserved. General Public License!"]
    for b in base[:12]:  # near copies: a word changed
        w = b.split()
        w[len(w) // 2] = "changed"
        texts += [" ".join(w), b + " more"]
    shared = sentence(r, 90)
    texts += [f"{sentence(r, 20)} {shared} {sentence(r, 20)}" for _ in range(10)]
    out = [(i, t, None if i % 7 == 0 else "en", f"src{i % 3}", len(t or ""), "clash", "clash", 3) for i, t in enumerate(texts)]
    return [*out, out[12], out[12], (None, "no id here at all", "en", "s", 1, "c", "c", 1)]


def lower(s: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


def space_words(s: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", lower(s))


def plain_words(s: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(s))
