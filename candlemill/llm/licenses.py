"""License scan by diagonal voting.

Every rolling word ``K``-gram of a text is hashed and joined in Spark with the grams of the
license templates (a fixed table, so the join is a broadcast by its nature). A match at
text word i and template word j votes for the diagonal i - j. Votes are added up by text,
template and diagonal; neighbouring diagonals whose hits lie together merge into one
candidate (a word put in or left out shifts the diagonal by one; ``drift`` says how far). A candidate
needs the few votes that a place with ``SHARE`` of the template's words has even where its changed
words lie scattered (``least_votes``). It spans the whole template on each of its diagonals, and
its words, all of them, are compared with the template's: the score is the share of
template words found in order, and the span ends at the first and the last of them.

Short phrases are templates too, with exact spans: a phrase stands where all of its
grams vote on one diagonal, and the words there are compared.

The gram rows never leave their task; hits (few) are shuffled by text, and the texts meet
their spans in one join on a row key. No group is gathered: votes are aggregates and
the merge is a window over a text's own diagonals.

Defined cases: null or empty texts have no words; texts shorter than a phrase match
nothing; repeated rows are scanned alike and returned each; an empty table gives no rows;
overlapping places all count; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlemill.llm.blocks import ALNUM_WORD, U, blocks, gram_hashes, hash_word, signed, span_hashes, split_words, words
from candlemill.llm.jobs import keep, row_key

K = 2
#: Least share of a template's words that a verified span has, in order.
SHARE = 0.6


def drift(size: int) -> int:
    """Words that may be put in or left out between two parts of a notice."""
    return max(2, size // 4)


def least_votes(size: int) -> int:
    """Each of the (1 - SHARE) * size changed words spoils two of a place's size - 1 grams at most."""
    return max(1, size - (K - 1) - K * math.floor((1 - SHARE) * size))


# Phrases (exact) and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# License notices (approximate) and their labels.
TEMPLATES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "released under the mit license": "mit",
    "licensed under the apache license version 2 0 you may not use this file except in compliance with the license": "apache-2.0",
    "licensed under the apache license version 2 0": "apache-2.0",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "this work is licensed under the gnu general public license version 3": "gpl",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "licensed under a creative commons attribution license": "cc",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "no part of this publication may be reproduced without permission": "proprietary",
}


def templates(phrases: dict[str, str], notices: dict[str, str]) -> list[tuple[list[bytes], str, bool]]:
    """(words, label, exact) of every template; its index names it."""
    return [(split_words(t, ALNUM_WORD), label, exact) for table, exact in ((phrases, True), (notices, False)) for t, label in table.items()]


def template_grams(found: list[tuple[list[bytes], str, bool]]) -> list[tuple[int, int, int]]:
    """(gram, template, position) rows."""
    out = []
    for t, (w, _, _) in enumerate(found):
        h = np.array([hash_word(x) for x in w], dtype=U)
        out += [(int(g), t, j) for j, g in enumerate(signed(gram_hashes(h, K)))]
    return out


def rolling_grams(docs: DataFrame, text: str) -> DataFrame:
    """(_k1, _k2, at, gram): one row for each ``K`` consecutive words of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy() for i in range(2))
            for b in blocks(batch.column(2)):
                w = words(b, ALNUM_WORD)
                g = gram_hashes(span_hashes(b.data, w.start, w.end), K)
                if not len(g):
                    continue
                row = w.row[: len(g)]
                ok = row == w.row[K - 1 :]
                row, at = row[ok], (np.arange(len(g)) - w.first[row])[ok]
                g = g[ok]
                for i in range(0, len(g), 65536):
                    s = slice(i, i + 65536)
                    yield pa.RecordBatch.from_arrays([pa.array(k1[b.first + row[s]]), pa.array(k2[b.first + row[s]]), pa.array(at[s].astype(np.int32)), pa.array(signed(g[s]))], names=["_k1", "_k2", "at", "gram"])

    return docs.select("_k1", "_k2", text).mapInArrow(run, "_k1 long, _k2 long, at int, gram long")


def spans(docs: DataFrame, found: list[tuple[list[bytes], str, bool]], text: str) -> DataFrame:
    """(_k1, _k2, spans): candidate spans of a text, as (template, first word, last word)."""
    spark = docs.sparkSession
    table = spark.createDataFrame(template_grams(found), "gram long, template int, place int").coalesce(1)
    shape = spark.createDataFrame([(t, len(w), e, drift(len(w)), least_votes(len(w))) for t, (w, _, e) in enumerate(found)], "template int, size int, exact boolean, drift int, least int").coalesce(1)
    # both sides are fixed tables of this module or of the caller's arguments
    hits = rolling_grams(docs, text).join(F.broadcast(table), "gram").select("_k1", "_k2", "template", (F.col("at") - F.col("place")).alias("diagonal"), "at")
    # a place of equal rows votes once; written down, as both kinds of templates use the votes
    votes = keep(hits.groupBy("_k1", "_k2", "template", "diagonal").agg(F.size(F.collect_set("at")).alias("votes"), F.min("at").alias("lo"), F.max("at").alias("hi")).join(F.broadcast(shape), "template"), "votes")
    phrases = votes.filter(F.col("exact") & (F.col("votes") == F.col("size") - (K - 1))).select("_k1", "_k2", "template", F.col("diagonal").alias("first"), (F.col("diagonal") + F.col("size") - 1).alias("last"))
    side = Window.partitionBy("_k1", "_k2", "template").orderBy("diagonal", "lo")
    near = (F.col("diagonal") - F.lag("diagonal").over(side) <= F.col("drift")) & (F.col("lo") - F.lag("hi").over(side) <= F.col("size"))
    merged = (
        votes.filter(~F.col("exact")).withColumn("run", F.sum(F.when(near, 0).otherwise(1)).over(side))
        .groupBy("_k1", "_k2", "template", "size", "least", "run").agg(F.sum("votes").alias("votes"), F.min("diagonal").alias("first"), (F.max("diagonal") + F.col("size") - 1).alias("last"))
        .filter(F.col("votes") >= F.col("least")).select("_k1", "_k2", "template", "first", "last")
    )
    return phrases.unionByName(merged).groupBy("_k1", "_k2").agg(F.collect_list(F.struct("template", "first", "last")).alias("spans"))


def in_step(have: Iterable[bytes], want: Sequence[bytes]) -> Iterator[int]:
    """After each word of ``have``: the longest common subsequence of the words so far with ``want``.

    The row of the usual table is kept as its steps, a bit for each word of ``want``, so a word costs one addition.
    """
    places: dict[bytes, int] = {}
    for j, y in enumerate(want):
        places[y] = places.get(y, 0) | 1 << j
    full = (1 << len(want)) - 1
    flat, n = full, 0
    for x in have:
        hit = flat & places.get(x, 0)
        if hit:
            flat = ((flat + hit) | (flat - hit)) & full
            n = len(want) - flat.bit_count()
        yield n


def in_order(have: Sequence[bytes], want: Sequence[bytes]) -> int:
    """Longest common subsequence of two word lists."""
    n = 0
    for n in in_step(have, want):  # noqa: B007
        pass
    return n


def place(have: list[bytes], want: list[bytes]) -> tuple[float, int, int]:
    """(share of the template's words in order, first and last word of ``have`` that it takes): three passes over ``have``."""
    if sum((Counter(have) & Counter(want)).values()) < SHARE * len(want):
        return 0.0, 0, 0
    most = in_order(have, want)
    if most < SHARE * len(want):
        return 0.0, 0, 0
    # the latest first word, then the earliest last one
    lo = len(have) - 1 - next(k for k, n in enumerate(in_step(reversed(have), want[::-1])) if n == most)
    hi = lo + next(k for k, n in enumerate(in_step(have[lo:], want)) if n == most)
    return most / len(want), lo, hi


def best(found: list[dict]) -> list[dict]:
    """All phrases, and of notices that overlap the one with the highest score (then the earlier template)."""
    out = [s for s in found if s["exact"]]
    for s in sorted((s for s in found if not s["exact"]), key=lambda s: (-s["score"], s["template"], s["first"])):
        if all(s["last"] < o["first"] or o["last"] < s["first"] for o in out if not o["exact"]):
            out.append(s)
    return out


_OUT = "doc_id long, n_words long, spans array<struct<template:int,label:string,exact:boolean,first:int,last:int,score:double>>"


def verified(docs: DataFrame, candidates: DataFrame, found: list[tuple[list[bytes], str, bool]], text: str) -> DataFrame:
    """(doc_id, n_words, spans): spans whose words were compared with the template's."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_schema(_parse_datatype_string(_OUT)).field("spans").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans_of = batch.column(2)
            for b in blocks(batch.column(1)):
                w = words(b, ALNUM_WORD)
                out: list[list[dict]] = []
                for i, cand in enumerate(spans_of.slice(b.first, b.rows).to_pylist()):
                    good = []
                    for c in cand or ():
                        want, label, exact = found[c["template"]]
                        begin, end = max(c["first"], 0), min(c["last"], int(w.counts[i]) - 1)
                        s = slice(int(w.first[i]) + begin, int(w.first[i]) + end + 1)
                        have = [b.data[p:q].tobytes() for p, q in zip(w.start[s], w.end[s], strict=True)]
                        score, lo, hi = (float(have == want), 0, len(have) - 1) if exact else place(have, want)
                        if score >= SHARE:
                            good.append({"template": c["template"], "label": label, "exact": exact, "first": begin + lo, "last": begin + hi, "score": score})
                    out.append(best(good))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(b.first, b.rows), pa.array(w.counts, pa.int64()), pa.array(out, kind)], names=["doc_id", "n_words", "spans"])

    whole = docs.join(candidates, ["_k1", "_k2"], "left")
    return whole.select(F.col("doc_id").cast("long"), text, "spans").mapInArrow(run, _OUT)


def scan(docs: DataFrame, text: str = "text", phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, n_words, spans) for every row: verified license spans with labels and scores."""
    found = templates(PHRASES if phrases is None else phrases, TEMPLATES if notices is None else notices)
    keyed = row_key(docs.select("doc_id", text), "doc_id", text)
    return verified(keyed, spans(keyed, found, text), found, text)


def report(scanned: DataFrame) -> DataFrame:
    """Per document: places and labels of the phrases, all labels, and the best score."""
    base = F.filter("spans", lambda s: s["exact"])
    starts = F.transform(base, lambda s: s["first"].cast("long"))
    labels = lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda s: s["label"]))), ",")
    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"),
    )
