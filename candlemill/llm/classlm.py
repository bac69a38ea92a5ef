"""Brown class-based n-gram model: exchange clustering, class transitions, word emissions.

    log10 p(w | v) = log10( lam * p(class w | class v) * p(w | class w) + (1 - lam) * p(w) )

Clustered units are all words of the broadcast table (the ``fast`` most frequent ones) that occur
``least`` times or more, up to ``heads`` of them if that is given; every other word stands in its suffix bucket, a
unit as well, so rare and unseen words have a class. Unit bigrams are counted over all training rows,
brought together by each of their two units in one exchange and written down once. In a round each
task sums those of its units by class and moves them (half of them in a round) to the class that raises
the likelihood most while the others stand still; the driver sees the class of each unit and the class bigrams only. The
round with the highest likelihood counts.

Word counts are complete: the ``fast`` most frequent go to the tasks as a table of fixed
size, all others meet their counts in a shuffle join on the word's 64-bit hash. What
is gathered from the corpus is therefore one row for each distinct word, and grows with it.

Defined cases: a null text is empty (its only token is the end); without training rows
N = V = 0 and all is smoothing; ties in counts go by hash; repeated rows get their row
each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlemill.llm.blocks import SPACE_WORD, Block, Lookup, Tally, U, Words, blocks, mix, signed, span_hashes, summed, words
from candlemill.llm.jobs import keep, row_key, spread

#: The end of a text, as a word hash.
END = 0x5A17E6D00D5EED01
SMOOTH = 0.1


@dataclass
class Config:
    heads: int | None = None
    least: int = 10
    buckets: int = 512
    classes: int = 48
    rounds: int = 8
    fast: int = 1 << 18
    lam: float = 0.95


@dataclass
class Model:
    config: Config
    heads: int
    words: Lookup
    counts: np.ndarray
    unit: np.ndarray
    classes: np.ndarray
    log_step: np.ndarray
    tokens: int
    types: int
    ends: int


def suffix_bucket(block: Block, w: Words, buckets: int) -> np.ndarray:
    """Bucket of a word's last two bytes."""
    a = block.data[w.end - 1].astype(U)
    b = np.where(w.end - w.start > 1, block.data[np.maximum(w.end - 2, 0)], 0).astype(U)
    return (mix(a * U(257) + b) % U(buckets)).astype(np.int64)


def word_counts(docs: DataFrame, text: str, buckets: int) -> DataFrame:
    """(word, bucket, n): every distinct word of the corpus, counted; sums are taken in the task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, ends = Tally(), 0

        def out(h: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(h), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(h[i : i + 100_000].view(np.int64)), pa.array(n[i : i + 100_000].astype(np.int64))], names=["word", "n"])

        for batch in batches:
            ends += len(batch)
            for b in blocks(batch.column(0)):
                w = words(b, SPACE_WORD)
                h = span_hashes(b.data, w.start, w.end)
                tally.add(pack(h, suffix_bucket(b, w, buckets)))
                if (full := tally.take_if_large()) is not None:
                    yield from out(*full)
        yield from out(*tally.merged())
        if ends:
            yield from out(np.array([END], U), np.array([ends]))

    return docs.select(text).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


#: Low bits of a word code that hold its suffix bucket.
BUCKET_BITS = 10


def pack(h: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """A word's code: 54 bits of hash, 10 of suffix bucket."""
    return (h & ~U((1 << BUCKET_BITS) - 1)) | bucket.astype(U)


def unit_ids(codes: np.ndarray, model_words: Lookup, unit: np.ndarray, heads: int) -> np.ndarray:
    at = model_words.find(codes)
    u = np.where(at >= 0, unit[np.maximum(at, 0)], 0) if len(unit) else np.zeros(len(codes), np.int64)
    return np.where(u > 0, u, 1 + heads + (codes & U((1 << BUCKET_BITS) - 1)).astype(np.int64))


def block_codes(b: Block, buckets: int) -> tuple[Words, np.ndarray]:
    w = words(b, SPACE_WORD)
    return w, pack(span_hashes(b.data, w.start, w.end), suffix_bucket(b, w, buckets))


def with_ends(units: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(previous unit, unit, row starts) with the end (unit 0) after each row, and before it."""
    rows = len(first) - 1
    seq = np.zeros(len(units) + rows, np.int64)
    row = np.repeat(np.arange(rows), np.diff(first))
    seq[np.arange(len(units)) + row] = units
    starts = first[:-1] + np.arange(rows)
    prev = np.concatenate([[0], seq[:-1]])
    prev[starts] = 0
    return prev, seq, starts


#: Units that travel together, and entries of a kept row, which holds whole units.
GROUP, ENTRIES = 64, 65536


def _packed(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """The values of each run that begins at ``first``, as one binary value."""
    at = np.append(first, len(values)) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def unit_bigrams(docs: DataFrame, text: str, heads: tuple[np.ndarray, np.ndarray], c: Config) -> DataFrame:
    """(part, own, other, n): unit bigrams as each task sums them, from both of their units. ``own`` is twice
    a unit for what follows it, and one more for what it follows; a part has GROUP units or some more."""
    shared = docs.sparkSession.sparkContext.broadcast(heads)
    clustered = len(heads[0])
    units = 1 + clustered + c.buckets
    parts = max(1, units // GROUP)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, unit = shared.value
        table, tally = Lookup(keys), Tally(1_000_000)

        def out(k: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for side, (u, v) in enumerate((np.divmod(k, units), np.divmod(k, units)[::-1])):
                order = np.argsort((u % parts * units + u) * units + v, kind="stable")
                u, v = u[order], v[order]
                part = (u % parts).astype(np.int32)
                first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])[: len(part)])
                arrays = ((2 * u + side).astype(np.int32), v.astype(np.int32), n[order].astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(part[first]), *(_packed(x, first) for x in arrays)], names=["part", "own", "other", "n"])

        for batch in batches:
            for b in blocks(batch.column(0)):
                w, codes = block_codes(b, c.buckets)
                prev, seq, _ = with_ends(unit_ids(codes, table, unit, clustered), w.first)
                tally.add(prev * units + seq)
                if (full := tally.take_if_large()) is not None:
                    yield from out(*full)
        yield from out(*tally.merged())

    return docs.select(text).mapInArrow(run, "part int, own binary, other binary, n binary")


_NEIGHBOURS = "unit binary, follow binary, v binary, n binary, precede binary, w binary, m binary"


def neighbours(bigrams: DataFrame, units: int) -> DataFrame:
    """Rows of whole units, each unit in one row: how many units follow it, those (``v``, ``n`` times), how many
    precede it, and those (``w``, ``m`` times). Made by one exchange; rounds need no other. A task holds
    one part's distinct bigrams, which the model's size bounds."""

    def rows(codes: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        own, other = np.divmod(codes, units)
        first = np.flatnonzero(np.concatenate([[True], own[1:] >> 1 != own[:-1] >> 1]))
        cuts = np.append(first[np.concatenate([[True], np.diff(first // ENTRIES) > 0])], len(own))
        for s in (slice(*x) for x in zip(cuts[:-1], cuts[1:], strict=True)):
            unit, at = np.unique(own[s] >> 1, return_inverse=True)
            before = (own[s] & 1).astype(bool)
            out = [unit.astype(np.int32)]
            for side in (~before, before):
                out += [np.bincount(at[side], minlength=len(unit)).astype(np.int32), other[s][side].astype(np.int32), n[s][side].astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in out], names=[x.split()[0] for x in _NEIGHBOURS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size, base = None, [], 0, 0
        for batch in batches:
            for i, p in enumerate(batch.column(0).to_pylist()):
                if p != part and held:
                    yield from rows(*summed(held))
                    held, size, base = [], 0, 0
                own, other, n = (_ints(batch, j, i, np.int32).astype(np.int64) for j in (1, 2, 3))
                part, size = p, size + len(n)
                held.append((own * units + other, n))
                if size > 2 * base + 1_000_000:
                    held = [summed(held)]
                    size = base = len(held[0][0])
        if held:
            yield from rows(*summed(held))

    return spread(bigrams, None, "part").sortWithinPartitions("part").mapInArrow(run, _NEIGHBOURS)


def _ints(batch: pa.RecordBatch, column: int, row: int, dtype: type) -> np.ndarray:
    return np.frombuffer(batch.column(column)[row].as_buffer(), dtype)


def _f(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def class_bigrams(pairs: DataFrame, cls: np.ndarray, c: Config) -> np.ndarray:
    shared = pairs.sparkSession.sparkContext.broadcast(cls)
    k = c.classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, n = shared.value, np.zeros(k * k, np.int64)
        for batch in batches:
            for i in range(len(batch)):
                unit, follow, v = (_ints(batch, j, i, np.int32) for j in range(3))
                # sums in double precision are exact below 2^53
                n += np.bincount(np.repeat(of[unit] * k, follow) + of[v], _ints(batch, 3, i, np.int64), k * k).astype(np.int64)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], names=["code", "n"])

    out = np.zeros(k * k)
    for r in pairs.select("unit", "follow", "v", "n").mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
        out[r.code] = r.n
    return out.reshape(k, k)


def exchange(bigrams: DataFrame, units: int, c: Config) -> tuple[np.ndarray, np.ndarray]:
    """(class of each unit, class bigram counts) by exchange rounds over the units' neighbours."""
    k = c.classes
    pairs = keep(neighbours(bigrams, units), "neighbours")
    half = bigrams.sparkSession.range(units).select(F.pmod(F.hash(F.col("id").cast("int")), F.lit(2)).alias("half"), "id").toArrow().sort_by("id").column("half").to_numpy()
    cls = np.where(np.arange(units) == 0, 0, 1 + np.arange(units) % (k - 1))
    best = (-np.inf, cls, np.zeros((k, k)))
    for step in range(c.rounds + 1):
        n = class_bigrams(pairs, cls, c)
        gain = _f(n).sum() - _f(n.sum(axis=1)).sum() - _f(n.sum(axis=0)).sum()
        if gain > best[0]:
            best = (gain, cls, n)
        if step == c.rounds:
            break
        moved = moves(pairs, cls, n, half == step % 2, c).toArrow()
        cls = cls.copy()
        cls[moved.column("unit").to_numpy()] = moved.column("to").to_numpy()
    return best[1], best[2]


def moves(pairs: DataFrame, cls: np.ndarray, n: np.ndarray, turn: np.ndarray, c: Config) -> DataFrame:
    """(unit, to): units whose turn it is and that gain by another class, and the class; all others stand still."""
    shared = pairs.sparkSession.sparkContext.broadcast((cls, n, turn & (np.arange(len(cls)) > 0)))
    k = c.classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, classes, may = shared.value
        for batch in batches:
            for i in range(len(batch)):
                unit = _ints(batch, 0, i, np.int32)
                some, tables = may[unit], []
                if not some.any():
                    continue
                for j in (1, 4):
                    at = np.repeat(np.arange(len(unit)), _ints(batch, j, i, np.int32))
                    other, count = _ints(batch, j + 1, i, np.int32), _ints(batch, j + 2, i, np.int64)
                    tables.append(np.bincount(at * k + of[other], count, len(unit) * k).reshape(-1, k)[some])
                    if j == 1:
                        same = np.bincount(at, np.where(other == unit[at], count, 0), len(unit))[some]
                unit = unit[some]
                to = best_classes(of[unit], *tables, same, classes)
                go = to != of[unit]
                yield pa.RecordBatch.from_arrays([pa.array(unit[go]), pa.array(to[go].astype(np.int32))], names=["unit", "to"])

    return pairs.mapInArrow(run, "unit int, to int")


def _gains(own: np.ndarray, after: np.ndarray, before: np.ndarray, same: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What each class's row of counts gains by the unit's followers, the class itself left out: over the classes that do follow the unit."""
    o = after.copy()
    o[np.arange(len(own)), own] -= same
    u, c = np.nonzero(o)
    at, a = np.arange(len(u)), own[u]
    m, fm = n.T[c], _f(n).T[c]
    # the unit's own counts are taken out of its class
    m[at, a] -= after[u, c]
    home = np.flatnonzero(c == a)
    m[home] -= before[u[home]]
    m[home, a[home]] += same[u[home]]
    np.maximum(m, 0, out=m)
    fm[at, a], fm[home] = _f(m[at, a]), _f(m[home])
    more = _f(m + o[u, c][:, None]) - fm
    more[at, c] = 0
    out = np.zeros(after.shape)
    some, first = np.unique(u, return_index=True)
    if len(some):
        out[some] = np.add.reduceat(more, first, axis=0)
    return out


def best_classes(own: np.ndarray, after: np.ndarray, before: np.ndarray, same: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The class of greatest likelihood for each of some units, alone; its own class where no other is better."""
    u = np.arange(len(own))
    gain = _gains(own, after, before, same, n) + _gains(own, before, after, same, n.T)
    o, i = after.copy(), before.copy()
    o[u, own] -= same
    i[u, own] -= same
    # what stands before the unit counts in its class's row wherever the unit goes, and alike for columns
    left, right = n.sum(axis=1) - before + i, n.sum(axis=0) - after + o
    left[u, own] += same - after.sum(axis=1)
    right[u, own] += same - before.sum(axis=1)
    d = np.repeat(n.diagonal()[None], len(own), axis=0)
    d[u, own] -= after[u, own] + before[u, own] - same
    np.maximum(d, 0, out=d)
    more_o, more_i = (o.sum(axis=1) + same)[:, None], (i.sum(axis=1) + same)[:, None]
    gain += _f(d + o + i + same[:, None]) - _f(d)
    gain -= _f(left + more_o) - _f(left) + _f(right + more_i) - _f(right)
    gain[:, 0] = -np.inf
    to = gain.argmax(axis=1)
    return np.where(gain[u, to] > gain[u, own] + 1e-9, to, own)


def train(docs: DataFrame, text: str = "text", config: Config | None = None) -> tuple[Model, DataFrame]:
    """The model, and the table of all word counts (word, n) it was made with."""
    c = config or Config()
    if c.buckets > 1 << BUCKET_BITS:
        raise ValueError("too many suffix buckets")
    vocab = keep(word_counts(docs, text, c.buckets), "vocab")
    level = F.floor(F.log2("n") * 8)
    total = vocab.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"), F.max(F.when(F.col("word") == signed(np.array([END], U))[0].item(), F.col("n"))).alias("e")).first()
    tokens, types, ends = total.n or 0, total.v, total.e or 0
    # frequent words down to the lowest level at which they still fit; at most a few hundred levels
    levels = vocab.groupBy(level.alias("l")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("l")).collect()
    low, sofar = None, 0
    for r in levels:
        if sofar + r.k > c.fast:
            break
        low, sofar = r.l, sofar + r.k
    found = vocab.filter(level >= low).toPandas() if low is not None else None
    keys = found.word.to_numpy().view(U) if found is not None and len(found) else np.zeros(0, U)
    counts = found.n.to_numpy() if found is not None and len(found) else np.zeros(0, np.int64)
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    unit = np.zeros(len(keys), np.int32)
    top = np.lexsort((keys, -counts))
    top = top[(keys[top] != U(END)) & (counts[top] >= c.least)][: c.heads]
    unit[top] = np.arange(1, len(top) + 1)
    bigrams = unit_bigrams(docs, text, (keys[np.sort(top)], unit[np.sort(top)]), c)
    heads = len(top)
    cls, n = exchange(bigrams, 1 + heads + c.buckets, c)
    # types of a class: its clustered words, and the words of its suffix buckets
    mask = (1 << BUCKET_BITS) - 1
    by_bucket = vocab.filter(F.col("word") != signed(np.array([END], U))[0].item()).groupBy(F.col("word").bitwiseAND(F.lit(mask)).alias("b")).agg(F.count(F.lit(1)).alias("k")).collect()
    size = np.zeros(c.classes)
    for r in by_bucket:
        if r.b < c.buckets:
            size[cls[1 + heads + r.b]] += r.k
    np.add.at(size, cls[1 + heads + (keys[top] & U(mask)).astype(np.int64)], -1)
    np.add.at(size, cls[unit[top]], 1)
    size[0] = 1
    size = np.maximum(size, 0)
    step = (n + 0.5) / (n.sum(axis=1, keepdims=True) + 0.5 * c.classes)
    emit = n.sum(axis=0) + SMOOTH * (size + 1)
    log_step = np.log10(c.lam * step / emit + (1 - c.lam) / (tokens + SMOOTH * (types + 1)))
    return Model(c, heads, Lookup(keys), counts, unit, cls, log_step, tokens, types, ends), vocab


_OUT = "_k1 long, _k2 long, doc_id long, n_tokens long, n_known long, head double, steps double, tail array<long>"


def walk(docs: DataFrame, model: Model, text: str) -> DataFrame:
    """Per row: sums over tokens the model's table knows, class steps, and the other words' hashes."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        log_count = np.log10(m.counts + SMOOTH) if len(m.counts) else np.zeros(1)
        for batch in batches:
            for b in blocks(batch.column(3)):
                w, codes = block_codes(b, m.config.buckets)
                at = m.words.find(codes)
                know = at >= 0
                units = np.where(know, m.unit[np.maximum(at, 0)], 0) if len(m.unit) else np.zeros(len(codes), np.int64)
                units = np.where(units > 0, units, 1 + m.heads + (codes & U((1 << BUCKET_BITS) - 1)).astype(np.int64))
                prev, seq, starts = with_ends(units, w.first)
                steps = np.add.reduceat(m.log_step[m.classes[prev], m.classes[seq]], starts)
                head = np.concatenate([[0.0], np.cumsum(np.where(know, log_count[np.maximum(at, 0)], 0.0))])
                known = np.concatenate([[0], np.cumsum(know)])
                offs = (w.first - known[w.first]).astype(np.int32)
                cut = [batch.column(i).slice(b.first, b.rows) for i in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *cut, pa.array(w.counts + 1, pa.int64()), pa.array(known[w.first[1:]] - known[w.first[:-1]] + (m.ends > 0), pa.int64()),
                        pa.array(head[w.first[1:]] - head[w.first[:-1]] + np.log10(m.ends + SMOOTH)), pa.array(steps),
                        pa.ListArray.from_arrays(offs, pa.array(signed(codes[~know]))),
                    ],
                    names=[x.split()[0] for x in _OUT.split(", ")],
                )

    return docs.select("_k1", "_k2", F.col("doc_id").cast("long"), text).mapInArrow(run, _OUT)


def score(docs: DataFrame, model: Model, vocab: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    walked = keep(walk(row_key(docs.select("doc_id", text), "doc_id", text), model, text), "walked")
    rare = walked.filter(F.size("tail") > 0).select("_k1", "_k2", F.explode("tail").alias("word"))
    sums = (
        rare.join(vocab, "word", "left").groupBy("_k1", "_k2")
        .agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + SMOOTH)).alias("rare"), F.count("n").alias("seen"), F.count(F.lit(1)).alias("words"))
    )
    whole = walked.withColumn("_t", F.size("tail")).drop("tail").join(sums, ["_k1", "_k2"], "left")
    # repeated rows share a key: their sums hold every copy's words
    copies = F.col("words") / F.col("_t")
    s = F.col("head") + F.coalesce(F.col("rare") / copies, F.lit(0.0))
    base = np.log10(model.tokens + SMOOTH * (model.types + 1)).item()
    return whole.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce(F.col("seen") / copies, F.lit(0))).cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"), (s - F.col("n_tokens") * base).alias("base_score"), (s + F.col("steps")).alias("score"),
    )
