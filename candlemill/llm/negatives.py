"""Hard-negative mining over rotated one-bit codes with exact intervals.

Vectors become integers, floor(scale * x), and are rotated by random signs and the integer Walsh-Hadamard
transform, under which inner products grow by exactly P (the padded length). The index keeps of every
row one-bit codes: the signs of the rotated vector, of what they leave, and so on for ``LEVELS`` levels,
each with its alignment (the mean size along the code) and the length of what is left after it.

For an anchor, whose rotated components are cut into ``PLANES`` bit planes, popcounts of planes and codes
give its inner product with a row's code. By Cauchy-Schwarz the rest is at most the length of what the
codes leave times the length of the anchor's part off the last code, so every score has an interval that
surely holds it. A pair goes on to the next level while its interval reaches above what the anchor's
list asks for, and pairs left after the last level are scored in integers. Nothing is estimated in results.

Positives (the first of the same label) are mined first; each anchor then looks for negatives in the
windows that its positives' scores set. Both searches deal the rows into blocks of bounded size by hash,
send every anchor (one in a hundred rows) to every block, and hold one block a task; a block returns at
most a list's length for each anchor and window, and lists are merged by Spark.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component, take no part;
vectors of different lengths are extended by zeros; the anchor's own id is never its positive; an anchor
repeated in full is one anchor, other repeated rows are candidates of their own; an anchor without
positives gives no rows, nor does a positive without a negative in its window (a score below zero has
none); an empty table gives no rows. Integers beyond 2^26 / sqrt(P) in size are a ValueError (at 64 dimensions:
components beyond 32,768), so that scores stay below 2^53.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlemill.llm.integers import floors, padded, power_of_two, walsh_hadamard
from candlemill.llm.jobs import keep

#: One-bit codes of a row, and bit planes of an anchor.
LEVELS = 4
PLANES = 8
#: Components of the rows that one task holds.
BLOCK_COMPONENTS = 1 << 20
#: Anchors and rows whose intervals are taken side by side.
ANCHORS, TILE = 64, 4096
#: Pairs scored at once.
PAIRS = 1 << 15
#: Relative room for the rounding of intervals.
SLACK = 1e-9
NONE = np.iinfo(np.int64).min


def rotated(q: np.ndarray, wide: int) -> np.ndarray:
    """Random signs (fixed), then the transform: integers, inner products times ``wide``."""
    signs = np.random.default_rng(11).integers(0, 2, wide) * 2 - 1
    return walsh_hadamard(padded(q, wide) * signs)


def packed(bits: np.ndarray) -> np.ndarray:
    """Bits of the last axis as 64-bit words."""
    return np.packbits(bits, axis=-1, bitorder="little").view(np.uint64)


def codes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, alignments, lengths left) of rotated vectors, level by level."""
    left, words, align, rest = y.astype(np.float64), [], [], []
    for _ in range(LEVELS):
        up = left >= 0
        a = np.abs(left).mean(axis=1)
        left = left - np.where(up, a[:, None], -a[:, None])
        words.append(packed(up))
        align.append(a)
        rest.append(np.sqrt((left * left).sum(axis=1)))
    return np.stack(words, axis=1), np.stack(align, axis=1), np.stack(rest, axis=1)


def lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    flat = x.reshape(len(x), -1)
    off = np.arange(len(x) + 1, dtype=np.int32) * flat.shape[1]
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat.ravel()).cast(kind))


def grid(column: pa.Array, dtype: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(column), -1)


_INDEX = "id long, h long, lab long, q array<int>, code array<long>, align array<double>, rest array<double>"


def index(df: DataFrame, key: str, vector: str, label: str, scale: int) -> DataFrame:
    """The rows that take part: id, a hash of the contents, the label's hash, integers, codes, alignments, lengths left."""
    v = F.col(f"`{vector}`").cast("array<double>")
    rows = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.xxhash64(F.col(f"`{label}`")).alias("lab"), F.col(f"`{label}`").isNotNull().alias("some"), v.alias("v"))
    rows = rows.where("some and id is not null and v is not null").select("id", F.xxhash64("lab", "v").alias("h"), "lab", "v")
    longest = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).agg(F.max(F.size("v"))).first()[0] or 0
    wide = max(64, power_of_two(longest))
    most = int((1 << 26) / np.sqrt(wide))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), 2048):
                batch = whole.slice(lo, 2048)
                at, q = floors(batch.column(3), scale, max(1, longest), most)
                if not len(at):
                    continue
                words, align, rest = codes(rotated(q, wide))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).take(pa.array(at)) for i in range(3)), lists(q, pa.int32()), lists(words.view(np.int64), pa.int64()), lists(align, pa.float64()), lists(rest, pa.float64())],
                    names=["id", "h", "lab", "q", "code", "align", "rest"],
                )

    # a vector with a component that is missing or not finite may be longer: its length is not asked for
    fits = rows.where(F.size("v") <= longest)
    return keep(fits.mapInArrow(run, _INDEX), "index")


@dataclass
class Rows:
    """Rows of one block, by label."""

    id: np.ndarray
    lab: np.ndarray
    q: np.ndarray
    code: np.ndarray
    align: np.ndarray
    rest: np.ndarray

    @classmethod
    def of(cls, parts: list[pa.RecordBatch]) -> Rows:
        t = pa.Table.from_batches(parts).combine_chunks()
        t = t.take(pa.array(np.argsort(t["lab"].to_numpy(), kind="stable"))).combine_chunks()
        one = lambda name: t[name].chunk(0) if t[name].num_chunks else t[name].combine_chunks()
        code = grid(one("code"), np.int64).view(np.uint64)
        return cls(t["id"].to_numpy(), t["lab"].to_numpy(), grid(one("q"), np.int64), code.reshape(len(code), LEVELS, -1), grid(one("align"), np.float64), grid(one("rest"), np.float64))


class Anchors:
    """Anchors that meet a block side by side: bit planes, lengths, and the lists of their windows."""

    def __init__(self, batch: pa.RecordBatch, wide: int, length: int, same: bool) -> None:
        self.id, self.h = batch.column("id").to_numpy(), batch.column("h").to_numpy()
        self.lab, self.q = batch.column("lab").to_numpy(), grid(batch.column("q"), np.int64)
        y = rotated(self.q, wide)
        low = y.min(axis=1)
        span = y.max(axis=1) - low
        self.shift = np.array([max(0, int(s).bit_length() - PLANES) for s in span])
        u = (y - low[:, None]) >> self.shift[:, None]
        half = np.where(self.shift > 0, 1 << np.maximum(self.shift - 1, 0), 0)
        self.base = (low + half).astype(np.float64)
        self.step = np.exp2(self.shift)
        left = y - (low + half)[:, None] - (u << self.shift[:, None])
        # what the planes leave of the anchor: its product with any code is at most this
        self.off = np.abs(left).sum(axis=1).astype(np.float64)
        self.square = (y.astype(np.float64) ** 2).sum(axis=1)
        self.planes = np.stack([packed((u >> j & 1).astype(bool)) for j in range(PLANES)], axis=1)
        self.ones = (np.bitwise_count(self.planes).sum(axis=2).astype(np.int64) << np.arange(PLANES)).sum(axis=1)
        self.wide, self.length, self.same = wide, length, same
        # windows: (anchor, rank) with bounds in scores
        at = batch.column("rank").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.slot_of = np.repeat(np.arange(len(self.id)), at)
        self.rank = batch.column("rank").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.low = batch.column("low").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.high = batch.column("high").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.floor = self.low.copy()
        self.found = tuple(np.zeros(0, np.int64) for _ in range(3))

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each anchor the least and the largest score that any of its lists can still use."""
        n = len(self.id)
        least, most = np.full(n, np.iinfo(np.int64).max), np.full(n, NONE)
        np.minimum.at(least, self.slot_of, self.floor)
        np.maximum.at(most, self.slot_of, self.high)
        return least, most

    def take(self, i: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Put scored pairs into the lists of the windows that hold them."""
        slots = np.argsort(self.slot_of, kind="stable")
        begin, n = np.searchsorted(self.slot_of[slots], [i, i + 1])
        pair = np.repeat(np.arange(len(i)), n - begin)
        slot = slots[np.arange(len(pair)) - np.repeat(np.cumsum(n - begin) - (n - begin), n - begin) + begin[pair]]
        s = score[pair]
        fits = (s >= self.floor[slot]) & (s <= self.high[slot])
        self.found = tuple(np.concatenate(x) for x in zip(self.found, (slot[fits], s[fits], ids[pair[fits]]), strict=True))
        slot, s, who = self.found
        order = np.lexsort((who, -s, slot))
        slot, s, who = slot[order], s[order], who[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        first = place < self.length
        self.found = slot[first], s[first], who[first]
        full = place == self.length - 1
        self.floor[slot[full]] = np.maximum(self.floor[slot[full]], s[full])

    def seed(self, i: np.ndarray, score: np.ndarray) -> None:
        """A lower bound of each list's last score, from scores that every window of the anchor may hold."""
        order = np.lexsort((-score, i))
        i, score = i[order], score[order]
        last = np.arange(len(i)) - np.searchsorted(i, i) == self.length - 1
        bound = np.full(len(self.id), NONE)
        bound[i[last]] = score[last]
        open_ended = (self.low == NONE) & (self.high == np.iinfo(np.int64).max)
        self.floor[open_ended] = np.maximum(self.floor, bound[self.slot_of])[open_ended]


def scores(anchors: Anchors, rows: Rows, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.zeros(len(i), np.int64)
    for lo in range(0, len(i), PAIRS):
        a, b = i[lo : lo + PAIRS], j[lo : lo + PAIRS]
        out[lo : lo + PAIRS] = (anchors.q[a] * rows.q[b]).sum(axis=1)
    return out


def interval(anchors: Anchors, i, count: np.ndarray, ones: np.ndarray, align: np.ndarray, before: np.ndarray, spread: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, ...]:
    """(estimate, aligned error, room) of inner products after one more code.

    ``count``: weighted popcounts of the anchor's planes and the code; ``ones``: the code's own.
    """
    wide = anchors.wide
    along = anchors.base[i] * (2.0 * ones - wide) + anchors.step[i] * (2.0 * count - anchors.ones[i])
    estimate, spread = before + align * along, spread + align * anchors.off[i]
    sure = np.maximum(np.abs(along) - anchors.off[i], 0)
    off_code = np.sqrt(np.maximum(anchors.square[i] - sure * sure / wide, 0))
    return estimate, spread, spread + off_code * rest + SLACK * np.sqrt(anchors.square[i]) * (np.abs(rest) + np.abs(align) * np.sqrt(wide) + 1)


def meet(anchors: Anchors, group: np.ndarray, rows: Rows, lo: int, hi: int) -> None:
    """One tile: anchors ``group`` against rows ``lo .. hi - 1``."""
    code, a, wide = rows.code[lo:hi], group[:, None], anchors.wide
    count = np.zeros((len(group), hi - lo), np.int32)
    for w in range(code.shape[2]):
        for k in range(PLANES):
            count += np.bitwise_count(anchors.planes[group, k, w, None] & code[None, :, 0, w]).astype(np.int32) << k
    own = np.bitwise_count(code).sum(axis=2).astype(np.int64)
    estimate, spread, room = interval(anchors, a, count, own[None, :, 0], rows.align[None, lo:hi, 0], 0.0, 0.0, rows.rest[None, lo:hi, 0])
    least, most = anchors.bounds()
    if (least[group] == NONE).any() and hi - lo > 4 * anchors.length:
        # a list without a bound: score its best estimates first
        top = np.argpartition(estimate, -2 * anchors.length, axis=1)[:, -2 * anchors.length :]
        gi, gj = np.repeat(group, top.shape[1]), lo + top.ravel()
        fine = rows.id[gj] != anchors.id[gi]
        anchors.seed(gi[fine], scores(anchors, rows, gi[fine], gj[fine]))
        least, most = anchors.bounds()
    lower, upper = np.where(least == NONE, -np.inf, least.astype(np.float64) * wide), np.where(most == np.iinfo(np.int64).max, np.inf, most.astype(np.float64) * wide)
    gi, gj = np.nonzero((estimate + room >= lower[group][:, None]) & (estimate - room <= upper[group][:, None]))
    estimate, spread = estimate[gi, gj], spread[gi, gj]
    i, j = group[gi], gj
    for level in range(1, LEVELS):
        alive = []
        for s in range(0, len(i), PAIRS):
            e = slice(s, s + PAIRS)
            bits = np.bitwise_count(anchors.planes[i[e]] & code[j[e], level][:, None, :]).sum(axis=2).astype(np.int64)
            count = (bits << np.arange(PLANES)).sum(axis=1)
            estimate[e], spread[e], room = interval(anchors, i[e], count, own[j[e], level], rows.align[lo + j[e], level], estimate[e], spread[e], rows.rest[lo + j[e], level])
            alive.append((estimate[e] + room >= lower[i[e]]) & (estimate[e] - room <= upper[i[e]]))
        ok = np.concatenate(alive) if alive else np.zeros(0, bool)
        i, j, estimate, spread = i[ok], j[ok], estimate[ok], spread[ok]
    if anchors.same:
        other = rows.id[lo + j] != anchors.id[i]
        i, j = i[other], j[other]
    anchors.take(i, rows.id[lo + j], scores(anchors, rows, i, lo + j))


def dealt(rows: DataFrame, blocks: int) -> DataFrame:
    """The index by ``block``: rows are dealt by hash and by their place in its files, so that copies of one row spread, too."""
    salt = F.monotonically_increasing_id()
    return rows.withColumn("block", F.pmod(F.xxhash64("id", "h", salt), F.lit(blocks)).cast("int"))


def search(rows: DataFrame, anchors: DataFrame, blocks: int, length: int, same: bool) -> DataFrame:
    """(anchor, h, rank, id, score): of every anchor's windows the first ``length`` rows of the same, or of another, label.

    ``anchors``: id, h, lab, q, and windows as arrays ``rank``, ``low``, ``high``.
    """
    own = dealt(rows, blocks).select("block", F.lit(0).alias("kind"), "id", "h", "lab", "q", "code", "align", "rest")
    void = [F.lit(None).cast(t).alias(n) for n, t in (("code", "array<long>"), ("align", "array<double>"), ("rest", "array<double>"))]
    windows = [("rank", "array<int>"), ("low", "array<long>"), ("high", "array<long>")]
    sent = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "id", "h", "lab", "q", *void, *[n for n, _ in windows])
    both = own.select("*", *[F.lit(None).cast(t).alias(n) for n, t in windows]).unionByName(sent)
    # a block a task; its rows come first, then anchors, those of a label together
    tasks = both.repartitionById(blocks, "block").sortWithinPartitions("block", "kind", "lab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, held = None, [], None
        for whole in batches:
            block, kind = whole.column(0).to_numpy(), whole.column(1).to_numpy()
            cut = np.concatenate([[0], 1 + np.flatnonzero((block[1:] != block[:-1]) | (kind[1:] != kind[:-1])), [len(block)]])
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                if s == e:
                    continue
                if block[s] != now:
                    now, parts, held = block[s], [], None
                if kind[s] == 0:
                    parts.append(whole.slice(s, e - s).select(["id", "lab", "q", "code", "align", "rest"]))
                    continue
                if not parts:
                    continue
                held = held or Rows.of(parts)
                for lo in range(s, e, ANCHORS):
                    a = Anchors(whole.slice(lo, min(ANCHORS, e - lo)), 64 * held.code.shape[2], length, same)
                    for lab in np.unique(a.lab):
                        group = np.flatnonzero(a.lab == lab)
                        first, last = np.searchsorted(held.lab, lab), np.searchsorted(held.lab, lab, side="right")
                        for x, y in ((first, last),) if same else ((0, first), (last, len(held.lab))):
                            for t in range(x, y, TILE):
                                meet(a, group, held, t, min(t + TILE, y))
                    slot, score, who = a.found
                    at = a.slot_of[slot]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (a.id[at], a.h[at], a.rank[slot].astype(np.int32), who, score)], names=["anchor", "h", "rank", "id", "score"])

    found = tasks.mapInArrow(run, "anchor long, h long, rank int, id long, score long")
    first = Window.partitionBy("anchor", "h", "rank").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(first)).where(F.col("place") <= length)


def mine(
    df: DataFrame, anchors: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors`` is a condition on the column ``id``. Negatives of a positive with score p are rows of another
    label whose score n has low * p <= 100 * n <= high * p, best first, ties by the smaller id.
    """
    rows = index(df, key, vector, label, scale)
    wide = rows.select(F.size("code").alias("n")).first()
    blocks = max(1, -(-rows.count() * (64 * wide.n // LEVELS if wide else 64) // BLOCK_COMPONENTS))
    asked = keep(rows.where(anchors).select("id", "h", "lab", "q").dropDuplicates(["id", "h", "lab"]), "anchors")
    every = [F.array(F.lit(x).cast(t)).alias(n) for n, x, t in (("rank", 0, "int"), ("low", int(NONE), "long"), ("high", np.iinfo(np.int64).max, "long"))]
    best = keep(search(rows, asked.select("*", *every), blocks, positives, True).drop("rank"), "positives")
    # windows in whole scores: 100 * n >= low * p and 100 * n <= high * p; a score below zero has an empty one
    window = F.struct(F.col("place").alias("rank"), F.expr(f"({low} * score + 99) div 100").alias("low"), F.expr(f"{high} * score div 100").alias("high"))
    per = best.where("score >= 0").select("anchor", "h", window.alias("w"))
    # at most ``positives`` windows an anchor
    per = per.where("w.low <= w.high").groupBy("anchor", "h").agg(F.collect_list("w").alias("w"))
    asked = asked.join(per.withColumnRenamed("anchor", "id"), ["id", "h"]).select("id", "h", "lab", "q", F.col("w.rank"), F.col("w.low"), F.col("w.high"))
    got = search(rows, asked, blocks, negatives, False).select("anchor", "h", F.col("rank").alias("place"), F.col("place").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return got.join(best.select("anchor", "h", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), ["anchor", "h", "place"]).select(
        F.col("anchor").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
