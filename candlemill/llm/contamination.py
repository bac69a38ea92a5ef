"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of 13 consecutive item words (a shorter item is one window).
Patterns of one length form a matcher: a shift table over the hashes of two-word
blocks says how far the window may jump, a suffix-hash bucket picks the patterns
that may end here, and a direct comparison of the words' bytes decides. Every
document of a block advances at once (NumPy), so the jumps stay vectorised.

Spark cuts the benchmark's items into windows and deals them by hash into parts of a
bounded number; one part at a time is brought together and broadcast to the tasks. Documents are never shuffled: a row passes the scans of ``AT_ONCE`` parts in one
task, collecting its hits, and is written down before the next parts.

Defined cases: null or empty texts have no words and no hits; null items have no
windows; a repeated document row gives its row again; equal items are both
reported; an empty benchmark hits nothing; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlemill.llm.blocks import ALNUM_WORD, U, Block, Words, blocks, hash_word, mix, span_hashes, split_words, words
from candlemill.llm.jobs import aside, keep, restored, with_columns

WINDOW = 13
#: Windows of a benchmark part: bounds what is broadcast (about 200 bytes a window).
PART_WINDOWS = 200_000

#: Parts whose scans follow each other in one task (a Python worker each).
AT_ONCE = 4


class Matcher:
    """Patterns of one length: shift table, suffix buckets, words."""

    def __init__(self, length: int, patterns: dict[bytes, list[str]]) -> None:
        self.length, self.patterns = length, patterns
        self.block = min(2, length)
        self.jump = length - self.block + 1
        keys = np.array([[hash_word(w) for w in p.split(b" ")] for p in patterns], dtype=U)
        grams = self.grams(keys)
        count = grams.shape[1]
        # distance of a block from the window's end; the least over all patterns counts
        dist = np.tile(np.arange(count - 1, -1, -1), (len(keys), 1))
        flat, far = grams.ravel(), dist.ravel()
        order = np.lexsort((far, flat))
        flat, far = flat[order], far[order]
        first = np.ones(len(flat), bool)
        first[1:] = flat[1:] != flat[:-1]
        self.blocks, self.shift = flat[first], far[first]
        self.suffix = np.unique(self.whole(keys))

    def grams(self, h: np.ndarray) -> np.ndarray:
        if self.block == 1:
            return mix(h)
        return mix(h[:, :-1] * U(3) + mix(h[:, 1:] + U(11)))

    def whole(self, h: np.ndarray) -> np.ndarray:
        """Hash of the window's words (the bucket a suffix falls in)."""
        out = np.zeros(h.shape[0], U)
        for j in range(h.shape[1]):
            out = mix(out * U(5) + h[:, j])
        return out

    def search(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Start words of windows whose bucket has patterns, all rows advancing at once."""
        m, found = self.length, []
        ends = first[1:]
        at = first[:-1][np.diff(first) >= m] + m
        end = ends[np.diff(first) >= m]
        while len(at):
            tail = h[at - 1][:, None] if self.block == 1 else np.stack([h[at - 2], h[at - 1]], axis=1)
            g = self.grams(tail).ravel()
            k = np.minimum(np.searchsorted(self.blocks, g), len(self.blocks) - 1)
            step = np.where(self.blocks[k] == g, self.shift[k], self.jump)
            hit = step == 0
            if hit.any():
                s = at[hit] - m
                w = self.whole(h[s[:, None] + np.arange(m)])
                k = np.minimum(np.searchsorted(self.suffix, w), len(self.suffix) - 1)
                found.append(s[self.suffix[k] == w])
                step = np.maximum(step, 1)
            at = at + step
            live = at <= end
            at, end = at[live], end[live]
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def verify(self, starts: np.ndarray, block: Block, w: Words) -> Iterator[tuple[int, list[str]]]:
        """Compare the words themselves."""
        data = block.data.tobytes()
        for s in starts.tolist():
            text = b" ".join(data[a:b] for a, b in zip(w.start[s : s + self.length], w.end[s : s + self.length], strict=True))
            if (items := self.patterns.get(text)) is not None:
                yield s, items


def windows(text: str | None) -> list[tuple[int, bytes]]:
    """(length, words) of an item's windows."""
    found = split_words(text, ALNUM_WORD)
    if not found:
        return []
    m = min(WINDOW, len(found))
    return [(m, b" ".join(found[i : i + m])) for i in range(len(found) - m + 1)]


def item_windows(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """(item, length, words): the distinct windows of every item; a null id reads ``None``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = windows(t.as_py())
                for lo in range(0, len(found), 10_000):
                    length, w = zip(*found[lo : lo + 10_000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(w)), pa.array(length, pa.int32()), pa.array(w, pa.binary())], names=["item", "length", "words"])

    named = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("None")).alias("i"), F.col(text).alias("t"))
    return named.mapInArrow(run, "item string, length int, words binary").distinct()


def parts(benchmark: DataFrame, item: str, text: str, most: int = PART_WINDOWS) -> Iterator[list[Matcher]]:
    """Matchers of successive benchmark parts, to which windows are dealt by hash: about ``most`` each, however long an item is."""
    found = keep(item_windows(benchmark, item, text), "windows")
    count = max(1, -(-found.count() // most))
    part = F.pmod(F.xxhash64("words", "item"), F.lit(count))
    for k in range(count):
        by: dict[int, dict[bytes, list[str]]] = {}
        for batch in found.filter(part == k).toArrow().to_batches():
            for i, m, p in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                by.setdefault(m, {}).setdefault(p, []).append(i)
        yield [Matcher(m, p) for m, p in by.items()]


def scan(docs: DataFrame, matchers: list[Matcher], text: str, carry: list[str]) -> DataFrame:
    """Carried columns of every row, its number of words, word positions hit, and items with occurring windows."""
    shared = docs.sparkSession.sparkContext.broadcast(matchers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(0)):
                w = words(block, ALNUM_WORD)
                h = span_hashes(block.data, w.start, w.end)
                cover = np.zeros(len(w) + 1, np.int32)
                items: dict[int, set[str]] = {}
                for m in shared.value:
                    for s, found in m.verify(m.search(h, w.first), block, w):
                        cover[s] += 1
                        cover[s + m.length] -= 1
                        items.setdefault(int(w.row[s]), set()).update(found)
                hit = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
                row = w.row[hit]
                offs = np.searchsorted(row, np.arange(block.rows + 1)).astype(np.int32)
                lo, n = block.first, block.rows
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(i).slice(lo, n) for i in range(1, len(carry) + 1)), pa.array(w.counts, pa.int64()),
                        pa.ListArray.from_arrays(offs, pa.array((hit - w.first[row]).astype(np.int32))),
                        pa.array([sorted(items.get(i, ())) for i in range(n)], pa.list_(pa.string())),
                    ],
                    names=[*carry, "_n_words", "_hits", "_items"],
                )

    return docs.select(F.col(text).alias("_text"), *carry).mapInArrow(run, with_columns(docs, carry, "_n_words long, _hits array<int>, _items array<string>"))


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The carried columns (all, if not given) of every row, and n_words, hits (word positions), items as ``_n_words``, ``_hits``, ``_items``."""
    carry = docs.columns if carry is None else carry
    some = aside(docs, text, carry)
    out = None
    for i, matchers in enumerate(parts(benchmark, item, item_text)):
        if out is None:
            out = scan(some, matchers, "text", some.columns)
            continue
        before = out.withColumnsRenamed({"_hits": "_h", "_items": "_i"}).drop("_n_words")
        both = scan(before if i % AT_ONCE else keep(before, "scanned"), matchers, "text", before.columns)
        out = both.withColumns({"_hits": F.array_union("_h", "_hits"), "_items": F.array_union("_i", "_items")}).drop("_h", "_i")
    return restored(out, carry, "_n_words", "_hits", "_items")


def is_contaminated() -> Column:
    """The verdict on a row of ``matches``: a twentieth of its words at least are hit."""
    return (F.size("_hits") > 0) & (20 * F.size("_hits").cast("long") >= F.col("_n_words"))


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: words, hit words, items, their digest, and the verdict."""
    found = matches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text), benchmark, text, carry=["doc_id"])
    return found.select(
        "doc_id", F.col("_n_words").alias("n_words"), F.size("_hits").cast("long").alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("_items"), ",").cast("binary"), 256).alias("items_sha256"), is_contaminated().alias("contaminated"),
    )
