"""Vectorised text kernels over Arrow batches, used inside Spark tasks.

A batch of texts is cut into blocks of a bounded number of bytes; a block is one
``uint8`` array with document offsets. Words, word hashes and rolling sums are
NumPy expressions over the block, so memory follows the block, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text in a block (a single longer text makes a block of its own).
BLOCK_BYTES = 1 << 20

_POWER = U(0x9E3779B97F4A7C15)
_powers = np.ones(1, dtype=U)
_random = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=U) * U(2) + U(1)

#: ``[^\x20\x09-\x0D]+``
SPACE_WORD = np.ones(256, dtype=bool)
SPACE_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (after lower-casing: a-z, 0-9, non-ASCII)
ALNUM_WORD = np.zeros(256, dtype=bool)
ALNUM_WORD[0x30:0x3A] = ALNUM_WORD[0x61:0x7B] = ALNUM_WORD[0x80:] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of the hash base modulo 2**64."""
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.concatenate([np.ones(1, U), np.full(max(n, 1 << 16), _POWER, U)]))
    return _powers[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(32))) * U(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> U(29))


@dataclass
class Block:
    """Rows ``first .. first+len(offsets)-1`` of a batch as one byte array."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    if off is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    o = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    d = np.frombuffer(data, dtype=np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return d, o - o[0]


def blocks(column: pa.Array, lower: bool = True, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a text column into blocks of about ``limit`` bytes, A-Z lower-cased if asked."""
    data, off = text_bytes(column)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        part = data[off[i] : off[j]]
        yield Block(i, _LOWER[part] if lower else part, off[i : j + 1] - off[i])
        i = j


@dataclass
class Words:
    """Words of a block: byte spans, row of each word, and first word of each row."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(block: Block, kind: np.ndarray) -> Words:
    """Maximal runs of word bytes; no word crosses a document's end."""
    data, off = block.data, block.offsets
    if not len(data):
        z = np.zeros(0, np.int64)
        return Words(z, z, z, np.zeros(block.rows + 1, np.int64))
    inside = kind[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    edge = off[:-1][off[:-1] < len(data)]
    start[edge] = inside[edge]
    last = off[1:][off[1:] > 0] - 1
    end[last] = inside[last]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    first = np.searchsorted(s, off)
    return Words(s, e, np.repeat(np.arange(block.rows), np.diff(first)), first)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span (spans ascending and disjoint)."""
    if not len(start):
        return np.zeros(0, U)
    length = end - start
    at = np.arange(int(length.sum()))
    begin = np.concatenate([[0], np.cumsum(length)[:-1]])
    inner = at - np.repeat(begin, length)
    source = data[inner + np.repeat(start, length)] if int(length.sum()) != len(data) else data
    value = _random[source] * powers(int(length.max()))[inner]
    return mix(np.add.reduceat(value, begin) + length.astype(U))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive word hashes (ignores row ends)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    total = np.zeros(n, U)
    for j in range(k):
        total += mix(h[j : j + n] + U(0x632BE59BD9B4E019 * (2 * j + 1) % (1 << 64)))
    return mix(total)


def hash_word(word: bytes) -> int:
    """``span_hashes`` of one word, for tables made on the driver."""
    d = np.frombuffer(word, dtype=np.uint8)
    return int(span_hashes(d, np.array([0]), np.array([len(d)]))[0])


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def lower_ascii(text: str | None) -> bytes:
    return b"" if text is None else bytes(_LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]) if text else b""


def split_words(text: str | None, kind: np.ndarray) -> list[bytes]:
    """Words of one text (driver-side tables and small checks)."""
    data = lower_ascii(text)
    if not data:
        return []
    b = Block(0, np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    w = words(b, kind)
    return [data[s:e] for s, e in zip(w.start, w.end, strict=True)]


class Lookup:
    """Exact lookup of 64-bit keys: a sorted key array with an index over its leading bits."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = np.sort(keys.astype(U))
        self.bits = int(min(22, max(4, np.ceil(np.log2(len(keys) + 1)) + 2)))
        edges = np.arange(1 << self.bits, dtype=U) << U(64 - self.bits)
        self.start = np.append(np.searchsorted(self.keys, edges), len(keys)).astype(np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Position of each key in ``keys``, or -1."""
        slot = (h >> U(64 - self.bits)).astype(np.int64)
        at, end = self.start[slot], self.start[slot + 1]
        out = np.full(len(h), -1, np.int32)
        live = np.flatnonzero(at < end)
        at, end = at[live], end[live]
        while len(live):
            k, want = self.keys[at], h[live]
            hit = k == want
            out[live[hit]] = at[hit]
            at = at + 1
            go = (k < want) & (at < end)
            live, at, end = live[go], at[go], end[go]
        return out


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) in order of codes, each code once."""
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.concatenate([p[0] for p in parts])
    n = np.concatenate([p[1] for p in parts])
    order = np.argsort(codes, kind="stable")
    codes, n = codes[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.add.reduceat(n, first)


class Tally:
    """Sums of counts by 64-bit code inside a task, merged when it has grown to ``most`` entries."""

    def __init__(self, most: int = 3_000_000) -> None:
        self.most, self.parts, self.size = most, [], 0

    def add(self, codes: np.ndarray) -> None:
        u, n = np.unique(codes, return_counts=True)
        self.parts.append((u, n))
        self.size += len(u)
        if self.size > self.most:
            self.parts = [self.merged()]
            self.size = len(self.parts[0][0])

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        return summed(self.parts)

    def take_if_large(self):
        """The sums so far, and start anew, where even the merged sums are too many."""
        if self.size > self.most // 2 and len(self.parts) == 1:
            out, self.parts, self.size = self.parts[0], [], 0
            return out
        return None


class Forest:
    """A spanning forest over one block of nodes and whatever links with them.

    ``hang`` takes links (block position, met position); memory is linear in the block
    plus one edge for each node met, however many links there are.
    """

    def __init__(self, ids: np.ndarray) -> None:
        self.ids = ids
        self.parent = np.arange(len(ids))
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []

    def roots(self) -> np.ndarray:
        while (up := self.parent[self.parent] != self.parent).any():
            self.parent[up] = self.parent[self.parent[up]]
        return self.parent

    def link(self, i: np.ndarray, j: np.ndarray, hook: np.ndarray) -> None:
        """Join block nodes ``i`` with what the met nodes ``j`` hang on; one that hangs nowhere yet takes its first ``i``."""
        if not len(i):
            return
        order = np.argsort(j, kind="stable")
        i, j = i[order], j[order]
        start = np.flatnonzero(np.concatenate([[True], j[1:] != j[:-1]]))
        new = hook[j[start]] < 0
        hook[j[start[new]]] = i[start[new]]
        other = hook[j]
        while True:
            root = self.roots()
            x, y = np.minimum(root[other], root[i]), np.maximum(root[other], root[i])
            apart = x != y
            if not apart.any():
                return
            np.minimum.at(self.parent, y[apart], x[apart])

    def met(self, ids: np.ndarray, hook: np.ndarray) -> None:
        """Note where met nodes hang: one edge each."""
        some = np.flatnonzero(hook >= 0)
        if len(some):
            self.edges.append((ids[some], hook[some]))

    def hang(self, i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> None:
        """Links of the block with a batch of met nodes, all at once."""
        hook = np.full(len(ids), -1)
        self.link(i, j, hook)
        self.met(ids, hook)

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        a = np.concatenate([self.ids, *[e[0] for e in self.edges]])
        b = np.concatenate([self.ids[self.roots()], *[self.ids[e[1]] for e in self.edges]])
        return a[a != b], b[a != b]

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """(label, node) of all nodes that hang together with another; the label is the group's least node."""
        root, low = self.roots(), self.ids.copy()
        np.minimum.at(low, root, self.ids)
        more = np.bincount(root, minlength=len(root)) > 1
        for ids, first in self.edges:
            np.minimum.at(low, root[first], ids)
            more[root[first]] = True
        own = more[root]
        label = [low[root[own]], *(low[root[f]] for _, f in self.edges)]
        node = [self.ids[own], *(ids for ids, _ in self.edges)]
        return np.concatenate(label), np.concatenate(node)
