"""SentencePiece (BPE) encoding and decoding by suffix-array matching.

A text is a run of units, each of spaces and the word after them; no piece reaches over a
unit's start, so every distinct unit of a batch is encoded once. The distinct units are
concatenated and their suffixes sorted (by eight bytes, which is as far as most pieces
reach). Every piece's occurrences are a range of the sorted suffixes, found by binary
search. The occurrences are edges from start to end; they are sorted by position and
relaxed in that order, units side by side, cut wherever no edge crosses: an edge holds if its piece may follow the last piece of the
encoding up to its start, and exactly one edge into each position does. Whether a piece may
follow another is read off the merge order, so the result is the merge result itself.

Characters without a piece become byte pieces. Decoding concatenates pieces, turns the
mark into a space, and drops the leading one.

No shuffle: batches are encoded where they are read, in bounded chunks.

Defined cases: null or empty texts have no ids and decode to the empty text; a literal mark
(U+2581) reads as a space; repeated rows are encoded alike; an empty table gives no
rows; the tokenizer's file is a parameter and other columns pass through.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from candlemill.llm.blocks import U, mix, span_hashes, text_bytes

MARK = "▁"
#: Bytes of distinct units whose suffixes are sorted together.
CHUNK = 1 << 18
#: Distinct units a task remembers.
REMEMBER = 1_000_000


@functools.cache
def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Vocabulary:
    """Matchable pieces in merge order (``rank``): single characters first, then merges."""

    data: np.ndarray
    start: np.ndarray
    ids: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaves: int
    pair_keys: np.ndarray
    pair_rank: np.ndarray
    byte_ids: np.ndarray
    table: list[bytes]

    @property
    def size(self) -> np.ndarray:
        return np.diff(self.start)


def merge_split(piece: str, rank: dict[str, int]) -> tuple[str, str] | None:
    """The two parts that merge last into a piece; None if merging ends elsewhere."""
    parts, last = list(piece), None
    while len(parts) > 1:
        best = min(((rank.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(1 << 40, 0))
        if best[0] == 1 << 40:
            return None
        i = best[1]
        last = (parts[i], parts[i + 1])
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return last


@functools.cache
def vocabulary(model_file: str) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = sp.get_piece_size()
    names = [sp.id_to_piece(i) for i in range(n)]
    byte_ids = np.zeros(256, np.int32)
    plain = []
    table = []
    for i, p in enumerate(names):
        if sp.is_byte(i):
            byte_ids[int(p[1:-1], 16)] = i
            table.append(bytes([int(p[1:-1], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            table.append(b"")
        else:
            plain.append(i)
            table.append(p.replace(MARK, " ").encode())
    single = [i for i in plain if len(names[i]) == 1]
    merged = sorted((i for i in plain if len(names[i]) > 1), key=lambda i: (-sp.get_score(i), i))
    rank = {names[i]: r for r, i in enumerate([*single, *merged])}
    splits = {i: merge_split(names[i], rank) for i in merged}
    merged = [i for i in merged if splits[i]]
    order = [*single, *merged]
    rank = {names[i]: r for r, i in enumerate(order)}
    left = np.array([*range(len(single)), *(rank[splits[i][0]] for i in merged)])
    right = np.array([*range(len(single)), *(rank[splits[i][1]] for i in merged)])
    pairs = {}
    for i in merged:
        p = names[i]
        for k in range(1, len(p)):
            if p[:k] in rank and p[k:] in rank:
                pairs[rank[p[:k]] << 20 | rank[p[k:]]] = rank[p]
    keys = np.array(sorted(pairs), np.int64)
    raw = [names[i].replace(MARK, " ").encode() for i in order]
    return Vocabulary(
        np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), np.array(order, np.int32), left, right, len(single),
        keys, np.array([pairs[k] for k in keys.tolist()], np.int64), byte_ids, table,
    )


def may_follow(v: Vocabulary, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """May piece ``two`` follow piece ``one`` in a merge result? (ranks)

    Undo the merges of both sides, latest first. The pair is broken if at some point the pieces
    at the seam would have merged before the merge that is undone next.
    """
    out = np.ones(len(one), bool)
    live = np.arange(len(one))
    a, b = one.copy(), two.copy()
    limit = np.full(len(one), 1 << 40)
    while len(live):
        key = a << 20 | b
        at = np.minimum(np.searchsorted(v.pair_keys, key), len(v.pair_keys) - 1)
        broken = (v.pair_keys[at] == key) & (v.pair_rank[at] < limit)
        out[live[broken]] = False
        # the later merge is undone; of equal ranks the right one (merging goes left to right)
        first = a > b
        a_leaf, b_leaf = a < v.leaves, b < v.leaves
        undo_a = (first & ~a_leaf) | (b_leaf & ~a_leaf)
        undo_b = ~undo_a & ~b_leaf
        limit = np.where(undo_a, a, np.where(undo_b, b + 1, limit))
        a, b = np.where(undo_a, v.right[a], a), np.where(undo_b, v.left[b], b)
        go = ~broken & (undo_a | undo_b)
        live, a, b, limit = live[go], a[go], b[go], limit[go]
    return out


class Follows:
    """``may_follow`` with the answers remembered in a table of fixed size."""

    SLOTS = 1 << 21

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        self.keys = np.full(self.SLOTS, -1, np.int64)
        self.value = np.zeros(self.SLOTS, bool)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        slot = (mix(key.astype(U)) & U(self.SLOTS - 1)).astype(np.int64)
        known = self.keys[slot] == key
        out = self.value[slot]
        if not known.all():
            miss = np.flatnonzero(~known)
            k, back = np.unique(key[miss], return_inverse=True)
            got = may_follow(self.v, k >> 20, k & ((1 << 20) - 1))
            out[miss] = got[back]
            self.keys[slot[miss]] = key[miss]
            self.value[slot[miss]] = got[back]
            # two keys of one slot: the last one stays, so its answer must be the one kept
            self.value[slot[miss]] = np.where(self.keys[slot[miss]] == key[miss], got[back], self.value[slot[miss]])
        return out


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """The next eight bytes at each position, as a big-endian number (zeros past the end)."""
    x = np.concatenate([data, np.zeros(8, np.uint8)]).astype(U)
    key = np.zeros(len(data), U)
    for j in range(8):
        key = (key << U(8)) | x[j : j + len(data)]
    return key


def edges(v: Vocabulary, piece_key: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, piece) of every occurrence: ranges of the sorted suffixes, found by binary search."""
    key = eight_bytes(data)
    order = np.argsort(key)
    key = key[order]
    size = v.size
    rest = np.minimum(size, 8)
    high = piece_key | np.where(rest < 8, (U(1) << (U(8) * (8 - rest).astype(U))) - U(1), U(0))
    lo, hi = np.searchsorted(key, piece_key), np.searchsorted(key, high, side="right")
    n = hi - lo
    piece = np.repeat(np.arange(len(n)), n)
    at = order[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
    ok = at + size[piece] <= len(data)
    long = np.flatnonzero((size[piece] > 8) & ok)
    for j in range(8, int(size.max())):
        # beyond the sorted depth the range is narrowed byte by byte
        long = long[ok[long] & (size[piece[long]] > j)]
        if not len(long):
            break
        ok[long] = data[at[long] + j] == v.data[v.start[piece[long]] + j]
    return at[ok], piece[ok]


class Encoder:
    """Encodes blocks of texts; remembers the units it has seen."""

    def __init__(self, v: Vocabulary) -> None:
        self.v, self.follows = v, Follows(v)
        full = np.zeros((len(v.ids), 8), np.uint8)
        for j in range(8):
            has = v.size > j
            full[has, j] = v.data[v.start[:-1][has] + j]
        self.piece_key = full.view(">u8").ravel().astype(U)
        self.chars = np.array([len(v.table[i].decode()) for i in v.ids])
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, U)
        self.slot = np.zeros(0, np.int64)
        self.first = np.zeros(1, np.int64)
        self.tokens = np.zeros(0, np.int32)

    def units(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes with a leading space for each text, unit starts, unit ends, units before each text)."""
        size = np.diff(off)
        lead = size > 0
        new = off + np.concatenate([[0], np.cumsum(lead)])
        x = np.full(int(new[-1]), 0x20, np.uint8)
        row = np.repeat(np.arange(len(size)), size)
        x[np.arange(len(data)) + (new[row] - off[row]) + 1] = data
        space = x == 0x20
        start = space.copy()
        start[1:] &= ~space[:-1]
        start[new[:-1][lead]] = True
        # a newline never merges: it starts a unit of its own, which keeps units short
        newline = x == 0x0A
        start |= newline
        start[1:] |= newline[:-1]
        s = np.flatnonzero(start)
        return x, s, np.append(s[1:], len(x)), np.searchsorted(s, new)

    def encode_units(self, data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all units in turn, first token of each unit); units cover ``data``."""
        v, n = self.v, len(data)
        end = np.append(start[1:], n)
        at, piece = edges(v, self.piece_key, data)
        char = (data & 0xC0) != 0x80
        width = np.diff(np.append(np.flatnonzero(char), n))
        begin = np.flatnonzero(char)
        covered = np.zeros(n, bool)
        covered[at[self.chars[piece] == 1]] = True
        bare = ~covered[begin]
        unknown = len(v.ids)
        at = np.concatenate([at, begin[bare]])
        size = np.concatenate([v.size[piece], width[bare]])
        piece = np.concatenate([piece, np.full(int(bare.sum()), unknown)])
        inside = at + size <= end[np.searchsorted(start, at, side="right") - 1]
        at, size, piece = at[inside], size[inside], piece[inside]
        # no merge reaches over a place that no occurrence crosses: units are cut there, which keeps unspaced text short
        cross = np.bincount(at + 1, minlength=n + 2) - np.bincount(at + size, minlength=n + 2)
        whole, start = start, np.flatnonzero(np.cumsum(cross)[:n] == 0)
        end = np.append(start[1:], n)
        # occurrences sorted by their place in the unit; units are relaxed side by side
        place = at - start[np.searchsorted(start, at, side="right") - 1]
        order = np.argsort(place, kind="stable")
        at, size, piece, place = at[order], size[order], piece[order], place[order]
        cut = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.full(n + 1, -1, np.int64)
        back = np.zeros(n + 1, np.int64)
        for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(at)], strict=True):
            a, s, p = at[lo:hi], size[lo:hi], piece[lo:hi]
            if place[lo]:
                before = last[a]
                ok = before >= 0
                test = ok & (before < unknown) & (p < unknown)
                ok[test] = self.follows(before[test], p[test])
                a, s, p = a[ok], s[ok], p[ok]
            last[a + s], back[a + s] = p, s
        # read back from the units' ends
        spot, who = end.copy(), np.arange(len(start))
        seen_piece, seen_at = [], []
        while len(who):
            p, s = last[spot], back[spot]
            seen_piece.append(p)
            seen_at.append(spot - s)
            spot = spot - s
            go = spot > start[who]
            spot, who = spot[go], who[go]
        piece, at = np.concatenate(seen_piece), np.concatenate(seen_at)
        order = np.argsort(at, kind="stable")
        piece, at = piece[order], at[order]
        wide = np.append(at[1:], n) - at
        many = np.where(piece == unknown, wide, 1)
        row = np.repeat(np.arange(len(piece)), many)
        inner = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        out = np.where(piece[row] == unknown, v.byte_ids[data[at[row] + inner]], v.ids[np.minimum(piece[row], unknown - 1)])
        return out.astype(np.int32), np.searchsorted(at[row], np.append(whole, n))

    def learn(self, hashes: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Encode units not seen before, in chunks."""
        size = end - start
        group = np.cumsum(size) // CHUNK
        tokens, count = [self.tokens], [np.diff(self.first)]
        for g in np.unique(group):
            m = group == g
            s, k = start[m], size[m]
            first = np.cumsum(k) - k
            src = np.arange(int(k.sum())) - np.repeat(first, k) + np.repeat(s, k)
            t, f = self.encode_units(data[src], first)
            tokens.append(t)
            count.append(np.diff(f))
        before = len(self.first) - 1
        self.tokens = np.concatenate(tokens)
        self.first = np.concatenate([[0], np.cumsum(np.concatenate(count))])
        known, slot = np.concatenate([self.known, hashes]), np.concatenate([self.slot, before + np.arange(len(hashes))])
        order = np.argsort(known)
        self.known, self.slot = known[order], slot[order]

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, first id of each text)."""
        x, s, e, first = self.units(data, off)
        if not len(s):
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        h, at, back = np.unique(span_hashes(x, s, e), return_index=True, return_inverse=True)
        if len(self.known) > REMEMBER:
            self.forget()
        k = np.minimum(np.searchsorted(self.known, h), max(len(self.known) - 1, 0))
        fresh = self.known[k] != h if len(self.known) else np.ones(len(h), bool)
        if fresh.any():
            self.learn(h[fresh], x, s[at[fresh]], e[at[fresh]])
        slot = self.slot[np.searchsorted(self.known, h)][back]
        n = self.first[slot + 1] - self.first[slot]
        total = np.concatenate([[0], np.cumsum(n)])
        ids = self.tokens[np.arange(int(total[-1])) - np.repeat(total[:-1], n) + np.repeat(self.first[slot], n)]
        return ids, total[first]


def unmarked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column, a literal mark read as a space."""
    data, off = text_bytes(column)
    if len(data) and np.any((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)):
        raw = data.tobytes()
        parts = [raw[a:b].replace(MARK.encode(), b" ") for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        data, off = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])
    return data, off


def numbered(df: DataFrame, more: StructField) -> StructType:
    """The frame's columns as c0, c1, ... and one more: names cannot clash, whatever they are."""
    return StructType([*(StructField(f"c{i}", f.dataType) for i, f in enumerate(df.schema)), more])


def encode(docs: DataFrame, text: str = "text", model_file: str | None = None, to: str = "ids") -> DataFrame:
    """The rows with the ids of ``text`` in a new array column."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(model_file or default_model()))
    names = docs.columns
    if to in names:
        raise ValueError(f"column {to} exists")
    at = names.index(text)
    schema = numbered(docs, StructField("ids", ArrayType(IntegerType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(shared.value)
        for batch in batches:
            data, off = unmarked(batch.column(at))
            i = 0
            while i < len(off) - 1:
                j = max(i + 1, int(np.searchsorted(off, off[i] + (1 << 20), side="right")) - 1)
                ids, first = coder.encode(data[off[i] : off[j]], off[i : j + 1] - off[i])
                cut = [c.slice(i, j - i) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([*cut, pa.ListArray.from_arrays(first.astype(np.int32), pa.array(ids))], names=[*(f"c{k}" for k in range(len(names))), "ids"])
                i = j

    out = docs.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(run, schema)
    return out.toDF(*names, to)


def decode(encoded: DataFrame, ids: str = "ids", model_file: str | None = None, to: str = "decoded") -> DataFrame:
    """The rows with the text of an id column in a new column."""
    table = vocabulary(model_file or default_model()).table
    shared = encoded.sparkSession.sparkContext.broadcast((np.frombuffer(b"".join(table), np.uint8), np.cumsum([0, *map(len, table)])))
    names = encoded.columns
    at = names.index(ids)
    schema = numbered(encoded, StructField("decoded", StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, start = shared.value
        for whole in batches:
            for lo in range(0, len(whole), 256):
                batch = whole.slice(lo, 256)
                column = batch.column(at)
                i = column.flatten().to_numpy(zero_copy_only=False)
                count = column.value_lengths().fill_null(0).to_numpy()
                n = start[i + 1] - start[i]
                total = np.concatenate([[0], np.cumsum(n)])
                data = raw[np.arange(int(total[-1])) - np.repeat(total[:-1], n) + np.repeat(start[i], n)].tobytes()
                edge = total[np.concatenate([[0], np.cumsum(count)])]
                texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
                texts = [t[1:] if t.startswith(" ") else t for t in texts]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*(f"c{k}" for k in range(len(names))), "decoded"])

    out = encoded.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(run, schema)
    return out.toDF(*names, to)


def summary(docs: DataFrame, text: str = "text", model_file: str | None = None) -> DataFrame:
    """(doc_id, n_ids, ids_sha256, round_trip) of every row; ids are digested as comma-joined text."""
    plain = F.replace(F.coalesce(F.col(text), F.lit("")), F.lit(MARK), F.lit(" "))
    both = decode(encode(docs.select("doc_id", text), text, model_file), "ids", model_file)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_ids"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"), (F.col("decoded") == plain).alias("round_trip")
    )
