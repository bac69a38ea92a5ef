"""N-gram Jaccard join by universe-partition pigeonhole, and its connected components.

A text's set holds the 64-bit hashes of its distinct ``K``-word shingles. Two sets of n and m
shingles at similarity 3/4 differ in at most D = (n + m) / 7 shingles. Sets fall into bands
of doubling size; each band has a table for the pairs whose larger set it holds, so a set
enters its own table, and the next one if it can have a partner there. A table cuts the universe
of hashes into cells in hash order; a set's occupied cells are its segments. Of B + 1 segments, where B
is the greatest D of any possible partner, at least one is the same in the partner (``signatures``):

* a set with enough segments is indexed by a subset of B + 1 of them, in a fixed order of all
  segments, larger ones first, as fewer texts share them. Both sets of a pair leave out only
  the ends of that order, so a common segment remains on both sides;
* a set with fewer segments than B + 1 is indexed by all of them and by their one-deletion
  neighbourhoods: a segment of two shingles or more then counts for two differences;
* where even that does not add up to B + 1, single shingles are added, n - ceil(3n/4) + 1 of them.

The number of cells decides how many signatures a set needs and how many texts meet in one. The
allocator (``allocate``) counts both on up to ``SAMPLE`` texts of one partition for each of
``FRACTIONS`` and takes the cheapest for each table; any choice finds every pair.

Texts that share a signature gather around the least of them (its hub): a row for each text
and hub, not for each pair. A hub's gathering is compared in blocks, first by parity
sketches (one bit a shingle; their Hamming distance never exceeds the symmetric
difference, so nothing is lost), then, for texts that still have a possible partner, exactly on
the sets. Blocks return spanning forests, so a group of copies costs rows in
proportion to its size. Equal sets are one node throughout.

Sets and nodes are named by 64-bit hashes: two different shingles of one pair, or two
different sets, are taken for one with a chance of about n^2 / 2^65.

Defined cases: null or empty texts have an empty set and link with nothing; fewer than
``K`` words make one shingle of the whole sequence; repeated rows and ties are one node; a
null doc_id takes part, and its component is the least non-null id reached (null if none);
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlemill.llm.blocks import SPACE_WORD, Block, Forest, U, blocks, gram_hashes, mix, signed, span_hashes, words
from candlemill.llm.jobs import components, keep, row_key, spread

K = 5
#: Similarity as a fraction, so that comparisons are exact in integers.
NUM, DEN = 3, 4
#: Least size of each band.
BANDS = np.array([1, *(6 << b for b in range(50))], np.int64)
#: Cells of a table, as shares of its greatest size, among which the allocator chooses.
FRACTIONS = (0.2, 0.4, 0.55, 0.75, 1.0)
#: Texts and bytes of the allocator's sample.
SAMPLE = 2000
SAMPLE_BYTES = 8 << 20
#: Cost of a text that meets others in a signature, in signatures.
MEET = 8
#: Hubs of large gatherings that are broadcast (24 bytes each); more are joined by a shuffle.
BROADCAST_HUBS = 1 << 20
log = logging.getLogger(__name__)
#: Members of a gathering that one task holds and compares with the rest: as sketches, and as sets.
HOLD_SKETCHES = 16384
HOLD_SETS = 2048


def shingle_sets(block: Block, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all rows in turn, row starts)."""
    w = words(block, SPACE_WORD)
    h = span_hashes(block.data, w.start, w.end)
    g = gram_hashes(h, k)
    row = w.row[: len(g)]
    ok = row == w.row[k - 1 :] if len(g) else np.zeros(0, bool)
    g, row = g[ok], row[ok]
    short = np.flatnonzero((w.counts > 0) & (w.counts < k))
    if len(short):
        whole = []
        for r in short:
            x = U(0)
            for y in h[w.first[r] : w.first[r + 1]]:
                x = mix(np.array([x ^ y], U) + U(17))[0]
            whole.append(x)
        g, row = np.concatenate([g, np.array(whole, U)]), np.concatenate([row, short])
    order = np.argsort(g)
    order = order[np.argsort(row[order].astype(np.uint32), kind="stable")] if block.rows >= 1 << 16 else order[np.argsort(row[order].astype(np.uint16), kind="stable")]
    g, row = g[order], row[order]
    if len(g):
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (row[1:] != row[:-1])])
        g, row = g[new], row[new]
    return g, np.searchsorted(row, np.arange(block.rows + 1))


def set_ids(g: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each row's whole set (0 for the empty one)."""
    size = np.diff(first)
    out = np.zeros(len(size), U)
    some = size > 0
    if some.any():
        out[some] = mix(np.add.reduceat(mix(g ^ U(0x51ED270B)), first[:-1][some]) + size[some].astype(U))
    return out


def signatures(g: np.ndarray, first: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, row, table) of every non-empty row; ``cells`` has the share of cells of each table."""
    size = np.diff(first)
    band = np.searchsorted(BANDS, size, side="right") - 1
    # sums of mixed hashes, so that leaving a shingle out of a segment is a subtraction
    value = mix(g + U(0x0DE1E7E))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for up in (0, 1):
        rows = np.flatnonzero((size > 0) & ((size * DEN // NUM >= BANDS[band + 1]) | (up == 0)))
        n, table = size[rows], band[rows] + up
        top = BANDS[table + 1] - 1
        need = (n + np.minimum(top, n * DEN // NUM)) * (DEN - NUM) // (DEN + NUM) + 1
        within = np.repeat(np.arange(len(rows)), n)
        at = np.arange(len(within)) - np.repeat(np.cumsum(n) - n - first[rows], n)
        name = mix(table.astype(U) + U(0x7AB1E))
        if not len(at):
            continue
        m = np.maximum(1, cells[table] * top).astype(U)
        cell = ((g[at] >> U(32)) * m[within]) >> U(32)
        begin = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (within[1:] != within[:-1])]))
        of, held = within[begin], np.diff(np.append(begin, len(at)))
        total = np.add.reduceat(value[at], begin) + name[of]
        sig = mix(total)
        count = np.bincount(of, minlength=len(rows))
        order = np.lexsort((sig, -held, of))
        rank = np.arange(len(of)) - (np.cumsum(count) - count)[of[order]]
        taken = order[rank < need[of[order]]]
        out.append((sig[taken], rows[of[taken]], table[of[taken]]))
        several = held > 1
        short = count < need
        left = np.repeat(several & short[of], held)
        whole = np.repeat(total, held)[left]
        out.append((mix(whole - value[at[left]]), rows[within[left]], table[within[left]]))
        hard = np.flatnonzero(count + np.bincount(of[several], minlength=len(rows)) < need)
        single = n[hard] - -(-NUM * n[hard] // DEN) + 1
        who = np.repeat(hard, single)
        one = first[rows[who]] + np.arange(len(who)) - np.repeat(np.cumsum(single) - single, single)
        out.append((mix(value[one] ^ name[who]), rows[who], table[who]))
    sig, row, table = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return sig, row, table


def allocate(docs: DataFrame, text: str, k: int = K) -> np.ndarray:
    """Share of cells of each table with the least cost on the sample: signatures, and texts that meet in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, rows, size = {}, 0, 0
        for batch in batches:
            for b in blocks(batch.column(0), limit=1 << 18):
                g, first = shingle_sets(b, k)
                ids = set_ids(g, first)
                rows, size = rows + b.rows, size + len(b.data)
                sets |= {i: g[s:e] for i, s, e in zip(ids.tolist(), first[:-1].tolist(), first[1:].tolist(), strict=True) if e > s}
                if rows >= SAMPLE or size >= SAMPLE_BYTES:
                    break
            if rows >= SAMPLE or size >= SAMPLE_BYTES:
                break
        if sets:
            g, first = np.concatenate(list(sets.values())), np.cumsum([0, *(len(x) for x in sets.values())])
            cost = np.zeros((len(FRACTIONS), len(BANDS)), np.int64)
            for i, f in enumerate(FRACTIONS):
                sig, _, table = signatures(g, first, np.full(len(BANDS), f))
                _, at, n = np.unique(sig, return_index=True, return_counts=True)
                cost[i] = np.bincount(table, minlength=len(BANDS)) + MEET * np.bincount(table[at], weights=n - 1, minlength=len(BANDS)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cost.tolist(), pa.list_(pa.int64()))], names=["cost"])

    found = docs.select(text).mapInArrow(run, "cost array<long>").take(len(FRACTIONS))
    if not found:
        return np.full(len(BANDS), FRACTIONS[1])
    cost = np.array([r.cost for r in found])
    seen = cost.any(axis=0)
    # tables without a text in the sample take the choice of the greatest one that has some
    best = np.where(seen, cost.argmin(axis=0), cost[:, np.flatnonzero(seen)[-1]].argmin())
    log.info("cells a shingle by table: %s; costs %s", [FRACTIONS[i] for i in best[seen]], cost[:, seen].tolist())
    return np.array(FRACTIONS)[best]


def sketch_words(size: np.ndarray) -> np.ndarray:
    """64-bit words of a set's parity sketch: the next power of two of its size in bits."""
    return 2 ** np.ceil(np.log2(np.maximum(size / 64, 1))).astype(np.int64)


def sketches(g: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Parity of the number of shingles that fall on each bit. Halves of a sketch fold by xor."""
    size = np.diff(first)
    n = sketch_words(size)
    start = np.cumsum(n) - n
    row = np.repeat(np.arange(len(size)), size)
    h = mix(g + U(0x5CE7C4))
    bit = (h % (n[row] * 64).astype(U)).astype(np.int64) + start[row] * 64
    parity = (np.bincount(bit, minlength=int(n.sum()) * 64) & 1).astype(np.uint8)
    packed = np.packbits(parity, bitorder="little")
    return [packed[8 * s : 8 * (s + k)].tobytes() for s, k in zip(start.tolist(), n.tolist(), strict=True)]


def fold(x: np.ndarray, width: int) -> np.ndarray:
    """Sketch rows folded to ``width`` words."""
    while x.shape[1] > width:
        half = x.shape[1] // 2
        x = x[:, :half] ^ x[:, half:]
    return x


def nodes(docs: DataFrame, text: str, k: int = K) -> DataFrame:
    """(_k1, _k2, doc_id, n, node, sketch) of every row; node names its set (null if empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(3)):
                g, first = shingle_sets(b, k)
                n = np.diff(first)
                cut = [batch.column(i).slice(b.first, b.rows) for i in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [*cut, pa.array(n, pa.int64()), pa.array(signed(set_ids(g, first)), mask=n == 0), pa.array(sketches(g, first), pa.binary())],
                    names=["_k1", "_k2", "doc_id", "n", "node", "sketch"],
                )

    return docs.select("_k1", "_k2", F.col("doc_id").cast("long"), text).mapInArrow(run, "_k1 long, _k2 long, doc_id long, n long, node long, sketch binary")


def index(docs: DataFrame, text: str, k: int = K) -> DataFrame:
    """(sig, node) rows; a task emits a set once, however many copies it sees."""

    cells = allocate(docs, text, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, U)
        for batch in batches:
            for b in blocks(batch.column(0)):
                g, first = shingle_sets(b, k)
                ids = set_ids(g, first)
                sig, row, _ = signatures(g, first, cells)
                _, at = np.unique(ids, return_index=True)
                fresh = np.zeros(len(ids), bool)
                fresh[at] = True
                fresh &= ~np.isin(ids, seen)
                seen = np.concatenate([seen, ids[fresh]])
                ok = fresh[row]
                sig, node = sig[ok], ids[row[ok]]
                for i in range(0, len(sig), 65536):
                    yield pa.RecordBatch.from_arrays([pa.array(signed(sig[i : i + 65536])), pa.array(signed(node[i : i + 65536]))], names=["sig", "node"])

    return docs.select(text).mapInArrow(run, "sig long, node long")


def gatherings(indexed: DataFrame) -> DataFrame:
    """(hub, node): who shares a signature whose least node is the hub; the hub is a member too."""
    least = indexed.withColumn("hub", F.min("node").over(Window.partitionBy("sig")))
    pairs = least.filter("node <> hub").select("hub", "node").distinct()
    return keep(pairs, "pairs")


def placed(members: DataFrame, hold: int) -> DataFrame:
    """(hub, to, own, node): members of each hub in blocks of about ``hold``, before any payload is attached.

    A pair meets in the block of its earlier part, so later blocks need no earlier members. Only large
    gatherings are looked up; a gathering itself is not shuffled here.
    """
    large = keep(members.groupBy("hub").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > hold).select("hub", F.ceil(F.col("size") / hold).cast("int").alias("cuts")), "large")
    few = large.limit(BROADCAST_HUBS + 1).count() <= BROADCAST_HUBS
    cut = members.join(F.broadcast(large) if few else large, "hub", "left")
    part = F.pmod(F.xxhash64("node"), F.coalesce("cuts", F.lit(1))).cast("int")
    out = cut.withColumn("part", part).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("part"))))
    return out.select("hub", "to", (F.col("part") == F.col("to")).alias("own"), "node")


def dealt(rows: DataFrame) -> DataFrame:
    """Rows (hub, to, own, ...) by block: to every block its own members first, then the others."""
    return spread(rows, None, "hub", "to").sortWithinPartitions("hub", "to", F.desc("own"))


def groups(batches: Iterator[pa.RecordBatch], step: int = 1024) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """(a new block starts?, slice of rows of one block and side)."""
    now = None
    for whole in batches:
        for lo in range(0, len(whole), step):
            batch = whole.slice(lo, step)
            hub, to = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            own = batch.column(2).to_numpy(zero_copy_only=False)
            edge = np.flatnonzero((hub[1:] != hub[:-1]) | (to[1:] != to[:-1]) | (own[1:] != own[:-1])) + 1
            for s, e in zip([0, *edge.tolist()], [*edge.tolist(), len(batch)], strict=True):
                key = (hub[s], to[s])
                yield key != now, batch.slice(s, e - s)
                now = key


class Sketched(Forest):
    """Sketches of one side, by width and in order of size, and what may hang together."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, raw: list[bytes]) -> None:
        super().__init__(ids)
        self.n = n
        width = np.array([len(x) // 8 for x in raw])
        order = np.argsort(n, kind="stable")
        self.by = {}
        for w in np.unique(width):
            at = order[width[order] == w]
            self.by[int(w)] = (at, np.frombuffer(b"".join(raw[i] for i in at), np.uint64).reshape(len(at), -1))

    def meet(self, other: Sketched) -> None:
        """Join what may be similar enough on both sides (or on one side with itself)."""
        hook = np.arange(len(self.ids)) if self is other else np.full(len(other.ids), -1)
        for w, (at, x) in self.by.items():
            for v, (bt, y) in other.by.items():
                if not w // 2 <= v <= 2 * w:
                    continue
                p, q = fold(x, min(w, v)), fold(y, min(w, v))
                n, m = self.n[at], other.n[bt]
                rows = max(1, (1 << 18) // (len(q) * p.shape[1]))
                for i in range(0, len(p), rows):
                    j = min(i + rows, len(p))
                    # both sides are in order of size: only sizes within the similarity's ratio are compared
                    lo, hi = np.searchsorted(m * DEN, n[i] * NUM), np.searchsorted(m * NUM, n[j - 1] * DEN, side="right")
                    if lo >= hi:
                        continue
                    far = np.bitwise_count(p[i:j, None] ^ q[None, lo:hi]).sum(axis=2, dtype=np.int64)
                    ok = self.close(n[i:j, None], m[None, lo:hi], far)
                    if self is other:
                        ok &= at[i:j, None] != bt[None, lo:hi]
                    a, b = np.nonzero(ok)
                    self.link(at[i + a], bt[lo + b], hook)
        if self is not other:
            self.met(other.ids, hook)

    @staticmethod
    def close(n: np.ndarray, m: np.ndarray, far: np.ndarray) -> np.ndarray:
        """Can sets of these sizes and at least this symmetric difference be similar enough?"""
        return (far * (DEN + NUM) <= (DEN - NUM) * (n + m)) & (np.minimum(n, m) * DEN >= np.maximum(n, m) * NUM)


def survivors(rows: DataFrame) -> DataFrame:
    """(hub, node) of members that may have a partner, by their sketches; from rows (hub, to, own, node, n, sketch).

    The hub is now the least node of those that may hang together, so what several gatherings
    found alike is one group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, side = [], None

        def begin() -> None:
            nonlocal side
            if held and side is None:
                side = Sketched(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), [x for h in held for x in h[2]])
                side.meet(side)

        def finish() -> Iterator[pa.RecordBatch]:
            if side is not None:
                label, node = side.groups()
                if len(node):
                    yield pa.RecordBatch.from_arrays([pa.array(label), pa.array(node)], names=["hub", "node"])

        for new, b in groups(batches):
            if new:
                begin()
                yield from finish()
                held, side = [], None
            row = (b.column(3).to_numpy(), b.column(4).to_numpy(), b.column(5).to_pylist())
            if b.column(2)[0].as_py():
                held.append(row)
            elif held:
                begin()
                side.meet(Sketched(*row))
        begin()
        yield from finish()

    return dealt(rows).mapInArrow(run, "hub long, node long").distinct()


class Sets(Forest):
    """Sets of one block's own members, with an inverted list of their shingles."""

    def __init__(self, ids: np.ndarray, sets: list[np.ndarray]) -> None:
        super().__init__(ids)
        self.n = np.array([len(s) for s in sets])
        shingle, member = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.n)
        order = np.argsort(shingle, kind="stable")
        self.member = member[order]
        self.shingle, self.start = np.unique(shingle[order], return_index=True)
        self.start = np.append(self.start, len(order))

    def meet(self, ids: np.ndarray, sets: list[np.ndarray]) -> None:
        """Intersect every own set with these, and note what is similar enough."""
        n = np.array([len(s) for s in sets])
        shingle, who = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
        at = np.minimum(np.searchsorted(self.shingle, shingle), len(self.shingle) - 1)
        hit = self.shingle[at] == shingle
        at, who = at[hit], who[hit]
        order = np.argsort(at, kind="stable")
        at, who = at[order], who[order]
        common = np.zeros((len(self.ids), len(sets)), np.float32)
        if len(at):
            begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            theirs = np.diff(np.append(begin, len(at)))
            token = at[begin]
            mine = self.start[token + 1] - self.start[token]
            # shingles of few members on both sides: all meetings written out; others by a product of 0/1 matrices
            heavy = mine * theirs > 64
            light = ~heavy[np.repeat(np.arange(len(begin)), theirs)]
            a, w = at[light], who[light]
            k = self.start[a + 1] - self.start[a]
            inner = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
            np.add.at(common, (self.member[np.repeat(self.start[a], k) + inner], np.repeat(w, k)), 1)
            for lo in range(0, int(heavy.sum()), 4096):
                t = np.flatnonzero(heavy)[lo : lo + 4096]
                left, right = np.zeros((len(self.ids), len(t)), np.float32), np.zeros((len(t), len(sets)), np.float32)
                for c, x in enumerate(t.tolist()):
                    left[self.member[self.start[token[x]] : self.start[token[x] + 1]], c] = 1
                    right[c, who[begin[x] : begin[x] + theirs[x]]] = 1
                common += left @ right
        both = common.astype(np.int64)
        i, j = np.nonzero(both * DEN >= NUM * (self.n[:, None] + n[None] - both))
        self.hang(i, j, ids)


def links(rows: DataFrame) -> DataFrame:
    """(a, b): a spanning forest of each block's links, verified on the whole sets; from rows (hub, to, own, node, tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, side = [], None

        def begin() -> None:
            nonlocal side
            if held and side is None:
                side = Sets(np.concatenate([h[0] for h in held]), [s for h in held for s in h[1]])
                for ids, sets in held:
                    side.meet(ids, sets)

        def finish() -> Iterator[pa.RecordBatch]:
            if side is not None:
                a, b = side.forest()
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for new, b in groups(batches, 256):
            if new:
                begin()
                yield from finish()
                held, side = [], None
            row = (b.column(3).to_numpy(), [np.frombuffer(x, U) for x in b.column(4).to_pylist()])
            if b.column(2)[0].as_py():
                held.append(row)
            elif held:
                begin()
                side.meet(*row)
        begin()
        yield from finish()

    return dealt(rows).mapInArrow(run, "a long, b long")


def sets_of(docs: DataFrame, text: str, k: int = K) -> DataFrame:
    """(hub, to, own, node, tokens) from rows (places, node, text): the whole set, at each place it is needed."""
    place = "array<struct<hub:bigint,to:int,own:boolean>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(2)):
                g, first = shingle_sets(b, k)
                tokens = [g[s:e].tobytes() for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(b.first, b.rows), batch.column(1).slice(b.first, b.rows), pa.array(tokens, pa.binary())], names=["places", "node", "tokens"])

    made = docs.select("places", "node", text).mapInArrow(run, f"places {place}, node long, tokens binary")
    return made.withColumn("p", F.explode("places")).select("p.hub", "p.to", "p.own", "node", "tokens")


def join(docs: DataFrame, text: str = "text", k: int = K) -> DataFrame:
    """(_k1, _k2, doc_id, n_shingles, component_id, _group) of every row at Jaccard ``NUM / DEN`` or more.

    ``_group`` names a component by one of its sets, also where ids repeat or are null; null for empty sets.
    """
    keyed = row_key(docs.select("doc_id", text), "doc_id", text)
    base = keep(nodes(keyed, text, k), "nodes")
    one = base.filter("node is not null").groupBy("node").agg(F.min(F.struct("_k1", "_k2")).alias("key"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    pairs = gatherings(index(docs, text, k))
    members = pairs.unionByName(pairs.select("hub", F.col("hub").alias("node")).distinct())
    sketched = placed(members, HOLD_SKETCHES).join(one.select("node", "n", "sketch"), "node").select("hub", "to", "own", "node", "n", "sketch")
    alive = keep(survivors(sketched), "alive")
    # a set's places are at most its signatures (times its blocks); its text comes from one of its rows
    where = placed(alive, HOLD_SETS)
    needed = where.groupBy("node").agg(F.collect_list(F.struct("hub", "to", "own")).alias("places")).join(one.select("node", "key"), "node").select("node", "places", "key._k1", "key._k2")
    texts = keyed.join(needed, ["_k1", "_k2"]).dropDuplicates(["_k1", "_k2"])
    edges = links(sets_of(texts, text, k))
    member = components(edges)
    rows = base.drop("sketch").join(member, "node", "left").withColumn("_c", F.coalesce("component", "node"))
    least = rows.filter("_c is not null").groupBy("_c").agg(F.min("doc_id").alias("least"))
    return rows.join(least, "_c", "left").select("_k1", "_k2", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"), F.col("_c").alias("_group"))


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    return join(docs, text).drop("_k1", "_k2", "_group")
