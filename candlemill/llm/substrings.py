"""Exact substring deduplication with suffix arrays over shards.

A byte goes if a ``LENGTH``-byte string over it starts anywhere else, too. The corpus is cut
into shards that are sorted on their own, so equal strings have to meet in one shard:

1. Every ``LENGTH``-byte window has an anchor, the least hash among its ``GRAM``-byte grams.
   Equal windows have equal anchors. Consecutive windows with one anchor form a run: one
   narrow row (about one for a hundred bytes), no text.
2. Runs are counted by anchor, those of one block's equal strings as one that weighs two. An anchor of one run has no repeats: most rows end here.
   Runs equal as strings (copies) are whole repeats at once and go on as one.
3. Where different strings share an anchor, their bytes are fetched and dealt by anchor. Equal
   windows hold the anchor at the same place. By that place they fall into ``PARTS`` parts; windows of
   one part have a core around the anchor in common, so a part whose core no other
   string of the anchor has ends here. The rest is concatenated into shards of bounded size. A suffix array by induced sorting and permuted
   common prefixes mark the windows that share ``LENGTH`` bytes with a neighbour in order.
   An anchor of more than ``VARIANTS`` different strings would not fit a shard; its windows
   are counted one by one by two hashes instead, so no group is gathered.
4. Marked windows return to their documents, whose texts are read again and cut.

Steps 2 and 4 shuffle rows of one run or text each; counting uses windows that spill.
Hashes have 64 bits; equal strings are told by two of them.

The same steps work on words: ``remove`` can cut every passage of so many words that
starts anywhere else instead, whatever bytes it has. Its windows are that many consecutive
words, without the spaces and ASCII punctuation around each; a character of a script
written without spaces (U+3000 to U+9FFF) is a word; the symbols of the suffix arrays are then
words (``words_of``). ``summary`` can tell of such passages beside the strings: both rules pass
the steps together, told apart by an anchor's last bit.

Defined cases: null or empty texts have no bytes and lose none; texts shorter than ``LENGTH``
lose none; a repeated row is a document of its own, so its long strings go from both; a
string may overlap its own repeat; an empty table gives no rows; other columns are kept
by ``remove`` and not read otherwise.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from candlemill.llm.blocks import ALNUM_WORD, SPACE_WORD, U, Block, blocks, mix, signed, words
from candlemill.llm.jobs import aside, keep, row_key, spread
from candlemill.llm.suffixes import Prefix, common_prefixes, ranges, suffix_array

LENGTH = 400
GRAM = 160
#: Bytes of a shard's suffix array, and different strings of one anchor it may hold.
SHARD = 1 << 19
VARIANTS = 1024
SALTS = 61
#: Parts of the places that an anchor can have in a window.
PARTS = 8
#: Bytes of a block whose texts are only cut; its units are bigger than its bytes.
CUT_BYTES = 1 << 18
#: Bytes of a block whose runs are looked for, at about a hundred bytes of arrays each.
RUN_BYTES = 1 << 19
#: Words of the grams that choose a passage's anchor.
WORD_GRAM = 20

_CORE = ALNUM_WORD.copy()
_CORE[0x41:0x5B] = True
#: Leading bytes of U+3000 to U+9FFF.
_IDEOGRAPH = np.zeros(256, bool)
_IDEOGRAPH[0xE3:0xEA] = True


@dataclass
class Units:
    """What windows are made of: places in ``data`` (which is compared) and in the text (which is cut), rows and each row's first unit."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray
    begin: np.ndarray
    stop: np.ndarray


def bytes_of(block: Block) -> Units:
    at = np.arange(len(block.data) + 1)
    return Units(block.data, at[:-1], at[1:], np.repeat(np.arange(block.rows), np.diff(block.offsets)), block.offsets, at[:-1], at[1:])


def byte_symbols(u: Units) -> tuple[np.ndarray, int]:
    return u.data, 256


def word_symbols(u: Units) -> tuple[np.ndarray, int]:
    """Different words by different numbers, and how many there are."""
    data, seen = u.data.tobytes(), {}
    number = [seen.setdefault(data[a:b], len(seen)) for a, b in zip(u.start.tolist(), u.end.tolist(), strict=True)]
    return np.array(number, np.int32), len(seen)


def words_of(block: Block) -> Units:
    """Words from their first to their last letter or digit; data has a space before the first and after every one, and units take both."""
    w = words(block, SPACE_WORD)
    begin, stop, row = w.start, w.end, w.row
    wide = np.flatnonzero(_IDEOGRAPH[block.data])
    if len(wide):
        # a wide character ends what stands before it, and its three bytes are a word
        edge = np.zeros(len(block.data) + 4, bool)
        edge[wide] = edge[wide + 3] = True
        edge = np.flatnonzero(edge)
        which = np.searchsorted(begin, edge, side="right") - 1
        inside = (which >= 0) & (edge > begin[which]) & (edge < stop[which])
        edge, which = edge[inside], which[inside]
        order = np.argsort(np.concatenate([begin, edge]), kind="stable")
        row = np.concatenate([row, row[which]])[order]
        begin, stop = np.sort(np.concatenate([begin, edge])), np.sort(np.concatenate([stop, edge]))
    # most words begin and end with a letter or digit; the others are looked up
    core = _CORE[block.data]
    odd = np.flatnonzero(~(core[begin] & core[stop - 1]))
    if len(odd):
        core = np.flatnonzero(core)
        lo, hi = np.searchsorted(core, begin[odd]), np.searchsorted(core, stop[odd])
        some, none = hi > lo, odd[hi <= lo]
        begin[odd[some]], stop[odd[some]] = core[lo[some]], core[hi[some] - 1] + 1
        begin, stop, row = (np.delete(x, none) for x in (begin, stop, row))
    size = stop - begin
    # each row begins with a space
    to = np.cumsum(size + 1) - size + row
    at, _ = ranges(begin, size)
    data = np.full(int((size + 1).sum()) + block.rows, 0x20, np.uint8)
    data[at + np.repeat(to - begin, size)] = block.data[at]
    return Units(data, to - 1, to + size + 1, row, np.searchsorted(row, np.arange(block.rows + 1)), begin, stop)


@dataclass
class Rule:
    """Windows of ``length`` units, anchored by grams of ``gram``; ``symbols`` gives equal units one number."""

    units: Callable[[Block], Units]
    symbols: Callable[[Units], tuple[np.ndarray, int]]
    length: int
    gram: int

    @property
    def cuts(self) -> list[int]:
        """Part k's windows have from cuts[k] to cuts[k + 1] units before their gram."""
        return [(self.length - self.gram) * k // PARTS for k in range(PARTS + 1)]


def bytes_rule(length: int) -> Rule:
    return Rule(bytes_of, byte_symbols, length, min(length, GRAM))


def words_rule(length: int) -> Rule:
    return Rule(words_of, word_symbols, length, min(length, WORD_GRAM))


def run_rows(block: Block, rule: Rule) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor: row, first and last + 1 window start, anchor and its place after the first start, string hash."""
    u, length, gram = rule.units(block), rule.length, rule.gram
    off = u.first
    n = len(u.start)
    empty = {k: np.zeros(0, np.int64) for k in ("row", "lo", "hi", "at", "anchor", "sup")}
    if n < length:
        return empty
    p = Prefix(u.data)
    grams = n - gram + 1
    at = np.arange(grams)
    h = mix(p.of(u.start[:grams], u.end[gram - 1 :]))
    # leftmost least gram: compare by the hash's leading bits, then by position
    bits = U(max(1, int(n).bit_length()))
    key = ((h >> bits) << bits) | at.astype(U)
    w = length - gram + 1
    pad = -len(key) % w
    k = np.concatenate([key, np.full(pad, ~U(0))]).reshape(-1, w)
    left = np.minimum.accumulate(k, axis=1).ravel()
    right = np.minimum.accumulate(k[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - length + 1
    least = np.minimum(right[:starts], left[w - 1 : w - 1 + starts])
    where = (least & ((U(1) << bits) - U(1))).astype(np.int64)
    del at, key, k, left, right, least
    row = u.row[:starts]
    inside = np.arange(starts) + length <= off[row + 1]
    new = np.concatenate([[True], (where[1:] != where[:-1]) | (row[1:] != row[:-1]) | ~inside[:-1]])
    first = np.flatnonzero(new & inside)
    if not len(first):
        return empty
    # a run ends where the next one starts, or at its text's last window
    bound = np.append(np.flatnonzero(new), starts)
    hi = np.minimum(bound[np.searchsorted(bound, first, side="right")], off[row[first] + 1] - length + 1)
    r = row[first]
    span = (hi - first).astype(U)
    sup = mix(p.of(u.start[first], u.end[hi + length - 2]) + mix(span * U(1 << 20) + (where[first] - first).astype(U)))
    return {"row": r, "lo": first - off[r], "hi": hi - off[r], "at": where[first] - first, "anchor": signed(h[where[first]]), "sup": signed(sup)}


def first_equal(anchor: np.ndarray, sup: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is no equal pair before this one?, number of equal pairs) of each pair."""
    order = np.lexsort((sup, anchor))
    a, s = anchor[order], sup[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (s[1:] != s[:-1])
    size = np.diff(np.append(np.flatnonzero(new), len(a)))
    first, count = np.empty(len(a), bool), np.empty(len(a), np.int64)
    first[order], count[order] = new, np.repeat(size, size)
    return first, count


def runs(docs: DataFrame, text: str, rules: list[Rule]) -> DataFrame:
    """(_k1, _k2, lo, hi, at, anchor, sup) rows of every text; the last bit of an anchor is its rule."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy() for i in range(2))
            for b in blocks(batch.column(2), lower=False, limit=RUN_BYTES):
                for kind, rule in enumerate(rules):
                    x = run_rows(b, rule)
                    row = b.first + x["row"]
                    anchor = (x["anchor"] & np.int64(-2)) | np.int64(kind)
                    # strings that the block holds more than once are repeats already: one of them stands for
                    # the others in the counts (weight 2), which are dealt anywhere (salt)
                    first, n = first_equal(anchor, x["sup"])
                    salt = 1 + np.arange(len(row)) % SALTS
                    salt[first] = 0
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(k1[row]), pa.array(k2[row]), *(pa.array(x[c].astype(np.int32)) for c in ("lo", "hi", "at")), pa.array(anchor), pa.array(x["sup"]), pa.array(salt.astype(np.int32)), pa.array(np.minimum(n, 2).astype(np.int32))],
                        names=["_k1", "_k2", "lo", "hi", "at", "anchor", "sup", "salt", "weight"],
                    )

    return docs.select("_k1", "_k2", text).mapInArrow(run, "_k1 long, _k2 long, lo int, hi int, at int, anchor long, sup long, salt int, weight int")


def met(rows: DataFrame) -> DataFrame:
    """Runs whose anchor occurs again, with: copies of the string, its first run?, strings of the anchor."""
    dealt = spread(rows, None, "anchor", "salt").sortWithinPartitions("anchor", "salt", "sup", "_k1", "_k2", "lo")
    by, each = Window.partitionBy("anchor", "salt"), Window.partitionBy("anchor", "salt", "sup")
    known = F.col("salt") > 0
    found = dealt.withColumn("_t", F.sum("weight").over(by)).filter(known | (F.col("_t") > 1)).drop("_t")
    first = ~known & (F.row_number().over(each.orderBy("_k1", "_k2", "lo")) == 1)
    found = found.withColumn("copies", F.when(known, 2).otherwise(F.sum("weight").over(each))).withColumn("first", first)
    return keep(found.withColumn("variants", F.sum(F.col("first").cast("long")).over(by)).drop("salt", "weight"), "runs")


def fetched(docs: DataFrame, wanted: DataFrame, text: str, rules: list[Rule]) -> DataFrame:
    """(anchor, sup, many, at, n, cores, piece): the bytes of wanted runs, cut from their texts, and hashes of each part's core (null: not in it)."""
    needed = wanted.groupBy("_k1", "_k2").agg(F.collect_list(F.struct("lo", "hi", "at", "anchor", "sup", (F.col("variants") > VARIANTS).alias("many"))).alias("want"))
    # one text for a key, also where rows repeat
    texts = docs.join(needed, ["_k1", "_k2"]).dropDuplicates(["_k1", "_k2"]).select("want", text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(1), lower=False, limit=CUT_BYTES):
                want = batch.column(0).slice(b.first, b.rows)
                row, flat = np.repeat(np.arange(b.rows), want.value_lengths().to_numpy()), want.flatten()
                all_lo, all_hi, all_at, anchors, sups, many = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("lo", "hi", "at", "anchor", "sup", "many"))
                for kind, rule in enumerate(rules):
                    mine = np.flatnonzero((anchors & 1) == kind)
                    if not len(mine):
                        continue
                    u = rule.units(b)
                    data, p = u.data.tobytes(), Prefix(u.data)
                    lo, hi, at = all_lo[mine], all_hi[mine], all_at[mine]
                    begin = u.first[row[mine]] + lo
                    stop = begin + (hi - lo) + rule.length - 1
                    gram, cuts = begin + at, rule.cuts
                    cores, lacks = np.zeros((len(mine), PARTS), np.int32), np.ones((len(mine), PARTS), bool)
                    for k in range(PARTS):
                        # these windows hold the least before the gram and the least after it as a whole
                        after = rule.length - cuts[k + 1]
                        some = np.flatnonzero((at >= cuts[k]) & (gram + after <= stop))
                        cores[some, k] = signed(mix(p.of(u.start[gram[some] - cuts[k]], u.end[gram[some] + after - 1]))).astype(np.int32)
                        lacks[some, k] = False
                    piece = [data[s:e] for s, e in zip(u.start[begin].tolist(), u.end[stop - 1].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchors[mine]), pa.array(sups[mine]), pa.array(many[mine]), pa.array(at), pa.array(hi - lo),
                         pa.ListArray.from_arrays(pa.array(np.arange(len(mine) + 1, dtype=np.int32) * np.int32(PARTS)), pa.array(cores.ravel(), mask=lacks.ravel())), pa.array(piece, pa.binary())],
                        names=["anchor", "sup", "many", "at", "n", "cores", "piece"],
                    )

    return texts.mapInArrow(run, "anchor long, sup long, many boolean, at int, n int, cores array<int>, piece binary")


def repeats(pieces: list[bytes], lo: np.ndarray, hi: np.ndarray, rule: Rule) -> list[np.ndarray]:
    """For each piece, the window starts in [lo, hi) whose window occurs again among the pieces' windows of these bounds."""
    # pieces consist of whole units, which are the symbols
    u = rule.units(Block(0, np.frombuffer(b"".join(pieces), np.uint8), np.append(0, np.cumsum([len(p) for p in pieces]))))
    symbols, sigma = rule.symbols(u)
    size = hi - lo + rule.length - 1
    symbols = symbols[ranges(u.first[:-1] + lo, size)[0]]
    first, n = np.append(0, np.cumsum(size)), len(symbols)
    to = np.arange(n) + np.repeat(np.arange(len(size)), size)
    t = np.zeros(n + len(size) + 1, np.uint16 if sigma < 1 << 10 else np.int32)
    t[to] = symbols.astype(t.dtype) + 2
    t[first[1:] + np.arange(len(size))] = 1
    prefix = Prefix(t)
    sa = suffix_array(t, sigma + 2)
    shared = common_prefixes(t, sa, prefix)
    # the longer of the prefixes shared with the neighbours before and after in order
    most = shared.copy()
    most[sa[:-1]] = np.maximum(shared[sa[:-1]], shared[sa[1:]])
    # a window of a piece is in it as a whole, so the match holds no separator
    again = most[to] >= rule.length
    return [start + np.flatnonzero(again[a : b - rule.length + 1]) for start, a, b in zip(lo.tolist(), first[:-1].tolist(), first[1:].tolist(), strict=True)]


def alike(group: list[tuple], rule: Rule) -> list[tuple]:
    """(anchor, sup, piece, lo, hi) of the strings of one anchor that have a core in common with another: their windows from the first such part to the last."""
    count = [Counter(c) for c in zip(*(g[4] for g in group), strict=True)]
    cuts, out = rule.cuts, []
    for anchor, sup, at, n, cores, piece in group:
        parts = [k for k, c in enumerate(cores) if c is not None and count[k][c] > 1]
        if parts:
            lo, hi = max(0, at - cuts[parts[-1] + 1]), min(n, at - cuts[parts[0]] + 1)
            if lo < hi:
                out.append((anchor, sup, piece, lo, hi))
    return out


def sorted_shards(pieces: DataFrame, rules: list[Rule]) -> DataFrame:
    """(anchor, sup, starts): repeated windows of each string, by suffix arrays of whole anchors."""
    dealt = spread(pieces.filter("not many").select("anchor", "sup", "at", "n", "cores", "piece"), None, "anchor").sortWithinPartitions("anchor")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple]] = [[] for _ in rules]
        size = [0 for _ in rules]

        def out(kind: int) -> pa.RecordBatch:
            rows, held[kind], size[kind] = held[kind], [], 0
            found = repeats([r[2] for r in rows], np.array([r[3] for r in rows]), np.array([r[4] for r in rows]), rules[kind])
            some = [i for i, f in enumerate(found) if len(f)]
            return pa.RecordBatch.from_arrays(
                [pa.array([rows[i][0] for i in some], pa.int64()), pa.array([rows[i][1] for i in some], pa.int64()), pa.array([found[i].astype(np.int32) for i in some], pa.list_(pa.int32()))],
                names=["anchor", "sup", "starts"],
            )

        def close(group: list[tuple]) -> Iterator[pa.RecordBatch]:
            kind = group[0][0] & 1
            some = alike(group, rules[kind])
            held[kind] += some
            size[kind] += sum(len(g[2]) for g in some)
            if size[kind] >= SHARD:
                yield out(kind)

        group: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if group and row[0] != group[0][0]:
                    yield from close(group)
                    group = []
                group.append(row)
        if group:
            yield from close(group)
        for kind, rows in enumerate(held):
            if rows:
                yield out(kind)

    return dealt.mapInArrow(run, "anchor long, sup long, starts array<int>")


def counted_windows(pieces: DataFrame, rules: list[Rule]) -> DataFrame:
    """The same for anchors of very many strings: every window of a part whose core occurs again is a row, counted by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            kinds = whole.column(0).to_numpy() & 1
            for kind, rule in enumerate(rules):
                batch, cuts = whole.filter(pa.array(kinds == kind)), rule.cuts
                anchor, sup, at, n = (batch.column(i).to_numpy() for i in range(4))
                parts = batch.column(4).to_pylist()
                for b in blocks(batch.column(5), lower=False, limit=CUT_BYTES):
                    u = rule.units(b)
                    p = Prefix(u.data)
                    starts = []
                    for i in range(b.first, b.first + b.rows):
                        wanted = np.zeros(cuts[-1] + 1, bool)
                        for k in parts[i]:
                            wanted[cuts[k] : cuts[k + 1] + 1] = True
                        starts.append(np.flatnonzero(wanted[at[i] - np.arange(n[i])]))
                    row, rel = np.repeat(np.arange(b.rows), [len(x) for x in starts]), np.concatenate(starts)
                    s = u.first[row] + rel
                    one = mix(p.of(u.start[s], u.end[s + rule.length - 1]) + U(kind))
                    two = mix(Prefix(u.data, 1).of(u.start[s], u.end[s + rule.length - 1]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor[b.first + row]), pa.array(sup[b.first + row]), pa.array(rel.astype(np.int32)), pa.array(signed(one)), pa.array(signed(two))], names=["anchor", "sup", "at", "one", "two"]
                    )

    many = pieces.filter("many")
    cores = many.select("anchor", "sup", F.posexplode("cores").alias("k", "core")).filter("core is not null")
    met_again = cores.groupBy("anchor", "k", "core").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    parts = cores.join(met_again, ["anchor", "k", "core"], "left_semi").groupBy("anchor", "sup").agg(F.collect_list("k").alias("parts"))
    rows = keep(many.join(parts, ["anchor", "sup"]).select("anchor", "sup", "at", "n", "parts", "piece").mapInArrow(run, "anchor long, sup long, at int, one long, two long"), "windows")
    again = rows.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("one", "two")
    return rows.join(again, ["one", "two"], "left_semi").groupBy("anchor", "sup").agg(F.collect_list("at").alias("starts"))


def marked(docs: DataFrame, text: str, rules: list[Rule]) -> DataFrame:
    """(_k1, _k2, kind, from, to): window starts of each text whose window occurs again, by rule."""
    found = met(runs(docs, text, rules))
    wanted = found.filter("first and variants > 1").select("_k1", "_k2", "lo", "hi", "at", "anchor", "sup", "variants")
    pieces = keep(fetched(docs, wanted, text, rules), "pieces")
    marks = sorted_shards(pieces, rules).unionByName(counted_windows(pieces, rules))
    kind = F.col("anchor").bitwiseAND(F.lit(1)).cast("int").alias("kind")
    whole = found.filter("copies > 1").select("_k1", "_k2", kind, F.col("lo").alias("from"), F.col("hi").alias("to"))
    part = (
        found.filter("copies = 1 and variants > 1").join(marks, ["anchor", "sup"])
        .select("_k1", "_k2", kind, F.explode("starts").alias("s"), "lo").select("_k1", "_k2", "kind", (F.col("lo") + F.col("s")).alias("from"), (F.col("lo") + F.col("s") + 1).alias("to"))
    )
    return whole.unionByName(part)


def repeated(docs: DataFrame, text: str, rules: list[Rule]) -> DataFrame:
    """(_k1, _k2, at): ranges [from, to) of window starts of each text whose window occurs again, by rule."""
    # equal rows share their key and bring the same ranges: a set, so that their number does not count
    return marked(docs, text, rules).groupBy("_k1", "_k2").agg(F.collect_set(F.struct("kind", "from", "to")).alias("at"))


def covered(u: Units, rule: Rule, row: int, lo: np.ndarray, hi: np.ndarray, offset: int) -> tuple[list[int], list[int]]:
    """Maximal byte spans of a row's text under windows that start in [lo, hi)."""
    if not len(lo):
        return [], []
    f = u.begin[u.first[row] + lo] - offset
    t = u.stop[u.first[row] + hi + rule.length - 2] - offset
    order = np.argsort(f, kind="stable")
    f, t = f[order], np.maximum.accumulate(t[order])
    start = np.flatnonzero(np.concatenate([[True], f[1:] > t[:-1]]))
    return f[start].tolist(), t[np.append(start[1:], len(f)) - 1].tolist()


def cut_rows(docs: DataFrame, text: str, rules: list[Rule], schema: str | StructType, columns: list[str], make: Callable) -> DataFrame:
    """Join texts with their marked windows; ``make(bytes, from, to, ...)`` gives each row's values from the spans under each rule."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    fields = to_arrow_schema(_parse_datatype_string(schema) if isinstance(schema, str) else schema)
    extra = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(extra), lower=False, limit=CUT_BYTES):
                data = b.data.tobytes()
                at = batch.column(extra + 1).slice(b.first, b.rows)
                some, flat = at.is_valid().to_numpy(zero_copy_only=False), at.flatten()
                kind, lo, hi = (flat.field(c).to_numpy() for c in ("kind", "from", "to"))
                bound = np.append(0, np.cumsum(at.value_lengths().fill_null(0).to_numpy()))
                units = [rule.units(b) if (kind == k).any() else None for k, rule in enumerate(rules)]
                out = []
                for i in range(b.rows):
                    piece = data[b.offsets[i] : b.offsets[i + 1]]
                    if not some[i]:
                        out.append(make(piece, *[()] * (2 * len(rules))))
                        continue
                    spans = []
                    for k, rule in enumerate(rules):
                        mine = bound[i] + np.flatnonzero(kind[bound[i] : bound[i + 1]] == k)
                        spans += covered(units[k], rule, i, lo[mine], hi[mine], b.offsets[i])
                    out.append(make(piece, *spans))
                made = list(zip(*out, strict=True))
                cut = [batch.column(c).slice(b.first, b.rows) for c in range(extra)]
                yield pa.RecordBatch.from_arrays([*cut, *(pa.array(list(v), fields.field(extra + c).type) for c, v in enumerate(made))], schema=fields)

    joined = docs.join(repeated(docs, text, rules), ["_k1", "_k2"], "left")
    return joined.select(*columns, text, "at").mapInArrow(run, schema)


def kept_pieces(piece: bytes, start: list[int], end: list[int]) -> list[bytes]:
    return [piece[a:b] for a, b in zip([0, *end], [*start, len(piece)], strict=True)]


def summary(docs: DataFrame, text: str = "text", length: int = LENGTH, passage: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row.

    With ``passage``, also n_passages and passage_bytes: the maximal spans of text under passages of so many words
    that start anywhere else, too, and their bytes. They are told, not removed.
    """
    keyed = row_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text), "doc_id", text)
    rules = [bytes_rule(length), *([words_rule(passage)] if passage else [])]

    def make(piece: bytes, start: list[int], end: list[int], *passages: list[int]) -> tuple:
        digest = hashlib.sha256()
        for p in kept_pieces(piece, start, end):
            digest.update(p)
        more = (len(passages[0]), sum(passages[1]) - sum(passages[0])) if passages else ()
        return len(piece), sum(end) - sum(start), len(start), digest.hexdigest(), *more

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", n_passages long, passage_bytes long" if passage else "")
    return cut_rows(keyed, text, rules, schema, ["doc_id"], make)


def remove(docs: DataFrame, text: str = "text", length: int = LENGTH, passage: int | None = None) -> DataFrame:
    """The rows with repeated strings cut out of ``text``, and the number of cuts in ``_spans``.

    Strings of ``length`` bytes are cut, or passages of ``passage`` words if given. Broken characters at the cuts go, too.
    """
    names = [c for c in docs.columns if c not in (text, "_spans")]
    at = f"c{names.index('doc_id')}"
    keyed = row_key(aside(docs, text, names), at, "text")
    rule = words_rule(passage) if passage else bytes_rule(length)

    def make(piece: bytes, start: list[int], end: list[int]) -> tuple:
        return ("".join(p.decode("utf-8", "ignore") for p in kept_pieces(piece, start, end)), len(start))

    held = [f"c{i}" for i in range(len(names))]
    schema = StructType([*(keyed.schema[h] for h in held), StructField("cut", StringType()), StructField("spans", LongType())])
    out = cut_rows(keyed, "text", [rule], schema, held, make)
    back = {c: F.col(h) for c, h in zip(names, held, strict=True)} | {text: F.col("cut")}
    return out.select(*[back[c].alias(c) for c in docs.columns if c != "_spans"], F.col("spans").alias("_spans"))
