"""Token counts of whole texts under a byte-level BPE tokenizer, without materialising ids.

A byte-level tokenizer cuts a text into pre-tokens and merges inside each, so a text's token
count is the sum over its pre-tokens of their piece counts.

1. Every distinct pre-token of the corpus is found with its number of occurrences (blocks emit
   their distinct pre-tokens, Spark sums them) and its pieces are counted once, by the library.
2. Texts are cut again into (text, pre-token, frequency). Frequencies of the most frequent
   pre-tokens, at most ``HOT``, meet their piece counts in the task, by broadcast; all others
   are joined by the pre-token itself. As at least about ``HOT`` are as frequent, a join key
   has hardly more than 1 / HOT of all occurrences. Products are summed per text.

Pre-tokens are cut in NumPy over code point classes (letter, number, space, other). A class is
asked of the library's own pre-tokenizer once for each character a worker meets, so that its
Unicode tables and these cannot differ. Texts longer than a block are cut between words first.

Special strings inside texts are one token each, as in the library's default; nothing is added,
truncated or padded. Tokenizers whose cutting this is not (another pre-tokenizer, a normalizer,
added tokens that swallow blanks) are a ValueError.

Defined cases: null or empty texts have 0 bytes and 0 tokens; broken UTF-8 is read as the
library reads replacement characters; repeated rows are rows of their own; an empty table gives no
rows; carried columns may have any name and any value. Inside a block of 1 MB, and among the hot
pre-tokens, pre-tokens are told apart by 64-bit hashes.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from candlemill.llm.blocks import BLOCK_BYTES, Lookup, signed, span_hashes, text_bytes
from candlemill.llm.jobs import keep

#: Most pre-tokens that are matched by broadcast: a hash and a count of each, 16 MB.
HOT = 1 << 20
#: Frequencies are told apart by classes, so many to a doubling.
CLASSES = 8

LETTER, NUMBER, SPACE, OTHER, SPECIAL, UNKNOWN = range(6)

# The endings that the byte-level pattern cuts off after an apostrophe.
ONE_LETTER_ENDINGS = "stmd"
TWO_LETTER_ENDINGS = ("re", "ve", "ll")


@functools.cache
def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def definition(path: str) -> str:
    """The tokenizer's JSON, checked to be one that ``Cutter`` cuts like the library."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    spec = json.loads(text)
    pre = spec.get("pre_tokenizer") or {}
    added = spec.get("added_tokens") or []
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    if not plain or spec.get("normalizer") or spec["model"]["type"] != "BPE" or spec["model"].get("dropout"):
        raise ValueError(f"{path}: not a plain byte-level BPE tokenizer")
    if any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word")):
        raise ValueError(f"{path}: added tokens that swallow blanks or need word ends")
    return text


@functools.lru_cache(maxsize=2)
def library(spec: str):
    """The library's tokenizer, once a worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_str(spec)
    out.no_truncation()
    out.no_padding()
    return out


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code point, byte position) of every character."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    if len(at) == len(data):
        return data.astype(np.int32), at
    padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32)
    lead = padded[at]
    out = lead.copy()
    for size, least, bits in ((2, 0xC0, 0x1F), (3, 0xE0, 0x0F), (4, 0xF0, 0x07)):
        which = np.flatnonzero((lead >= least) & ((lead < (0xE0, 0xF0, 0x100)[size - 2])))
        value = lead[which] & bits
        for k in range(1, size):
            value = value << 6 | padded[at[which] + k] & 0x3F
        out[which] = value
    return np.minimum(out, 0x10FFFF), at


@dataclass
class Cut:
    """Pre-tokens of a block: byte spans and the piece (row of the block) of each, and special strings by piece."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    special: np.ndarray


class Cutter:
    """Pre-tokens of byte blocks, cut as the library's byte-level pre-tokenizer cuts them."""

    def __init__(self, spec: str) -> None:
        self.ask = library(spec).pre_tokenizer.pre_tokenize_str
        self.kind = np.full(0x110000, UNKNOWN, np.uint8)
        self.kind[0xD800:0xE000] = OTHER
        names = sorted((t["content"] for t in json.loads(spec).get("added_tokens") or []), key=lambda s: (-len(s), s))
        self.specials = re.compile(b"|".join(re.escape(s.encode()) for s in names)) if names else None
        #: Bytes before which a long text is not cut.
        self.held = set("".join(names).encode())

    def classes(self, points: np.ndarray) -> np.ndarray:
        out = self.kind[points]
        if (out == UNKNOWN).any():
            for p in np.unique(points[out == UNKNOWN]).tolist():
                c = chr(p)
                found = [k for k, before in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(self.ask(before + c)) == 1]
                self.kind[p] = found[0] if found else SPACE
            out = self.kind[points]
        return out

    def special_spans(self, data: np.ndarray, off: np.ndarray) -> list[tuple[int, int]]:
        """Special strings that lie within one piece, leftmost and longest first."""
        if self.specials is None:
            return []
        buffer, at, out = data.tobytes(), 0, []
        while m := self.specials.search(buffer, at):
            s, e = m.span()
            inside = off[np.searchsorted(off, s, side="right")] >= e
            if inside:
                out.append((s, e))
            at = e if inside else s + 1
        return out

    def cut(self, data: np.ndarray, off: np.ndarray) -> Cut:
        """Pre-tokens of the pieces ``data[off[i]:off[i + 1]]``."""
        z = np.zeros(0, np.int64)
        if not len(data):
            return Cut(z, z, z, np.zeros(len(off) - 1, np.int64))
        points, at = code_points(data)
        kind, edges = self.classes(points), off[:-1][off[:-1] < len(data)]
        spans = self.special_spans(data, off)
        if spans:
            kind = kind.copy()
            edges = np.unique(np.concatenate([edges, np.array(spans).ravel()]))
            edges = edges[edges < len(data)]
            for s, e in np.searchsorted(at, np.array(spans)).tolist():
                kind[s:e] = SPECIAL
        n = len(points)
        # broken text may begin inside a character
        edge = np.unique(np.searchsorted(at, edges))
        edge = edge[edge < n]
        fresh = np.zeros(n + 1, bool)
        fresh[edge] = fresh[0] = fresh[n] = True
        begins = fresh[:n].copy()
        begins[1:] |= kind[1:] != kind[:-1]
        first = np.flatnonzero(begins)
        last = np.append(first[1:], n) - 1
        starts = begins
        # of blanks before a word the last one stays behind: it opens the word if it is a plain space
        blank = np.flatnonzero((kind[first] == SPACE) & ~fresh[last + 1])
        starts[last[blank]] = True
        glued = blank[points[last[blank]] == 0x20]
        starts[last[glued] + 1] = False
        # a lone apostrophe that opens a pre-token takes its ending with it
        lone = first[(first == last) & (points[first] == 0x27)]
        lone = lone[starts[lone] & (lone + 1 < n) & ~fresh[lone + 1]]
        lone = lone[kind[lone + 1] == LETTER]
        if len(lone):
            a = points[lone + 1]
            more = (lone + 2 < n) & ~fresh[np.minimum(lone + 2, n)]
            b = np.where(more, points[np.minimum(lone + 2, n - 1)], 0)
            size = np.isin(a, [ord(c) for c in ONE_LETTER_ENDINGS]).astype(np.int64)
            for x, y in TWO_LETTER_ENDINGS:
                size[(a == ord(x)) & (b == ord(y))] = 2
            lone, size = lone[size > 0], size[size > 0]
            starts[lone + 1] = False
            after = lone + 1 + size
            starts[after[after < n]] = True
        where = np.flatnonzero(starts)
        start = at[where]
        end = np.append(start[1:], len(data))
        row = np.searchsorted(off, start, side="right") - 1
        special = kind[where] == SPECIAL
        return Cut(start[~special], end[~special], row[~special], np.bincount(row[special], minlength=len(off) - 1))

    def pieces(self, data: np.ndarray, off: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Offsets after long texts are cut where a pre-token surely begins, and the text of each piece."""
        extra = []
        for i in np.flatnonzero(np.diff(off) > limit).tolist():
            lo, hi = int(off[i]), int(off[i + 1])
            while hi - lo > limit:
                # before an ASCII space or mark that stands between letters
                for reach in (4096, limit // 2, hi - lo):
                    part = data[lo + limit // 2 : min(hi, lo + limit // 2 + reach)]
                    letter = ((part | 0x20) >= 0x61) & ((part | 0x20) <= 0x7A)
                    mark = (part < 0x30) & (part >= 0x20) & (part != 0x27) & ~np.isin(part, list(self.held))
                    ok = np.flatnonzero(letter[:-2] & mark[1:-1] & letter[2:])
                    if len(ok):
                        break
                if not len(ok):
                    break
                lo += limit // 2 + int(ok[0]) + 1
                extra.append((i, lo))
        if not extra:
            return off, np.arange(len(off) - 1)
        cut = np.array([x for _, x in extra])
        places = np.concatenate([off, cut])
        rows = np.concatenate([np.arange(len(off)), [i for i, _ in extra]])
        order = np.lexsort((rows, places))
        # a cut lies strictly inside its text, so sorting by place keeps texts whole
        return places[order], rows[order][:-1]


@functools.lru_cache(maxsize=2)
def cutter(spec: str) -> Cutter:
    return Cutter(spec)


@dataclass
class Frequencies:
    """Per text of a batch (``row``) the distinct pre-tokens of one block: hash, frequency, and a span of ``data``."""

    data: np.ndarray
    row: np.ndarray
    hashes: np.ndarray
    n: np.ndarray
    start: np.ndarray
    end: np.ndarray
    special_row: np.ndarray
    special: np.ndarray


def frequencies(column: pa.Array, spec: str, limit: int = BLOCK_BYTES, by_text: bool = True) -> Iterator[Frequencies]:
    """Distinct pre-tokens of every text, a block at a time (of every block, if not ``by_text``)."""
    data, off = text_bytes(column)
    c = cutter(spec)
    off, text = c.pieces(data, off, limit)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        part = data[off[i] : off[j]]
        got = c.cut(part, off[i : j + 1] - off[i])
        h = span_hashes(part, got.start, got.end)
        row = text[i + got.row] if by_text else np.zeros(len(h), np.int64)
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])) if len(h) else np.zeros(0, np.int64)
        one = order[first]
        yield Frequencies(part, row[first], h[first], np.diff(np.append(first, len(h))), got.start[one], got.end[one], text[i:j], got.special)
        i = j


def spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Byte spans as a binary column."""
    size = end - start
    off = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(int(off[-1])) - np.repeat(off[:-1], size) + np.repeat(start, size)
    return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(data[at])]).cast(pa.binary())


def distinct_pretokens(docs: DataFrame, text: str, spec: str) -> DataFrame:
    """(token, n, h, pieces): every distinct pre-token with its occurrences, its hash and its number of pieces."""
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in frequencies(batch.column(0), shared.value, by_text=False):
                yield pa.RecordBatch.from_arrays([spans(f.data, f.start, f.end), pa.array(f.n)], names=["token", "n"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = library(shared.value).encode_batch_fast
        for whole in batches:
            for lo in range(0, len(whole), 4096):
                batch = whole.slice(lo, 4096)
                data, off = text_bytes(batch.column(0))
                h = span_hashes(data, off[:-1], off[1:])
                names = [t.decode("utf-8", "replace") for t in batch.column(0).to_pylist()]
                pieces = [len(e) for e in encode(names, add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(signed(h)), pa.array(pieces, pa.int64())], names=["token", "n", "h", "pieces"])

    once = docs.select(text).mapInArrow(found, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return once.mapInArrow(counted, "token binary, n long, h long, pieces long")


def frequent(tokens: DataFrame, most: int) -> Column:
    """Is a pre-token in one of the highest frequency classes, which hold ``most`` together at most?"""
    kind = F.floor(F.log2("n") * CLASSES)
    sizes = sorted(tokens.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("size")).collect(), reverse=True)
    held, least = 0, None
    for r in sizes:
        held += r["size"]
        if held > most:
            break
        least = r["kind"]
    return F.lit(False) if least is None else kind >= least


def count(
    docs: DataFrame, text: str = "text", carry: Sequence[str] = ("doc_id",), tokenizer: str | None = None, limit: int = 512, hot: int = HOT
) -> DataFrame:
    """The carried columns, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) of every row."""
    spec = definition(tokenizer or default_tokenizer())
    spark = docs.sparkSession
    tokens = keep(distinct_pretokens(docs, text, spec), "pretokens")
    is_hot = frequent(tokens, hot)
    table = tokens.where(is_hot).select("h", "pieces").toArrow()
    keys, pieces = (table.column(i).to_numpy() for i in range(2))
    order = np.argsort(keys.view(np.uint64))
    shared = spark.sparkContext.broadcast((spec, keys.view(np.uint64)[order], pieces[order]))
    held = [f"c{i}" for i in range(len(carry))]
    fields = [StructField(h, docs.schema[c].dataType) for h, c in zip(held, carry, strict=True)]
    schema = StructType([*fields, *_parse_datatype_string("id long, n_bytes long, n_tokens long, open long, token binary, n long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spec, keys, pieces = shared.value
        table = Lookup(keys)
        # unique in the table that is written from here
        row_id = TaskContext.get().partitionId() << 40
        for batch in batches:
            n, own = len(batch), batch.columns[:-1]
            size, total, left = np.diff(text_bytes(batch.column(len(own)))[1]), np.zeros(n, np.int64), np.zeros(n, np.int64)
            none = [pa.nulls(0, c.type) for c in own]
            for f in frequencies(batch.column(len(own)), spec):
                at = table.find(f.hashes)
                known = at >= 0
                np.add.at(total, f.row[known], f.n[known] * pieces[at[known]])
                np.add.at(total, f.special_row, f.special)
                cold = ~known
                if cold.any():
                    np.add.at(left, f.row[cold], 1)
                    k = int(cold.sum())
                    void = [pa.nulls(k, c.type) for c in none] + [pa.array(row_id + f.row[cold]), *[pa.nulls(k, pa.int64())] * 3]
                    yield pa.RecordBatch.from_arrays([*void, spans(f.data, f.start[cold], f.end[cold]), pa.array(f.n[cold])], names=schema.names)
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(row_id + np.arange(n)), pa.array(size), pa.array(total), pa.array(left), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())], names=schema.names
            )
            row_id += n

    packed = docs.select(*[F.col(f"`{c}`").alias(h) for c, h in zip(carry, held, strict=True)], F.col(f"`{text}`").alias("text"))
    parts = keep(packed.mapInArrow(run, schema), "frequencies")
    rows = parts.where("token is null")
    cold = parts.where("token is not null").select("id", "token", "n").join(tokens.where(~is_hot).select("token", "pieces"), "token")
    rest = cold.groupBy("id").agg(F.sum(F.col("n") * F.col("pieces")).alias("rest"))
    own = [*held, "n_bytes", "n_tokens"]
    late = rows.where("open > 0").join(rest, "id").withColumn("n_tokens", F.col("n_tokens") + F.col("rest")).select(*own)
    out = rows.where("open = 0").select(*own).unionByName(late)
    return out.select(*[F.col(h).alias(c) for h, c in zip(held, carry, strict=True)], "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
