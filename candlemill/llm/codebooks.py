"""Vector code compression: product codes over integer vectors, assigned by a Walsh-Hadamard search.

Components become integers, floor(scale * x); vectors are cut into equal consecutive parts, each with a
codebook of up to 256 entries that starts as the parts of the least ids. Every round assigns each part
to its nearest entry (ties to the lower index) and moves entries to the floored means of their parts.

The nearest entry is searched exactly and without floating point: parts and entries are padded with
zeros to P = 2^k components and transformed by the integer Walsh-Hadamard transform, under which squared
distances grow by exactly P. Squared differences are added in order of sequency, so partial sums only
grow; the entry that leads after the first coefficients is summed in full, and every entry whose partial
sum exceeds that sum is given up. Survivors are summed on, coefficients at a time, and the least wins.

A round is one pass over the rows: a task adds up its own parts by entry, and one row for each part, entry
and component leaves it, which Spark sums; the codebooks (256 entries x dimension integers, whatever the
table) pass the driver and are broadcast. No vector is shuffled.

Defined cases: rows whose vector is null or has a null or non-finite component are dropped; null ids come
last among the ids, rows of one id in the order of their components; vectors of different lengths are
extended by zeros to the longest, and that to a multiple of the number of parts; fewer rows than 256 start
fewer entries; unused entries stay; repeated rows are rows of their own; null labels are one label; an
empty table gives no rows. Integers beyond 2^30 / P in size are a ValueError (at 64 dimensions: components
of 65,536 and more), as sums would leave 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from candlemill.llm.integers import floors, padded, power_of_two, sequency_order, walsh_hadamard
from candlemill.llm.jobs import keep

#: Rows that are searched side by side.
TILE = 512
#: Labels with more than this share of the rows meet their sums by broadcast; so at most 1,023 do.
HOT_SHARE = 1 / 1024


@dataclass(frozen=True)
class Shape:
    """How vectors are cut: ``parts`` of ``size`` components each, padded to ``wide`` for the transform."""

    parts: int
    size: int
    scale: int

    @property
    def width(self) -> int:
        return self.parts * self.size

    @property
    def wide(self) -> int:
        return power_of_two(max(1, self.size))

    @property
    def most(self) -> int:
        return (1 << 30) // self.wide

    def vectors(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers of the vectors that are kept, and their parts (row, part, component)."""
        rows, x = floors(column, self.scale, self.width, self.most)
        return rows, x.reshape(len(rows), self.parts, self.size)

    def transformed(self, x: np.ndarray) -> np.ndarray:
        return walsh_hadamard(padded(x, self.wide))[..., sequency_order(self.wide)]


def nearest(y: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry; both sides transformed, in sequency order."""
    n, wide = y.shape
    step = max(1, wide // 4)
    total = np.zeros((n, len(entries)), np.int64)
    for c in range(step):
        d = y[:, c, None] - entries[None, :, c]
        total += d * d
    lead = total.argmin(axis=1)
    d = y - entries[lead]
    bound = (d * d).sum(axis=1)
    i, j = np.nonzero(total <= bound[:, None])
    total = total[i, j]
    for lo in range(step, wide, step):
        d = y[i, lo : lo + step] - entries[j, lo : lo + step]
        total = total + (d * d).sum(axis=1)
        alive = total <= bound[i]
        i, j, total = i[alive], j[alive], total[alive]
    first = np.searchsorted(i, np.arange(n))
    least = np.minimum.reduceat(total, first) if n else np.zeros(0, np.int64)
    # survivors are in order of row and entry: the first of the least
    hit = np.flatnonzero(total == least[i])
    _, one = np.unique(i[hit], return_index=True)
    return j[hit[one]], least // wide


def assign(x: np.ndarray, books: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Codes and squared distances (row, part) of parts under codebooks (part, entry, component)."""
    code, error = np.zeros(x.shape[:2], np.int64), np.zeros(x.shape[:2], np.int64)
    entries = shape.transformed(books)
    for lo in range(0, len(x), TILE):
        y = shape.transformed(x[lo : lo + TILE])
        for p in range(shape.parts):
            code[lo : lo + TILE, p], error[lo : lo + TILE, p] = nearest(y[:, p], entries[p])
    return code, error


def start(rows: DataFrame, shape: Shape, entries: int) -> np.ndarray:
    """Codebooks of the parts of the least ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = shape.vectors(batch.column(1))
            off = np.arange(len(at) + 1, dtype=np.int32) * shape.width
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.ListArray.from_arrays(pa.array(off), pa.array(x.ravel()))], names=["id", "q"])

    first = rows.select("id", "v").mapInArrow(run, "id long, q array<long>").orderBy(F.asc_nulls_last("id"), "q").limit(entries).collect()
    x = np.array([r.q for r in first], np.int64).reshape(len(first), shape.parts, shape.size)
    return np.ascontiguousarray(x.transpose(1, 0, 2))


def moved(rows: DataFrame, books: np.ndarray, shape: Shape) -> np.ndarray:
    """Codebooks after one round: floored means of the parts that each entry is nearest to."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    parts, entries, size = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the last place counts
        sums = np.zeros((parts, entries, size + 1), np.int64)
        for batch in batches:
            _, x = shape.vectors(batch.column(0))
            code, _ = assign(x, shared.value, shape)
            for p in range(parts):
                np.add.at(sums[p, :, :size], code[:, p], x[:, p])
                np.add.at(sums[p, :, size], code[:, p], 1)
        slot = np.flatnonzero(np.repeat(sums[..., -1] > 0, size + 1))
        for lo in range(0, len(slot), 1 << 16):
            part = slot[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(sums.ravel()[part])], names=["slot", "total"])

    summed = rows.select("v").mapInArrow(run, "slot long, total long").groupBy("slot").agg(F.sum("total").alias("total")).toArrow()
    sums = np.zeros((parts, entries, size + 1), np.int64)
    sums.reshape(-1)[summed.column(0).to_numpy()] = summed.column(1).to_numpy()
    n = sums[..., -1:]
    return np.where(n > 0, sums[..., :size] // np.maximum(n, 1), books)


@dataclass(frozen=True)
class Codebooks:
    """Learned codebooks: integers by part, entry and component."""

    books: np.ndarray
    shape: Shape

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def pick(df: DataFrame, key: str, vector: str, label: str | None) -> DataFrame:
    """(id, label, v) under names of our own."""
    return df.select(F.col(f"`{key}`").cast("long").alias("id"), (F.col(f"`{label}`") if label else F.lit(None).cast("int")).alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("v"))


def learn(df: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> Codebooks:
    rows = pick(df, key, vector, None)
    # a vector that is dropped later may be the longest: its length is not asked for
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    longest = rows.where(F.col("v").isNotNull() & whole).agg(F.max(F.size("v"))).first()[0] or 0
    shape = Shape(parts, -(-longest // parts), scale)
    books = start(rows, shape, entries)
    for _ in range(rounds if books.size else 0):
        books = moved(rows, books, shape)
    return Codebooks(books, shape)


def encode(df: DataFrame, model: Codebooks, key: str = "vec_id", vector: str = "embedding", label: str | None = "label") -> DataFrame:
    """(id, label, code, error) of every kept row: two hex digits a part, and the squared distance of all parts."""
    rows = pick(df, key, vector, label)
    shared = rows.sparkSession.sparkContext.broadcast((model.books, model.shape))
    schema = StructType([StructField("id", LongType()), StructField("label", rows.schema["label"].dataType), StructField("code", StringType()), StructField("error", LongType())])
    hex_digits = np.array([f"{i:02x}" for i in range(256)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, shape = shared.value
        for batch in batches:
            at, x = shape.vectors(batch.column(2))
            code, error = assign(x, books, shape) if len(at) and books.shape[1] else (np.zeros((len(at), shape.parts), np.int64), np.zeros((len(at), shape.parts), np.int64))
            names = ["".join(r) for r in hex_digits[code].tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(names, pa.string()), pa.array(error.sum(axis=1))], names=schema.names
            )

    return rows.mapInArrow(run, schema)


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every kept row."""
    model = learn(df, key, vector)
    rows = keep(encode(df, model, key, vector, label), "codes")
    sums = keep(rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("rows")), "labels")
    total = sums.agg(F.sum("rows")).first()[0] or 0
    hot = sums.where(F.col("rows") > total * HOT_SHARE).select(F.col("label").alias("of"), "label_error")
    rest = sums.where(F.col("rows") <= total * HOT_SHARE).select(F.col("label").alias("of"), "label_error")
    same = rows.label.eqNullSafe(F.col("of"))
    both = rows.join(F.broadcast(hot), same).unionByName(rows.join(F.broadcast(hot.select("of")), same, "left_anti").join(rest, same))
    return both.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(model.sha256()).alias("codebooks_sha256"))
