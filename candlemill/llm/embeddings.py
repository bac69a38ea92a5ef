"""Embedding near-duplicates: an exact metric range join over pivot cells.

Unit vectors at cosine >= c lie within r = sqrt(2 - 2c). Each vector's home is the cell of
its nearest pivot. A pair within r is found in the home cell of either end if the other
end is copied there: y goes to pivot q's cell when it can be within r of a vector whose
nearest pivot is q. By the triangle inequality such a vector x has d(x, q) <= d(x, p), so
d(y, q) - d(y, p) <= 2r for y's own pivot p; the half-space form of the same bound,
(d(y, q)^2 - d(y, p)^2) / (2 d(p, q)) <= r, is tighter and is used. Each vector counts its
links in its home cell alone, so nothing is counted twice, and cells are independent.

Equal vectors are one vector with a weight (told by two hashes), so a group of exact
copies costs what one vector costs, and its rows take the result back afterwards.

No copies are made: a cell's homes are packed into blocks of at most ``BLOCK`` vectors, a row each, with the cells that any of
them may reach. Blocks are joined with the blocks that may reach them by a cartesian product, which reads the
table of blocks again and again and writes nothing, so disk grows with the vectors and not with the pairs of blocks, as
time does; a task holds two blocks. In a pair only vectors that may reach the cell are compared.
Products are taken in single precision and settled in double where they come near the
threshold. A block returns link counts and a spanning forest of its links, not the links.

Defined cases: null, empty or zero vectors, those with null or non-finite components and those
with a null vec_id link with nothing; vectors of different lengths do not link; equal vectors link; a
repeated vec_id is a vector of its own in the counts but shares its component; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlemill.llm.blocks import Forest
from candlemill.llm.jobs import components, keep

#: Vectors of a block, and the bytes of their components.
BLOCK = 4096
BLOCK_BYTES = 4 << 20
#: Vectors that a block meets at once.
MET = 1024
#: Vectors a pivot stands for; pivots grow with the table up to ``MOST_PIVOTS``.
PER_PIVOT = 4096
MOST_PIVOTS = 1024
#: Distance of single from double precision products that is settled in double.
SLACK = 1e-4
#: A group of equal vectors with more than this share of the rows is matched to them by broadcast; so at most 1,023 are.
HOT_SHARE = 1 / 1024

#: What names a vector: two hashes of it.
NAME = ["h1", "h2"]


def named(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v, h1, h2) of every row."""
    v = F.col(vector).cast("array<double>")
    return df.select(F.col(key).cast("long").alias("id"), v.alias("v"), F.xxhash64(v).alias("h1"), F.xxhash64(F.lit(7), F.size(v), F.reverse(v)).alias("h2"))


def scaled(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Vectors of length one (null where a vector has none that is finite), and their dimensions."""
    dim = column.value_lengths().to_numpy().astype(np.int64)
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    start, some = np.cumsum(dim) - dim, np.flatnonzero(dim > 0)
    peak, norm = np.zeros(len(dim)), np.zeros(len(dim))
    with np.errstate(all="ignore"):
        # by the largest component first, so squares neither vanish nor overflow
        peak[some] = np.maximum.reduceat(np.abs(x), start[some]) if len(some) else 0
        x = x / np.repeat(peak, dim)
        norm[some] = np.sqrt(np.add.reduceat(x * x, start[some])) if len(some) else 0
        x = x / np.repeat(norm, dim)
    fine = np.isfinite(peak) & (peak > 0)
    offsets = np.append(start, len(x)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(x), mask=pa.array(~fine)), dim


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """(h1, h2, id, weight, dim, v): each vector once, with its least id and the number of its rows, scaled to length one in double precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, dim = scaled(batch.column(4))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(dim.astype(np.int32)), v], names=[*NAME, "id", "weight", "dim", "v"])

    once = rows.groupBy(*NAME).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight"), F.first("v").alias("v"))
    return once.mapInArrow(run, "h1 long, h2 long, id long, weight long, dim int, v array<double>")


def pivots(units: DataFrame) -> dict[int, np.ndarray]:
    """Pivots by vector length: the vectors least in hash order, a bounded number of them."""
    n = units.count()
    most = int(min(MOST_PIVOTS, max(1, n // PER_PIVOT)))
    rows = units.orderBy(*NAME).limit(most).select("dim", "v").collect()
    out: dict[int, list] = {}
    for r in rows:
        out.setdefault(r.dim, []).append(r.v)
    return {d: np.unique(np.array(v), axis=0) for d, v in out.items()}


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(column), -1)


def distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Squared distances of vectors from points."""
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ p.T + (p * p).sum(axis=1)[None], 0)


def reaching(x: np.ndarray, p: np.ndarray, home: int, radius: float) -> np.ndarray:
    """(vectors, pivots): may a vector of cell ``home`` be within ``radius`` of one whose nearest pivot it is?"""
    d2 = distances(x, p)
    apart = np.sqrt(distances(p[home : home + 1], p)[0])
    reach = d2 - d2[:, home][:, None] <= 2 * radius * apart[None] + 1e-9
    reach[:, home] = True
    return reach


def points_of(points: dict[int, np.ndarray], dim: int) -> np.ndarray:
    found = points.get(dim)
    return np.zeros((1, dim)) if found is None else found


def cells(units: DataFrame, points: dict[int, np.ndarray]) -> DataFrame:
    """The vectors with the cell of their nearest pivot."""
    shared = units.sparkSession.sparkContext.broadcast(points)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), 2048):
                batch = whole.slice(lo, 2048)
                dims = batch.column(1).to_numpy()
                for dim in np.unique(dims):
                    part = batch.filter(pa.array(dims == dim))
                    near = distances(matrix(part.column(2)), points_of(shared.value, int(dim))).argmin(axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), dim, np.int32)), pa.array(near.astype(np.int32)), *(part.column(i) for i in (0, 3, 4, 5, 2))], names=["dim", "cell", "id", "weight", *NAME, "v"]
                    )

    return units.select("id", "dim", "v", "weight", *NAME).mapInArrow(run, "dim int, cell int, id long, weight long, h1 long, h2 long, v array<double>")


_BLOCK = "dim int, cell int, own string, reached array<string>, names binary, weights binary, v binary"


def packed(homes: DataFrame, points: dict[int, np.ndarray], radius: float) -> DataFrame:
    """A row for each block of vectors of one cell: ``own`` names the cell, ``reached`` all cells that any of them may reach."""
    shared = homes.sparkSession.sparkContext.broadcast(points)
    sizes = homes.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("homes"))
    # at most MOST_PIVOTS cells a vector length
    salted = homes.join(F.broadcast(sizes.select("dim", "cell", F.ceil(F.col("homes") / BLOCK).alias("blocks"))), ["dim", "cell"])
    key = ["dim", "cell", "block"]
    dealt = salted.select("dim", "cell", F.pmod("h2", "blocks").alias("block"), "id", "weight", *NAME, "v").repartition(*key).sortWithinPartitions(*key)

    def row(dim: int, cell: int, names: np.ndarray, weights: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        reached = np.flatnonzero(reaching(v, points_of(shared.value, dim), cell, radius).any(axis=0))
        values = [dim, cell, f"{dim}:{cell}", [f"{dim}:{q}" for q in reached.tolist()], names.tobytes(), weights.tobytes(), v.tobytes()]
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(values, kinds, strict=True)], names=[c.split()[0] for c in _BLOCK.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def flushed() -> Iterator[pa.RecordBatch]:
            if held:
                yield row(int(now[0]), int(now[1]), *(np.ascontiguousarray(np.concatenate(x)) for x in zip(*held, strict=True)))
                held.clear()

        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)], axis=1)
            cut = np.concatenate([[0], 1 + np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)), [len(batch)]])
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                if s == e:
                    continue
                if now is None or (keys[s] != now).any():
                    yield from flushed()
                    now = keys[s]
                most = max(1, min(BLOCK, BLOCK_BYTES // (8 * int(now[0]))))
                while s < e:
                    n = min(e - s, most - sum(len(h[0]) for h in held))
                    part = batch.slice(s, n)
                    held.append((np.stack([part.column(i).to_numpy() for i in (5, 6, 3)], axis=1), part.column(4).to_numpy(), matrix(part.column(7))))
                    s += n
                    if sum(len(h[0]) for h in held) == most:
                        yield from flushed()
        yield from flushed()

    return dealt.mapInArrow(run, _BLOCK)


class Links(Forest):
    """Links of one block of home vectors: counts, and a spanning forest over what they touch."""

    def __init__(self, names: np.ndarray, ids: np.ndarray, v: np.ndarray, least: float) -> None:
        super().__init__(ids)
        self.names, self.v, self.least = names, v, least
        self.single = v.astype(np.float32)
        self.count = np.zeros(len(ids), np.int64)

    def meet(self, ids: np.ndarray, weight: np.ndarray, v: np.ndarray) -> None:
        """Count the links of the homes with the rows of these vectors, and note what hangs together."""
        s = self.single @ v.astype(np.float32).T
        i, j = np.nonzero(s >= self.least - SLACK)
        close = np.abs(s[i, j] - self.least) <= SLACK
        if close.any():
            ok = np.ones(len(i), bool)
            ok[close] = np.einsum("nd,nd->n", self.v[i[close]], v[j[close]]) >= self.least
            i, j = i[ok], j[ok]
        np.add.at(self.count, i, weight[j])
        self.hang(i, j, ids)


_LINK = "h1 long, h2 long, id long, n long, a long, b long"


def block_links(blocks: DataFrame, points: dict[int, np.ndarray], radius: float, cosine: float) -> DataFrame:
    """Numbers of links of home vectors (``h1``, ``h2``, ``id``, ``n``; to be summed, each counts itself), and forest edges (``a``, ``b``)."""
    shared = blocks.sparkSession.sparkContext.broadcast(points)
    own = blocks.select("own", *[F.col(c).alias(f"own_{c}") for c in ("cell", "names", "v")])
    met = blocks.select("reached", "dim", "cell", "names", "weights", "v")
    # no equality to join by, on purpose: blocks are met where they lie, and none is written for a pair
    pairs = own.join(met, F.array_contains("reached", F.col("own"))).drop("own", "reached")

    def read(batch: pa.RecordBatch, i: int, kind: type, at: int, *shape: int) -> np.ndarray:
        return np.frombuffer(batch.column(i)[at].as_buffer(), kind).reshape(*shape)

    def finish(w: Links | None) -> Iterator[pa.RecordBatch]:
        if w is None:
            return
        a, b = w.forest()
        some = w.count > 0
        counts = [pa.array(x[some]) for x in (*w.names.T, w.ids, w.count)]
        yield pa.RecordBatch.from_arrays(
            [pa.concat_arrays([x, pa.nulls(len(a), pa.int64())]) for x in counts] + [pa.concat_arrays([pa.nulls(int(some.sum()), pa.int64()), pa.array(x)]) for x in (a, b)],
            names=[*NAME, "id", "n", "a", "b"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            for at in range(len(batch)):
                dim = batch.column(3)[at].as_py()
                names, theirs = read(batch, 1, np.int64, at, -1, 3), read(batch, 5, np.int64, at, -1, 3)
                if work is None or len(work.ids) != len(names) or (work.names != names[:, :2]).any():
                    yield from finish(work)
                    work = Links(names[:, :2].copy(), names[:, 2].copy(), read(batch, 2, float, at, -1, dim).copy(), cosine)
                v, weights = read(batch, 7, float, at, -1, dim), read(batch, 6, np.int64, at, -1)
                may = reaching(v, points_of(shared.value, dim), batch.column(4)[at].as_py(), radius)[:, batch.column(0)[at].as_py()]
                v, weights, ids = v[may], weights[may], theirs[may, 2]
                for lo in range(0, len(ids), MET):
                    work.meet(ids[lo : lo + MET], weights[lo : lo + MET], v[lo : lo + MET])
        yield from finish(work)

    return pairs.mapInArrow(run, _LINK)


def shared_ids(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """(a, b): least ids of different vectors that rows of one id hold."""
    name = F.struct(*NAME)
    ties = rows.groupBy("id").agg(F.min(name).alias("lo"), F.max(name).alias("hi")).filter("lo <> hi").select(F.col("id").alias("tie"))
    tied = rows.join(ties, rows.id == ties.tie).select("tie", *NAME).distinct().join(vectors.select(*NAME, F.col("id").alias("a")), NAME)
    return tied.join(tied.groupBy("tie").agg(F.min("a").alias("b")), "tie").select("a", "b")


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row; links are pairs at ``cosine`` or more."""
    raw, missing = named(df, key, vector), F.col("id").isNull() | F.col("v").isNull()
    rows = raw.where(~missing).select("id", *NAME)
    every = keep(distinct_vectors(raw.where(~missing)), "vectors")
    vectors = every.filter("v is not null")
    points, radius = pivots(vectors), float(np.sqrt(2 - 2 * cosine)) + 1e-9
    blocks = keep(packed(cells(vectors, points), points, radius), "blocks")
    links = keep(block_links(blocks, points, radius, cosine), "links")
    edges = links.filter("a is not null").select("a", "b").unionByName(shared_ids(rows, vectors))
    counts = links.filter("a is null").groupBy(*NAME, "id").agg((F.sum("n") - 1).alias("n"))
    found = counts.join(components(edges), F.col("id") == F.col("node"), "left")
    found = keep(found.select(*NAME, "n", F.coalesce("component", "id").alias("component")), "found")
    total = every.agg(F.sum("weight")).first()[0] or 0
    hot = every.filter(F.col("weight") > total * HOT_SHARE).select(*NAME).join(found, NAME, "left")
    # rows of the few hot vectors meet them by broadcast, all others in a shuffle
    apart = rows.join(F.broadcast(hot.select(*NAME)), NAME, "left_anti").join(found, NAME, "left")
    both = apart.unionByName(rows.join(F.broadcast(hot), NAME)).select("id", "n", "component")
    rest = raw.where(missing).select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("component"))
    out = both.unionByName(rest).select(F.col("id").alias("vec_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
