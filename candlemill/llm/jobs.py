"""Small Spark helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from candlemill.session import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep(df: DataFrame, label: str = "step") -> DataFrame:
    """Cut lineage: write to the shared folder as Parquet and read it back."""
    return written(df, label)


def with_columns(docs: DataFrame, carry: list[str], added: str) -> StructType:
    """Schema of carried columns and of those that a kernel adds to them."""
    return StructType([*(docs.schema[c] for c in carry), *_parse_datatype_string(added).fields])


def aside(docs: DataFrame, text: str, carry: list[str]) -> DataFrame:
    """``text`` and the carried columns as ``text``, ``c0``, ``c1``, ...: no name of theirs can meet one of an operator's own."""
    return docs.select(F.col(f"`{text}`").alias("text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)])


def restored(df: DataFrame, carry: list[str], *own: str) -> DataFrame:
    """The carried columns under their names again, then the operator's ``own``; one of those replaces a carried one of its name."""
    return df.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry) if c not in own], *own)


def row_key(df: DataFrame, *columns: str) -> DataFrame:
    """Add ``_k1``, ``_k2``: 128 bits that name a row by its contents, never null.

    Rows equal in ``columns`` share a key and, as every operator here is a function
    of those columns, a result; so repeated rows need no numbering.
    """
    cols = [F.col(c) for c in columns]
    null = F.concat(*[F.when(c.isNull(), "0").otherwise("1") for c in cols])
    return df.withColumns({"_k1": F.xxhash64(*cols, null), "_k2": F.xxhash64(F.lit(7), null, *cols[::-1])})


def fold(column: str, modulus: int):
    """crc32(doc_id as text) mod ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def spread(df: DataFrame, count: int | None = None, *columns: str) -> DataFrame:
    n = count or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return df.repartition(n, *columns)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges (a long, b long)``: rows (node, component = least node).

    Large-star then small-star until nothing changes. Each round shuffles a number
    of rows linear in the edges; a node with very many neighbours is never gathered,
    as its least neighbour is an aggregate joined back. Lineage is cut each round.
    """
    e = keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        # large star: every larger neighbour of a points to the least node around a
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        own = least.filter("m < a").select("a", F.col("m").alias("b"))
        e1 = keep(large.unionByName(own).distinct(), "large")
        # small star: the smaller neighbours of a point to the least of them
        low = e1.groupBy("a").agg(F.min("b").alias("m"))
        small = e1.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        e2 = keep(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "small")
        changed = e2.join(e, ["a", "b"], "left_anti").limit(1).count() or e.join(e2, ["a", "b"], "left_anti").limit(1).count()
        e = e2
        if not changed:
            return e.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
