"""Corpus pipeline: five stages over ``documents``, each a numbered operator of candlemill.llm.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; ``run`` writes
each stage's rows to the shared folder as Parquet and reads them again.

1. language ID: learned from the labelled rows; rows without a letter (``und``) go, and ``lang`` is
   filled where it was null.
2. near duplicates: of each component at Jaccard 0.75 on five-word shingles the row with the least
   doc_id stays (repeated rows with that id: one of them).
3. suffix-array dedup: passages of 51 words that occur again are cut out, whatever bytes they have (the
   400 bytes of the operator's own query are not asked for here); rows left without text go.
4. benchmark decontamination: contaminated rows go.
5. SentencePiece: ids of every kept text, checked to decode to it.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlemill.llm import contamination, jaccard, language, pieces, substrings
from candlemill.llm.jobs import keep, row_key, table
from candlemill.session import bound_batches

#: Stages span learned models and hashes of texts; SQL cannot express them.
ORACLE_SQL = None


#: Words of the shortest passage that stage 3 cuts out where it occurs again.
PASSAGE = 51

CORE = ["doc_id", "text", "lang", "source", "n_chars"]


def whole_rows(stage: Callable) -> Callable:
    """Carry all columns but the documents' own as one struct, so that no name can clash inside a stage."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        extra = [c for c in docs.columns if c not in CORE]
        core = [c for c in docs.columns if c in CORE]
        packed = docs.select(*core, F.struct(*[F.col(f"`{c}`") for c in extra]).alias("_extra")) if extra else docs
        out = stage(spark, packed, sf_dir)
        added = [c for c in out.columns if c not in packed.columns]
        back = [F.col(c) if c in CORE else F.col("_extra").getField(c).alias(c) for c in docs.columns if c not in added]
        return out.select(*back, *added)

    return run


@whole_rows
def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = language.predict(docs, language.train(docs), "text").filter(F.col("lang_pred") != language.UNKNOWN)
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(docs.columns)


@whole_rows
def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = jaccard.join(docs).select("_k1", "_k2", "doc_id", "_group").distinct()
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_k1", "_k2"))
    first = groups.filter("_group is not null").groupBy("_group").agg(least.alias("r")).select("r._k1", "r._k2")
    alone = groups.filter("_group is null").select("_k1", "_k2")
    # equal rows share their key: one of them stays
    kept = row_key(docs, "doc_id", "text").join(first.unionByName(alone), ["_k1", "_k2"]).dropDuplicates(["_k1", "_k2"])
    return kept.select(docs.columns)


@whole_rows
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = substrings.remove(docs, passage=PASSAGE)
    left = cut.filter((F.col("_spans") == 0) | (F.length(F.trim("text")) > 0))
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


@whole_rows
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = contamination.matches(docs, table(spark, sf_dir, "benchmark"))
    return found.filter(~contamination.is_contaminated()).select(docs.columns)


@whole_rows
def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    both = pieces.decode(pieces.encode(docs))
    same = F.col("decoded").eqNullSafe(F.replace(F.coalesce("text", F.lit("")), F.lit(pieces.MARK), F.lit(" ")))
    return both.select(*docs.columns, "ids", F.size("ids").cast("long").alias("n_ids"), same.alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_known_language),
    ("ngram_jaccard_join", keep_one_of_group),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("sentencepiece", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
    return docs
