"""Language identification as a multilingual mixture.

Training counts letter trigrams (bytes of lower-cased text, hashed to ``BUCKETS``) by
language over all labelled training rows; the model is a table of log-probabilities of
fixed size. A text is a mixture: its segments (runs of ``SEGMENT`` bytes) get a
log-likelihood for each language, expectation-maximisation estimates the text's language
proportions, and languages leave the set while that improves the penalised likelihood.
The prediction is the language with the largest share; the score is that share.

One pass and one small aggregate to train; the prediction pass has no shuffle, as the
model (``BUCKETS`` x languages floats) is broadcast.

Defined cases: ``und`` with score 0 for a null text or one without a letter; training
rows with a null text or language are not used; with no training rows every text is
``und``; ties go to the language first in order; repeated rows are predicted alike;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlemill.llm.blocks import blocks
from candlemill.llm.jobs import aside, restored, with_columns

BUCKETS = 1 << 14
SEGMENT = 32
#: Most languages a model may hold; bounds its size (BUCKETS x LANGUAGES x 4 bytes).
LANGUAGES = 256
UNKNOWN = "und"

_letters = np.zeros(256, bool)
_letters[0x61:0x7B] = _letters[0x80:] = True
# other bytes count as one space
_fold = np.where(_letters, np.arange(256), 32).astype(np.uint32)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bucket of the trigram that starts at each byte (the last two of every row see spaces)."""
    x = _fold[data]
    second, third = np.full(len(x), 32, np.uint32), np.full(len(x), 32, np.uint32)
    second[:-1], third[:-2] = x[1:], x[2:]
    last = offsets[1:][np.diff(offsets) > 0] - 1
    second[last] = third[last] = 32
    third[last[last > 0] - 1] = 32
    h = x * np.uint32(0x9E3779B1) + second * np.uint32(0x85EBCA77) + third * np.uint32(0xC2B2AE3D)
    return ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(18)


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities [bucket, language]) from all given rows."""
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for b in blocks(batch.column(1)):
                codes, names = np.unique(np.array(langs[b.first : b.first + b.rows], dtype=object).astype(str), return_inverse=True)
                of = np.repeat(names, np.diff(b.offsets))
                t = trigrams(b.data, b.offsets)
                for i, name in enumerate(codes.tolist()):
                    part = np.bincount(t[of == i], minlength=BUCKETS)
                    sums[name] = sums[name] + part if name in sums else part
        for name, c in sums.items():
            k = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(k)), pa.array(k.astype(np.int32)), pa.array(c[k].astype(np.int64))], names=["lang", "bucket", "n"])

    found = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # at most LANGUAGES * BUCKETS rows, whatever the corpus holds; columns of the model, packed by language
    packed = found.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("c")).orderBy("lang").limit(LANGUAGES + 1).collect()
    if len(packed) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    names = [r.lang for r in packed]
    table = np.full((BUCKETS, len(names)), 0.5)
    for j, r in enumerate(packed):
        for b, n in r.c:
            table[b, j] += n
    return names, np.log(table / table.sum(axis=0)).astype(np.float32)


def segments(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start byte, row) of the segments of each non-empty row."""
    size = np.diff(offsets)
    n = -(-size // SEGMENT)
    row = np.repeat(np.arange(len(size)), n)
    inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return offsets[row] + inner * SEGMENT, row


def mixture(scores: np.ndarray, row: np.ndarray, rows: int, steps: int = 12, penalty: float = 1.0) -> np.ndarray:
    """Proportions [row, language] from segment log-likelihoods, all rows at once.

    Each round is an expectation-maximisation step of every row; afterwards the weakest
    language of a row is tried out: it goes for good if log-likelihood falls by less than
    ``penalty * log(segments)`` (half of it a parameter, as in the Bayesian criterion).
    """
    langs = scores.shape[1]
    peak = scores.max(axis=1, keepdims=True)
    like = np.exp(np.maximum(scores - peak, -60.0)).astype(np.float64)
    count = np.bincount(row, minlength=rows).astype(float)
    first = np.searchsorted(row, np.arange(rows))
    has = count > 0
    pi = np.full((rows, langs), 1.0 / langs)

    def total(x: np.ndarray) -> np.ndarray:
        out = np.zeros((rows, *x.shape[1:]))
        if len(x):
            out[has] = np.add.reduceat(x, first[has], axis=0)
        return out

    def step(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        joint = like * p[row]
        z = np.maximum(joint.sum(axis=1), 1e-300)
        return total(joint / z[:, None]) / np.maximum(count, 1)[:, None], total(np.log(z))

    for _ in range(steps):
        pi, ll = step(pi)
    for _ in range(langs - 1):
        alive = pi > 0
        weakest = np.where(alive, pi, np.inf).argmin(axis=1)
        cut = pi.copy()
        cut[np.arange(rows), weakest] = 0
        cut /= np.maximum(cut.sum(axis=1, keepdims=True), 1e-300)
        for _ in range(2):
            cut, ll_cut = step(cut)
        _, ll = step(pi)
        drop = has & (alive.sum(axis=1) > 1) & (ll - ll_cut < penalty * np.log(count + 1))
        if not drop.any():
            break
        pi[drop] = cut[drop]
    return pi


def without_letters(block_data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows without any letter; bytes decide where ASCII letters occur, Unicode elsewhere."""
    n = len(offsets) - 1
    ascii_letter = (block_data >= 0x61) & (block_data <= 0x7A)
    seen = np.concatenate([[0], np.cumsum(ascii_letter)])
    none = seen[offsets[1:]] == seen[offsets[:-1]]
    for i in np.flatnonzero(none):
        text = block_data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")
        none[i] = not any(c.isalpha() and c != "�" for c in text)
    return none if n else np.zeros(0, bool)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The carried columns (all, if not given), lang_pred and score of every row, in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    carry = docs.columns if carry is None else carry
    rows = aside(docs, text, carry)
    held = rows.columns[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = shared.value
        words = np.array([*names, UNKNOWN], dtype=object)
        for batch in batches:
            for b in blocks(batch.column(0)):
                und = without_letters(b.data, b.offsets)
                best, share = np.full(b.rows, len(names)), np.zeros(b.rows)
                if names and len(b.data):
                    start, row = segments(b.offsets)
                    scores = np.add.reduceat(table[trigrams(b.data, b.offsets)], start, axis=0)
                    pi = mixture(scores, row, b.rows)
                    best = np.where(und, len(names), pi.argmax(axis=1))
                    share = np.where(und, 0.0, np.clip(pi.max(axis=1), 0, 1))
                cut = [batch.column(i).slice(b.first, b.rows) for i in range(1, len(held) + 1)]
                yield pa.RecordBatch.from_arrays([*cut, pa.array(words[best], pa.string()), pa.array(share)], names=[*held, "lang_pred", "score"])

    return restored(rows.mapInArrow(run, with_columns(rows, held, "lang_pred string, score double")), carry, "lang_pred", "score")


def identify(docs: DataFrame, training: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``docs``, learned from ``training``."""
    return predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text), train(training, text, lang), text, ["doc_id"])
