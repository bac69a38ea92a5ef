"""Scoring of windows and reports on predictions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from candlemill.operators.series import KEYS, position, series


def score_windows(windows: DataFrame, predictor: Callable[[np.ndarray], np.ndarray], keys: list[str], window: str = "window") -> DataFrame:
    """(keys, logits, probs, predicted): a batch predictor over windows, then softmax and the first maximum.

    ``predictor`` maps an array [n, length, features] to logits [n, classes]; it is sent to the tasks once.
    """
    shared = windows.sparkSession.sparkContext.broadcast(predictor)
    fields = ", ".join(f"{c} {windows.schema[c].dataType.simpleString()}" for c in keys)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = part[keys].copy()
            x = np.array([np.stack(w) for w in part[window]], dtype=np.float32)
            out["logits"] = list(np.asarray(shared.value(x), dtype=np.float64)) if len(part) else []
            yield out

    return softmax_argmax(windows.select(*keys, window).mapInPandas(run, f"{fields}, logits array<double>"))


#: Windows that a predictor gets at once.
AT_ONCE = 1024


def score_rows(rows: DataFrame, features: list[str], target: Column, length: int, predictor: Callable[[np.ndarray], np.ndarray], offset: int = 1) -> DataFrame:
    """(symbol, interval, ts, target, logits, probs, predicted): what ``score_windows`` gives for ``context_windows``.

    Windows are never made as rows: each row passes once, in series order, its features in single precision, and a
    task keeps the last ``length`` - 1 rows. The predictor gets strided views [n, length, features] over them.
    """
    shared = rows.sparkSession.sparkContext.broadcast(predictor)
    narrow = rows.select(*KEYS, "ts", target.alias("target"), *[F.col(f"`{c}`").cast("float").alias(f"_x{i}") for i, c in enumerate(features)])
    k, width = len(KEYS) + 1, len(features)
    ready = narrow.withColumns({"_rn": position(), "_t": F.lead("target", offset).over(series())})
    ready = ready.select(*KEYS, "ts", F.col("_t").alias("target"), "_rn", *[f"_x{i}" for i in range(width)])
    schema = StructType([*(ready.schema[c] for c in (*KEYS, "ts", "target")), StructField("logits", ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = np.zeros((0, width), np.float32)
        for batch in batches:
            rn = batch.column(k + 1).to_numpy()
            x = np.stack([batch.column(k + 2 + i).to_numpy(zero_copy_only=False).astype(np.float32) for i in range(width)], axis=1) if width else np.zeros((len(batch), 0), np.float32)
            held = np.concatenate([tail, x])
            # a row's window ends with it: rows before it that belong to another series are told by its number
            at = np.flatnonzero((rn >= length) & batch.column(k).is_valid().to_numpy(zero_copy_only=False))
            views = np.lib.stride_tricks.sliding_window_view(held, length, axis=0).transpose(0, 2, 1) if len(held) >= length else None
            for lo in range(0, len(at), AT_ONCE):
                part = at[lo : lo + AT_ONCE]
                first = len(tail) + part - length + 1
                # rows without gaps are a view; others are gathered
                window = views[first[0] : first[-1] + 1] if first[-1] - first[0] + 1 == len(first) else views[first]
                logits = np.asarray(shared.value(window), np.float64)
                off = np.arange(len(part) + 1, dtype=np.int32) * logits.shape[1]
                made = pa.ListArray.from_arrays(pa.array(off), pa.array(logits.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(part)) for i in range(k + 1)), made], names=schema.names)
            tail = held[max(0, len(held) - length + 1) :]

    return softmax_argmax(ready.mapInArrow(run, schema))


def softmax_argmax(scored: DataFrame) -> DataFrame:
    top = F.array_max("logits")
    powers = F.transform("logits", lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    probs = F.transform(powers, lambda x: x / total)
    return scored.withColumns({"probs": probs, "predicted": (F.array_position("logits", top) - 1).cast("int")})


def confusion_matrix(predictions: DataFrame, classes: int) -> DataFrame:
    """Dense counts: a row for each actual class, a column ``p<k>`` for each predicted one."""
    k = list(range(classes))
    counts = predictions.groupBy(F.col("actual").cast("int").alias("actual")).agg(*[F.count_if(F.col("predicted") == i).alias(f"p{i}") for i in k])
    every = predictions.sparkSession.range(classes).select(F.col("id").cast("int").alias("actual"))
    return every.join(counts, "actual", "left").select("actual", *[F.coalesce(f"p{i}", F.lit(0)).alias(f"p{i}") for i in k])


def normalized_confusion(matrix: DataFrame, classes: int) -> DataFrame:
    total = F.greatest(sum((F.col(f"p{i}") for i in range(classes)), F.lit(0)), F.lit(1))
    return matrix.select("actual", *[(F.col(f"p{i}") / total).alias(f"p{i}") for i in range(classes)])


def classification_report(matrix: DataFrame, classes: int) -> DataFrame:
    """Precision, recall, f1 and support of each class, their macro average, and accuracy.

    Works on the K x K confusion counts, gathered into one row of arrays.
    """
    k = list(range(classes))
    flat = matrix.agg(*[F.sum(F.when(F.col("actual") == a, F.col(f"p{p}")).otherwise(0)).cast("double").alias(f"c{a}_{p}") for a in k for p in k])
    c = lambda a, p: F.col(f"c{a}_{p}")
    one = F.lit(1.0)

    def row(i: int) -> Column:
        tp = c(i, i)
        precision = tp / F.greatest(sum((c(a, i) for a in k), F.lit(0.0)), one)
        support = sum((c(i, p) for p in k), F.lit(0.0))
        recall = tp / F.greatest(support, one)
        f1 = 2 * precision * recall / F.greatest(precision + recall, F.lit(1e-12))
        return F.struct(F.lit(str(i)).alias("class"), precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), support.alias("support"))

    rows = flat.select(F.array(*[row(i) for i in k]).alias("r"), (sum((c(i, i) for i in k), F.lit(0.0)) / F.greatest(sum((c(a, p) for a in k for p in k), F.lit(0.0)), one)).alias("acc"))
    mean = lambda f: F.aggregate("r", F.lit(0.0), lambda s, x: s + x[f]) / classes
    total = F.aggregate("r", F.lit(0.0), lambda s, x: s + x["support"])
    macro = F.struct(F.lit("macro").alias("class"), mean("precision").alias("precision"), mean("recall").alias("recall"), mean("f1").alias("f1"), total.alias("support"))
    return rows.select(F.explode(F.concat("r", F.array(macro))).alias("x"), "acc").select("x.*", F.col("acc").alias("accuracy"))


def evaluation_loss(predictions: DataFrame, weights: list[float] | None = None) -> DataFrame:
    """Weighted cross-entropy of ``probs`` at ``actual``, over the whole table."""
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), F.col("actual")) if weights else F.lit(1.0)
    p = F.get(F.col("probs"), F.col("actual"))
    return predictions.agg((F.sum(w * -F.ln(p)) / F.sum(w)).alias("loss"), F.count(F.lit(1)).alias("n"))


def regression_loss(predictions: DataFrame) -> DataFrame:
    d = F.col("predicted") - F.col("actual")
    return predictions.agg(F.avg(d * d).alias("loss"), F.count(F.lit(1)).alias("n"))
