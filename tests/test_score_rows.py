"""Scoring over strided views against scoring of windows made as rows."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlemill.operators import dataset, evaluate

SCHEMA = "symbol string, interval string, ts timestamp_ntz, a double, b int, t int"


def last_and_sum(x):
    """Logits that see every place of the window, and its order."""
    weights = np.arange(1, x.shape[1] + 1)[None, :]
    return np.stack([(x[:, :, 0] * weights).sum(axis=1), x[:, -1, 1] + 0.5, x[:, 0, 0]], axis=1)


@pytest.mark.parametrize("records", [1, 7, 10_000])
@pytest.mark.parametrize(("length", "offset"), [(1, 1), (4, 1), (9, 3)])
def test_score_rows(spark, records, length, offset):
    """Batches shorter than windows, series shorter than windows, targets that are missing."""
    r, rows = random.Random(5), []
    for s, n in (("A", 40), ("B", 8), ("C", 1), ("D", 23)):
        rows += [(s, "minute", dt.datetime(2026, 1, 1) + dt.timedelta(minutes=i), float(r.randint(-9, 9)), r.randint(0, 9), None if r.random() < 0.2 else 1) for i in range(n)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
    try:
        got = evaluate.score_rows(df, ["a", "b"], F.col("t"), length, last_and_sum, offset).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    windows = dataset.context_windows(df, ["a", "b"], F.col("t"), length, offset)
    want = evaluate.score_windows(windows, last_and_sum, ["symbol", "interval", "ts", "target"]).collect()
    key = lambda x: (x.symbol, x.ts, x.target, x.predicted, [round(v, 9) for v in x.logits], [round(v, 9) for v in x.probs])
    assert sorted(map(key, got)) == sorted(map(key, want)) and got


def test_windows_are_never_rows(spark):
    """The plan carries single values: no array of arrays, one exchange."""
    df = spark.createDataFrame([], SCHEMA)
    plan = evaluate.score_rows(df, ["a", "b"], F.col("t"), 128, last_and_sum)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and plan.count("Exchange") <= 1
    assert evaluate.score_rows(df, ["a", "b"], F.col("t"), 128, last_and_sum).count() == 0
