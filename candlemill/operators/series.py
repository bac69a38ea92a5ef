"""Series of candles: one (symbol, interval), ordered by ts.

Window columns over a series share one exchange and one sort. ``number_rows`` and
``halo`` cut long series into chunks of rows, so a task need not hold a whole one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEYS = ["symbol", "interval"]


def series(descending: bool = False) -> WindowSpec:
    return Window.partitionBy(*KEYS).orderBy(F.desc("ts") if descending else F.asc("ts"))


def frame(before: int | None, after: int = 0) -> WindowSpec:
    """The rows from ``before`` rows back (None: from the start) to ``after`` rows ahead."""
    start = Window.unboundedPreceding if before is None else -before
    return series().rowsBetween(start, after)


def position() -> Column:
    """1-based place of a row in its series."""
    return F.row_number().over(series())


def sort_series(candles: DataFrame) -> DataFrame:
    return candles.orderBy(*KEYS, "ts")


def latest_candles(candles: DataFrame, n: int) -> DataFrame:
    return candles.withColumn("_r", F.row_number().over(series(True))).filter(F.col("_r") <= n).drop("_r")


def head_rows(candles: DataFrame, n: int) -> DataFrame:
    return candles.withColumn("_r", position()).filter(F.col("_r") <= n).drop("_r")


def nth_candle(candles: DataFrame, k: int) -> DataFrame:
    """The candle at 0-based position ``k`` of each series; a negative one counts from the end."""
    n = position() - 1 if k >= 0 else -F.row_number().over(series(True))
    return candles.withColumn("_r", n).filter(F.col("_r") == k).drop("_r")


def latest_point(candles: DataFrame, names: list[str]) -> DataFrame:
    """The newest value of each indicator column that is not null."""
    return candles.groupBy(*KEYS).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ts"))).alias(c) for c in names])


def merge_recent(stored: DataFrame, batch: DataFrame, n: int) -> DataFrame:
    """A fixed-length series with an update batch: equal time replaces, newer appends, older is ignored.

    Within the batch the row with the greatest ``load_seq`` wins a time.
    """
    last = stored.groupBy(*KEYS).agg(F.max("ts").alias("_last"))
    fresh = batch.join(last, KEYS, "left").filter(F.col("_last").isNull() | (F.col("ts") >= F.col("_last"))).drop("_last")
    both = stored.withColumn("load_seq", F.lit(None).cast(batch.schema["load_seq"].dataType)).unionByName(fresh)
    newest = F.row_number().over(Window.partitionBy(*KEYS, "ts").orderBy(F.desc_nulls_last("load_seq")))
    merged = both.withColumn("_w", newest).filter("_w = 1").drop("_w", "load_seq")
    return latest_candles(merged, n)


def number_rows(candles: DataFrame, unit: str = "month") -> DataFrame:
    """0-based row number in each series (``rn``) without a task for a whole series.

    Rows are numbered inside calendar units; the units' sizes, a small table, give the offsets.
    """
    part = F.date_trunc(unit, F.col("ts").cast("timestamp"))
    rows = candles.withColumn("_u", part)
    sizes = rows.groupBy(*KEYS, "_u").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*KEYS).orderBy("_u").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_o", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = F.row_number().over(Window.partitionBy(*KEYS, "_u").orderBy("ts"))
    return rows.withColumn("_l", local).join(offsets, [*KEYS, "_u"]).withColumn("rn", F.col("_o") + F.col("_l") - 1).drop("_u", "_l", "_o")


def halo(numbered: DataFrame, size: int, before: int, after: int) -> DataFrame:
    """Rows dealt into chunks of ``size``; copies of ``before`` and ``after`` rows go to the neighbours.

    Adds ``chunk``; ``core`` tells a chunk's own rows from copies.
    """
    if before > size or after > size:
        raise ValueError("a halo may not be longer than a chunk")
    own = F.floor(F.col("rn") / size)
    at = F.col("rn") % size
    chunks = F.array_compact(F.array(F.when((at < after) & (own > 0), own - 1), own, F.when(at >= size - before, own + 1)))
    return numbered.withColumn("_own", own).withColumn("chunk", F.explode(chunks)).withColumn("core", F.col("chunk") == F.col("_own")).drop("_own")
