"""Training windows, their targets, splits and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlemill.operators.series import KEYS, frame, position, series
from candlemill.schemas import require


def clean_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Infinite values become null; rows with a null in ``columns`` go."""
    require(rows, columns, "rows")
    floating = {c for c, kind in rows.dtypes if kind in ("double", "float")}
    fixed = {c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)) for c in columns if c in floating}
    return rows.withColumns(fixed).na.drop(subset=columns)


def class_index(columns: list[str]) -> Column:
    """Index of the greatest of some columns, the first on a tie."""
    values = F.array(*[F.col(c).cast("double") for c in columns])
    return (F.array_position(values, F.array_max(values)) - 1).cast("long")


def one_hot_target(columns: list[str]) -> Column:
    return F.array(*[F.col(c).cast("float") for c in columns])


def label_index(column: str, values: list) -> Column:
    """Index of a scalar label in a fixed list; an unknown one is an error."""
    found = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(column))
    unknown = F.raise_error(F.concat(F.lit(f"unknown value of {column}: "), F.col(column).cast("string"))).cast("long")
    return F.when(F.col(column).isNull(), None).when(found > 0, found - 1).otherwise(unknown)


def distinct_labels(rows: DataFrame, column: str) -> DataFrame:
    """Class index of each label value: dense rank within a series."""
    return rows.select(*KEYS, column).distinct().withColumn("class_index", F.dense_rank().over(Window.partitionBy(*KEYS).orderBy(column)) - 1)


def context_windows(rows: DataFrame, features: list[str], target: Column, length: int, offset: int = 1) -> DataFrame:
    """(symbol, interval, ts, window, target): ``length`` rows of features and the target ``offset`` rows on.

    ``ts`` is the time of the window's last row. Features are single precision before they are gathered.
    """
    narrow = rows.select(*KEYS, "ts", F.array(*[F.col(c).cast("float") for c in features]).alias("_f"), target.alias("_t"))
    out = narrow.withColumns({"_n": position(), "window": F.collect_list("_f").over(frame(length - 1)), "target": F.lead("_t", offset).over(series())})
    return out.filter((F.col("_n") >= length) & F.col("target").isNotNull()).select(*KEYS, "ts", "window", "target")


def next_color_windows(rows: DataFrame, features: list[str], length: int, colors: tuple[str, str] = ("candle_color_green", "candle_color_red")) -> DataFrame:
    return context_windows(rows, features, class_index(list(colors)), length, 1)


def series_report(rows: DataFrame, length: int, offset: int = 1) -> DataFrame:
    """Rows and windows of each series, and why one is skipped."""
    n = rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("rows"))
    short = F.col("rows") < length + offset
    return n.withColumns({
        "windows": F.when(short, 0).otherwise(F.col("rows") - length - offset + 1).cast("long"),
        "reason": F.when(short, F.concat(F.lit("fewer than "), F.lit(length + offset), F.lit(" rows"))),
    })


def label_counts(windows: DataFrame, classes: int, target: str = "target") -> DataFrame:
    """Windows of each class, zero where there are none."""
    spark = windows.sparkSession
    found = windows.groupBy(F.col(target).cast("long").alias("class_index")).agg(F.count(F.lit(1)).alias("n"))
    return spark.range(classes).withColumnRenamed("id", "class_index").join(found, "class_index", "left").select("class_index", F.coalesce("n", F.lit(0)).alias("n"))


def class_weights(counts: DataFrame) -> DataFrame:
    """total / (classes * count) for each class; null for all if a class is empty."""
    whole = Window.partitionBy()  # a row for each class
    total, least, k = F.sum("n").over(whole), F.min("n").over(whole), F.count(F.lit(1)).over(whole)
    return counts.select("class_index", "n", F.when(least > 0, total / (k * F.col("n"))).alias("weight"))


def _shuffled(seed: int, *more: Column) -> Column:
    """A hexadecimal digest that orders keys at random but alike in every run."""
    return F.md5(F.concat_ws("|", *KEYS, *more, F.lit(str(seed))))


def _placed(rows: DataFrame, digest: Column, ties: list[str]) -> DataFrame:
    """Rows with ``_place`` (from 1, by digest) and ``_n`` (their number).

    Places are found on counts of 4096 digest ranges, so rows are ranked within one range only.
    """
    keyed = rows.withColumn("_h", digest).withColumn("_b", F.substring("_h", 1, 3))
    every = Window.partitionBy()
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = keyed.groupBy("_b").agg(F.count(F.lit(1)).alias("_c")).withColumns({"_before": before, "_n": F.sum("_c").over(every)}).drop("_c")
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_b").orderBy("_h", *ties))
    # at most 4096 ranges
    return keyed.join(F.broadcast(ranges), "_b").withColumn("_place", place).drop("_h", "_b", "_before")


def split_by_series(rows: DataFrame, seed: int, share: float = 0.8, most: int | None = None) -> DataFrame:
    """Rows with ``part``: whole series go to train (max(1, int(n * share))) or validation.

    A single series is both; ``most`` caps the series taken, in name order.
    """
    keys = rows.select(*KEYS).distinct()
    if most is not None:
        keys = keys.orderBy(*KEYS).limit(most)
    marked = _placed(keys, _shuffled(seed), KEYS).select(*KEYS, F.explode(_parts("_n", "_place", share)).alias("part"))
    return rows.join(marked, KEYS)


def _parts(n: str, place: str, share: float) -> Column:
    train = F.greatest(F.lit(1), F.floor(F.col(n) * share))
    return F.when(F.col(n) == 1, F.array(F.lit("train"), F.lit("validation"))).when(F.col(place) <= train, F.array(F.lit("train"))).otherwise(F.array(F.lit("validation")))


def split_by_window(windows: DataFrame, seed: int, share: float = 0.2) -> DataFrame:
    """Windows with ``part``: exactly max(1, int(n * share)) by hash order are validation."""
    out = _placed(windows, _shuffled(seed, F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")), [*KEYS, "ts"])
    validation = F.greatest(F.lit(1), F.floor(F.col("_n") * share))
    return out.withColumn("part", F.when(F.col("_place") <= validation, "validation").otherwise("train")).drop("_place", "_n")
