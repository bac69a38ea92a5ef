"""Candle tables: reading, writing, upserts, ranges, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from candlemill.functions.geometry import with_geometry
from candlemill.functions.time import canonical_interval, normalize_interval, parse_bound, to_market_time
from candlemill.functions.ticks import tick_fields
from candlemill.operators.series import KEYS
from candlemill.schemas import CANDLE, CANDLE_COLUMNS, GEOMETRY_COLUMNS, TICK, require

_FILE = r"^(?:[^=]*=)?(.+)_((?:\d+)?minute|day)_"


def series_keys_from_path(name: Column) -> dict[str, Column]:
    """Symbol and interval of a file named ``SYMBOL_interval_start_end``; symbols may hold & and -."""
    return {"symbol": F.regexp_extract(name, _FILE, 1), "interval": F.regexp_extract(name, _FILE, 2)}


def read_candles_csv(spark: SparkSession, path: str, intervals: list[str] | None = None) -> DataFrame:
    """Candles of CSV files; times as market wall clock.

    Keys come from the file's name, or, where that tells none, from its folder's (a folder a series, as Spark writes).
    """
    raw = spark.read.schema("timestamp string, open double, high double, low double, close double, volume double").option("header", True).option("enforceSchema", False).csv(path)
    places = F.split("_metadata.file_path", "/")
    name = F.url_decode(F.col("_metadata.file_name"))
    folder = F.url_decode(F.element_at(places, -2))
    keyed = raw.withColumns(series_keys_from_path(F.when(name.rlike(_FILE), name).otherwise(folder)))
    if intervals:
        keyed = keyed.filter(F.col("interval").isin(intervals))
    return keyed.select("symbol", "interval", parse_bound(F.col("timestamp")).alias("ts"), "open", "high", "low", "close", "volume")


def folders(by_year: bool, buckets: int | None) -> list[str]:
    """Partition columns of a candle table: a folder a series, or a bucket of series, and within it a year."""
    return ["interval", "bucket" if buckets else "symbol", *(["year"] if by_year else [])]


def placed(rows: DataFrame, by_year: bool, buckets: int | None) -> DataFrame:
    """Rows with the partition columns that candles lack."""
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("symbol"), F.lit(buckets)).cast("int")) if buckets else rows
    return rows.withColumn("year", F.year("ts")) if by_year else rows


def write_candles(candles: DataFrame, path: str, fmt: str = "parquet", by_year: bool = False, buckets: int | None = None) -> None:
    """All candle and geometry columns, partitioned by series (and year); only partitions in the data are replaced.

    Files are as many as series, or series and years. With ``buckets`` series are dealt into so many folders by a hash of their symbol
    instead, for tables of very many series; the number may not change while the table is in use.
    """
    require(candles, CANDLE_COLUMNS, "candles")
    replace_partitions(candles.select(CANDLE_COLUMNS), path, by_year, fmt, buckets, geometry=True)


def replace_partitions(rows: DataFrame, path: str, by_year: bool, fmt: str = "parquet", buckets: int | None = None, geometry: bool = False) -> None:
    """Write whole partitions, each sorted by series and time (so that row groups can be skipped), in place of those of the same name.

    ``geometry``: with the geometry columns, made of rows that have been dealt already.
    """
    keys = folders(by_year, buckets)
    dealt = placed(rows, by_year, buckets).repartition(*keys).sortWithinPartitions(*keys, *(["symbol"] if buckets else []), "ts")
    if geometry:
        dealt = with_geometry(dealt).select(*dealt.columns, *GEOMETRY_COLUMNS)
    out = dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys)
    out.option("header", True).csv(path) if fmt == "csv" else out.parquet(path)


def read_years(spark: SparkSession, path: str, schema: str | StructType, interval: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Candles of a table kept by years, of one interval and between two inclusive bounds if given.

    The years of the bounds are a filter on partitions, the bounds themselves one on row groups, so a range reads the
    files of its years alone. ``schema`` has the table's columns without ``year`` and ``bucket``.
    """
    empty = spark.createDataFrame([], schema)
    out = spark.read.schema(StructType([*empty.schema.fields, StructField("year", IntegerType())])).parquet(path)
    if interval is not None:
        # a literal: the partition is found without looking at rows
        out = out.filter(F.col("interval") == canonical_interval(interval))
    for bound, is_end in ((start, False), (end, True)):
        if bound is not None:
            at = parse_bound(F.lit(bound), is_end=is_end)
            out = out.filter((F.col("year") <= F.year(at)) & (F.col("ts") <= at) if is_end else (F.col("year") >= F.year(at)) & (F.col("ts") >= at))
    return out.select(empty.columns)


def exists(spark: SparkSession, pattern: str) -> bool:
    """Is there a path of this pattern, in whatever file system it names?"""
    at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return found is not None and len(found) > 0


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def write_dataset(rows: DataFrame, path: str, expected: list[str]) -> DataFrame:
    """Write series that are not there yet with the expected columns; returns the rows written."""
    spark = rows.sparkSession
    todo = rows
    if exists(spark, f"{path}/interval=*/symbol=*/*.parquet"):
        there = spark.read.parquet(path)
        if set(expected) <= set(there.columns):
            todo = rows.join(there.select(*KEYS).distinct(), KEYS, "left_anti")
    todo.repartition(*KEYS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("interval", "symbol").parquet(path)
    return todo


def upsert_candles(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored and new candles merged by time; of equal times the new one stays, the last loaded first.

    Both may carry ``load_seq``; stored rows count as loaded before all others.
    """
    columns = [c for c in stored.columns if c != "load_seq"]
    seq = F.col("load_seq").cast("long") if "load_seq" in new.columns else F.lit(0).cast("long")
    both = stored.select(*columns, F.lit(0).alias("_new"), F.lit(0).cast("long").alias("_seq")).unionByName(new.select(*columns, F.lit(1).alias("_new"), seq.alias("_seq")))
    rest = [c for c in columns if c not in (*KEYS, "ts")]
    newest = F.max_by(F.struct(*rest), F.struct("_new", "_seq", *rest))
    return both.groupBy(*KEYS, "ts").agg(newest.alias("_r")).select(*[F.col(f"_r.{c}").alias(c) if c in rest else F.col(c) for c in columns])


def load_range(candles: DataFrame, interval: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Candles of one interval between two inclusive bounds; plain filters, so partitions and row groups are pruned."""
    out = candles.filter(F.col("interval") == normalize_interval(F.lit(interval)))
    if start is not None:
        out = out.filter(F.col("ts") >= parse_bound(F.lit(start)))
    if end is not None:
        out = out.filter(F.col("ts") <= parse_bound(F.lit(end), is_end=True))
    return out


def series_bounds(candles: DataFrame) -> DataFrame:
    return candles.groupBy(*KEYS).agg(F.min("ts").alias("earliest"), F.max("ts").alias("latest"), F.count(F.lit(1)).alias("rows"))


def coverage_audit(candles: DataFrame, symbols: DataFrame, intervals: list[str]) -> DataFrame:
    """Series of symbols x intervals without rows; missing columns are reported for every series."""
    missing = [c for c in CANDLE_COLUMNS if c not in candles.columns]
    wanted = symbols.select("symbol").distinct().withColumn("interval", F.explode(F.array(*[F.lit(i) for i in intervals])))
    if missing:
        return wanted.withColumn("reason", F.lit(f"columns missing: {', '.join(missing)}"))
    return wanted.join(candles.select(*KEYS).distinct(), KEYS, "left_anti").withColumn("reason", F.lit("no rows"))


def _keys_of(path: Column) -> dict[str, Column]:
    """Symbol and interval of a stored file, by its folders."""
    return {k: F.url_decode(F.regexp_extract(path, f"/{k}=([^/]+)/", 1)) for k in KEYS}


def audit_files(spark: SparkSession, path: str, symbols: DataFrame, intervals: list[str]) -> DataFrame:
    """(symbol, interval, files, rows, reason) of every wanted series of a stored table.

    The reason is "no file", "empty" (files without a row), "columns missing: ..." (columns that none of the series' rows
    has), or null for a whole series. Files are listed by Spark without their contents; keys come from
    folders, so that a symbol keeps its text.
    """
    wanted = symbols.select("symbol").distinct().withColumn("interval", F.explode(F.array(*[F.lit(i) for i in intervals])))
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    files = listed.select(F.concat("path", F.lit("/")).alias("path")).withColumns(_keys_of(F.col("path"))).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("files"))
    columns = [c for c in CANDLE_COLUMNS if c not in KEYS]
    stored = StructType([f for f in spark.createDataFrame([], CANDLE).schema if f.name in columns])
    rows = spark.read.schema(stored).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(path)
    counts = rows.select(*columns, F.col("_metadata.file_path").alias("path")).withColumns(_keys_of(F.col("path"))).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(f"_{c}") for c in columns])
    out = wanted.join(files, KEYS, "left").join(counts, KEYS, "left")
    missing = F.concat_ws(", ", *[F.when(F.col(f"_{c}") == 0, F.lit(c)) for c in columns])
    reason = F.when(F.col("files").isNull(), "no file").when(F.col("rows").isNull(), "empty").when(missing != "", F.concat(F.lit("columns missing: "), missing))
    return out.select(*KEYS, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("files", "rows")], reason.alias("reason"))


# Days one request may span.
CHUNK_DAYS = {"day": 1800, "60minute": 365}
OTHER_CHUNK_DAYS = 55


def plan_backfill(ranges: DataFrame) -> DataFrame:
    """Requests that cover ranges (symbol, interval, start, end); the next one starts a second after the last."""
    days = F.lit(OTHER_CHUNK_DAYS)
    for name, n in CHUNK_DAYS.items():
        days = F.when(normalize_interval(F.col("interval")) == name, n).otherwise(days)
    step = days * 86400 + 1
    whole = F.timestamp_diff("SECOND", F.col("start"), F.col("end"))
    rows = ranges.filter("start <= end").withColumns({"_days": days, "chunk": F.explode(F.sequence(F.lit(0).cast("long"), F.floor(whole / step)))})
    begin = F.col("start") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("chunk") * (F.col("_days") * 86400 + 1)).cast("decimal(18,6)"))
    rows = rows.withColumn("chunk_start", begin)
    stop = F.least(F.col("chunk_start") + F.make_dt_interval(F.col("_days")), F.col("end"))
    return rows.withColumn("chunk_end", stop).drop("_days")


def read_ticks(spark: SparkSession, path: str, schema: str | StructType, fmt: str = "parquet", **options: str) -> DataFrame:
    """A stream of ticks from files (or, with ``fmt``, another Spark source)."""
    return spark.readStream.schema(schema).format(fmt).options(**options).load(path)


#: A tick of a message; times are texts there.
_MESSAGE = "array<struct<" + ",".join(f.strip().replace(" ", ":").replace(":timestamp", ":string") for f in TICK.split(",")) + ">>"


def parse_messages(messages: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(ticks, bad messages) of JSON messages, each one tick or a list of ticks; batch or stream.

    Ticks carry the messages' other columns and come with their fields settled (``tick_fields``), times as market wall
    clock. A message that is no JSON of ticks is kept whole in the second table; a tick without a time or a price is
    no error of the message and is dropped, as is an empty list.
    """
    rest = [c for c in messages.columns if c != column]
    text = F.trim(F.col(column))
    # an object is read as a list of one; other JSON (a number, a text) is no message
    shaped = F.when(text.rlike(r"(?s)^[\[{].*[\]}]$"), F.from_json(text, _MESSAGE))
    read = messages.withColumn("_ticks", shaped)
    good = read.where(F.col("_ticks").isNotNull()).select(*rest, F.explode("_ticks").alias("_t")).select(*rest, "_t.*")
    times = ("timestamp", "exchange_timestamp", "last_trade_time")
    good = good.withColumns({c: parse_bound(F.col(c)) for c in times})
    return tick_fields(good), read.where(F.col("_ticks").isNull()).select(messages.columns)


def market_ticks(ticks: DataFrame, time: str) -> DataFrame:
    """Ticks with their event time as market wall clock."""
    return ticks.withColumn(time, to_market_time(F.col(time)))


def resolve_instruments(symbols: DataFrame, instruments: DataFrame) -> DataFrame:
    """Symbols (exchange, symbol) with their instrument token; the first listed instrument wins.

    The order of instruments is their ``position`` column, else the token. The master is small
    against ticks; Spark picks the join by its size.
    """
    order = "position" if "position" in instruments.columns else "instrument_token"
    first = Window.partitionBy("exchange", F.upper("tradingsymbol")).orderBy(order)
    one = instruments.withColumn("_r", F.row_number().over(first)).filter("_r = 1")
    one = one.select("exchange", F.upper("tradingsymbol").alias("symbol"), "instrument_token")
    return symbols.join(one, ["exchange", "symbol"], "left")


def unresolved(symbols: DataFrame, instruments: DataFrame) -> DataFrame:
    return resolve_instruments(symbols, instruments).filter(F.col("instrument_token").isNull()).drop("instrument_token")
