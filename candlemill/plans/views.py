"""Market-data views over the driver's tables, as DataFrames and as SQL.

``ticks``: trades from ``events``, ten users an instrument; ``hourly``: their 60-minute candles; ``day``: day
candles from ``lineitem``, a supplier a series; ``rows``: one candle for each line item. Series grow in number
with the tables. The SQL text of each view is a list of
common table expressions for the oracle side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlemill.operators.candles import ticks_to_candles, volume_delta
from candlemill.schemas import CANDLE_COLUMNS

TIE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbol():
    return F.concat_ws("-", "event_type", F.floor(F.col("user_id") / 10))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(token, symbol, event_time, event_id, last_price, trade_quantity, volume_traded); cumulative volume resets at 500."""
    e = table(spark, sf_dir, "events")
    q = F.coalesce(F.get_json_object("props", "$.k").cast("double"), F.lit(0.0))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(
        F.col("user_id").alias("token"), symbol().alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("event_time"), "event_id",
        F.col("value").alias("last_price"), q.alias("trade_quantity"), (F.sum(q).over(w) % 500).alias("volume_traded"),
    )


def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volume_delta(ticks(spark, sf_dir), "token", ["event_time", "event_id"])


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks_to_candles(deltas(spark, sf_dir), "60minute", order=["event_time", "event_id"]).select(CANDLE_COLUMNS)


def day(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    trades = t.select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"), F.col("l_shipdate").cast("timestamp_ntz").alias("event_time"), price.alias("last_price"), F.col("l_quantity").alias("volume_delta"), *TIE)
    return ticks_to_candles(trades, "day", order=["event_time", *TIE]).select(CANDLE_COLUMNS)


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    o = F.col("l_extendedprice") / F.col("l_quantity")
    c = o * (1 + F.col("l_tax") - F.col("l_discount"))
    second = F.row_number().over(Window.partitionBy("l_suppkey", "l_shipdate").orderBy(*TIE))
    return t.select(
        F.col("l_suppkey").cast("string").alias("symbol"), F.lit("minute").alias("interval"),
        (F.col("l_shipdate").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), second)).alias("ts"), o.alias("open"),
        (F.greatest(o, c) + (F.col("l_partkey") % 7) * 0.01 * o).alias("high"), (F.least(o, c) - (F.col("l_suppkey") % 5) * 0.02 * o).alias("low"),
        c.alias("close"), F.col("l_quantity").alias("volume"),
    )


def long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``rows`` of nine suppliers in ten as one series, ``ONE``: nine tenths of the table in one series, a second a row of a day."""
    t = table(spark, sf_dir, "lineitem")
    name = F.when(F.col("l_suppkey") % 10 == 0, F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))).otherwise("ONE")
    o = F.col("l_extendedprice") / F.col("l_quantity")
    c = o * (1 + F.col("l_tax") - F.col("l_discount"))
    named = t.withColumns({"symbol": name, "o": o, "c": c})
    second = F.row_number().over(Window.partitionBy("symbol", "l_shipdate").orderBy(*TIE))
    return named.select(
        "symbol", F.lit("minute").alias("interval"), (F.col("l_shipdate").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), second)).alias("ts"), F.col("o").alias("open"),
        (F.greatest("o", "c") + (F.col("l_partkey") % 7) * 0.01 * F.col("o")).alias("high"), (F.least("o", "c") - (F.col("l_suppkey") % 5) * 0.02 * F.col("o")).alias("low"),
        F.col("c").alias("close"), F.col("l_quantity").alias("volume"),
    )


_TIE = ", ".join(TIE)

TICKS_SQL = """ticks as (
    select user_id as token, event_type || '-' || cast(floor(user_id / 10) as bigint) as symbol, ts as event_time, event_id, value as last_price,
        coalesce(cast(json_extract_string(props, '$.k') as double), 0.0) as trade_quantity,
        sum(coalesce(cast(json_extract_string(props, '$.k') as double), 0.0)) over (partition by user_id order by ts, event_id rows unbounded preceding) % 500 as volume_traded
    from events)"""

DELTAS_SQL = TICKS_SQL + """,
    tick_order as (select *, lag(volume_traded) over (partition by token order by event_time, event_id) as before from ticks),
    deltas as (select * exclude (before), case when volume_traded >= before then volume_traded - before else trade_quantity end as volume_delta from tick_order)"""


def bucket_sql(ts: str, minutes: int) -> str:
    seconds = f"(extract(hour from {ts}) * 3600 + extract(minute from {ts}) * 60 + extract(second from {ts}))"
    return f"(date_trunc('day', {ts})::timestamp + to_minutes(cast(555 + floor(({seconds} - 33300) / {minutes * 60}.0) * {minutes} as bigint)))"


HOURLY_SQL = DELTAS_SQL + f""",
    candles as materialized (
    select symbol, '60minute' as "interval", {bucket_sql("event_time", 60)} as ts,
        first(last_price order by event_time, event_id) as open, max(last_price) as high, min(last_price) as low,
        last(last_price order by event_time, event_id) as close, sum(volume_delta) as volume
    from deltas group by 1, 2, 3)"""

DAY_SQL = f"""candles as materialized (
    select 'S' || l_suppkey as symbol, 'day' as "interval", date_trunc('day', l_shipdate)::timestamp + interval 555 minute as ts,
        first(l_extendedprice / l_quantity order by l_shipdate, {_TIE}) as open, max(l_extendedprice / l_quantity) as high,
        min(l_extendedprice / l_quantity) as low, last(l_extendedprice / l_quantity order by l_shipdate, {_TIE}) as close, sum(l_quantity) as volume
    from lineitem group by 1, 2, 3)"""

ROWS_SQL = f"""line_rows as (
    select *, l_extendedprice / l_quantity as o, l_extendedprice / l_quantity * (1 + l_tax - l_discount) as c,
        row_number() over (partition by l_suppkey, l_shipdate order by {_TIE}) as s from lineitem),
    candles as (
    select cast(l_suppkey as varchar) as symbol, 'minute' as "interval", l_shipdate + to_seconds(s) as ts, o as open,
        greatest(o, c) + (l_partkey % 7) * 0.01::double * o as high, least(o, c) - (l_suppkey % 5) * 0.02::double * o as low, c as close, l_quantity as volume
    from line_rows)"""

LONG_SQL = f"""named_rows as (
    select *, case when l_suppkey % 10 = 0 then 'S' || l_suppkey else 'ONE' end as symbol, l_extendedprice / l_quantity as o, l_extendedprice / l_quantity * (1 + l_tax - l_discount) as c from lineitem),
    long_rows as (select *, row_number() over (partition by symbol, l_shipdate order by {_TIE}) as s from named_rows),
    candles as materialized (
    select symbol, 'minute' as "interval", l_shipdate + to_seconds(s) as ts, o as open,
        greatest(o, c) + (l_partkey % 7) * 0.01::double * o as high, least(o, c) - (l_suppkey % 5) * 0.02::double * o as low, c as close, l_quantity as volume
    from long_rows)"""
