"""Registered market-data queries, and the same results as DuckDB SQL.

Doubles are rounded to six digits on both sides, as sums may be taken in another order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlemill.functions import geometry, ticks, time, units
from candlemill.functions.scaling import clip_atr, clip_macd, clip_zscore, scale_oscillator
from candlemill.operators import dataset, evaluate, features, labels, longseries, recurrence, series
from candlemill.operators import indicators as ind
from candlemill.operators.candles import ticks_to_candles
from candlemill.operators.registry import Registry, table_function
from candlemill.plans import views
from candlemill.schemas import CANDLE, CANDLE_COLUMNS, require
from candlemill.session import shared_dir, written
from candlemill.sources import store
from candlemill.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


#: Added before a floor to six digits: prices with few decimals never come near the step, as they would with halves.
_STEP = 0.2718281828


def rounded(df: DataFrame, *keep: str) -> DataFrame:
    """Doubles cut to six digits."""
    return df.select(*[(F.floor(F.col(c) * 1e6 + _STEP) / 1e6).alias(c) if kind == "double" and c not in keep else F.col(c) for c, kind in df.dtypes])


def r6(x: str) -> str:
    return f"floor(({x})::double * 1e6 + {_STEP}) / 1e6"


KEYS = ["symbol", "interval", "ts"]
_K = 'symbol, "interval", ts'
_W = 'partition by symbol, "interval" order by ts'


def back(n: int | None) -> str:
    return f"({_W} rows between {'unbounded' if n is None else n} preceding and current row)"


# --- candles -----------------------------------------------------------------

_OHLC = f"select {_K}, {', '.join(f'{r6(c)} as {c}' for c in ('open', 'high', 'low', 'close', 'volume'))} from candles"


@query("ticks_to_candles", f"with {views.HOURLY_SQL} {_OHLC}")
def _(spark, sf):
    return rounded(views.hourly(spark, sf))


@query("day_candles", f"with {views.DAY_SQL} {_OHLC}")
def _(spark, sf):
    return rounded(views.day(spark, sf))


for _name, _minutes in (("minute", 1), ("5minute", 5), ("15minute", 15)):

    @query(f"ticks_to_candles_{_name}", f"with {views.DELTAS_SQL}, candles as (select symbol, '{_name}' as \"interval\", {views.bucket_sql('event_time', _minutes)} as ts, first(last_price order by event_time, event_id) as open, max(last_price) as high, min(last_price) as low, last(last_price order by event_time, event_id) as close, sum(volume_delta) as volume from deltas group by 1, 2, 3) {_OHLC}")
    def _(spark, sf, name=_name):
        return rounded(ticks_to_candles(views.deltas(spark, sf), name, order=["event_time", "event_id"]).select(*KEYS, "open", "high", "low", "close", "volume"))


@query("volume_delta", f"with {views.DELTAS_SQL} select token, event_id, {r6('volume_delta')} as volume_delta from deltas")
def _(spark, sf):
    return rounded(views.deltas(spark, sf).select("token", "event_id", "volume_delta"))


@query("candle_bucket", f"select event_id, {views.bucket_sql('ts', 15)} as b15, {views.bucket_sql('ts', 60)} as b60, date_trunc('day', ts)::timestamp + interval 555 minute as b_day, date_trunc('week', ts)::timestamp + interval 555 minute as b_week from events")
def _(spark, sf):
    t = F.col("ts").cast("timestamp_ntz")
    b = lambda i: time.candle_bucket(t, F.lit(i))
    return views.table(spark, sf, "events").select("event_id", b("15m").alias("b15"), b("1h").alias("b60"), b("1d").alias("b_day"), b("1w").alias("b_week"))


@query("is_same_candle", f"select event_id, {views.bucket_sql('ts', 30)} = {views.bucket_sql('t2', 30)} as same from (select event_id, ts, ts + to_seconds(event_id % 3600) as t2 from events)")
def _(spark, sf):
    t = F.col("ts").cast("timestamp_ntz")
    other = t + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("event_id") % 3600)
    return views.table(spark, sf, "events").select("event_id", time.is_same_candle(t, other, F.lit("30minute")).alias("same"))


@query("normalize_interval", """with a as (select event_id, (['1m', ' 5MIN ', '1h', '1D', 'day', '7x'])[1 + event_id % 6] as raw from events)
    select event_id, case lower(trim(raw)) when '1m' then 'minute' when '5min' then '5minute' when '1h' then '60minute' when '1d' then 'day' else lower(trim(raw)) end as name,
        case lower(trim(raw)) when '1m' then 1 when '5min' then 5 when '1h' then 60 when '1d' then 1440 when 'day' then 1440 end as minutes from a""")
def _(spark, sf):
    raw = F.get(F.array(*[F.lit(x) for x in ("1m", " 5MIN ", "1h", "1D", "day", "7x")]), (F.col("event_id") % 6).cast("int"))
    return views.table(spark, sf, "events").select("event_id", time.normalize_interval(raw).alias("name"), time.interval_minutes(raw).alias("minutes"))


@query("to_market_time", "select event_id, ts + interval 330 minute as wall from events")
def _(spark, sf):
    return views.table(spark, sf, "events").select("event_id", time.to_market_time(F.to_utc_timestamp(F.from_utc_timestamp(F.col("ts").cast("timestamp_ntz"), "UTC"), "UTC")).alias("wall"))


@query("parse_bound", """select event_id, date_trunc('day', ts)::timestamp as start_bound, date_trunc('day', ts)::timestamp + interval 1 day - interval 1 microsecond as end_bound,
    date_trunc('second', ts) + interval 330 minute as zoned, date_trunc('second', ts) as naive from events""")
def _(spark, sf):
    e = views.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    day, second = F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return e.select(
        "event_id", time.parse_bound(day).alias("start_bound"), time.parse_bound(day, is_end=True).alias("end_bound"),
        time.parse_bound(F.concat(second, F.lit("Z"))).alias("zoned"), time.parse_bound(second).alias("naive"),
    )


@query("parse_symbol", "select event_id, case when event_id % 2 = 0 then 'BSE' else 'NSE' end as exchange, upper(event_type) as symbol from events")
def _(spark, sf):
    raw = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("bse: "), F.col("event_type"))).otherwise(F.col("event_type"))
    exchange, symbol = ticks.parse_symbol(raw)
    return views.table(spark, sf, "events").select("event_id", exchange.alias("exchange"), symbol.alias("symbol"))


@query("tick_fields", """with e as (select event_id, ts, case when event_id % 7 = 0 then null else value end as p, coalesce(cast(json_extract_string(props, '$.k') as double), 0.0) as k from events)
    select event_id, case when event_id % 3 = 0 then ts else ts + interval 1 second end as event_time, case when event_id % 2 = 0 and k <> 0 then k else 5.0 end as trade_quantity from e where p is not null""")
def _(spark, sf):
    e = views.table(spark, sf, "events")
    t, k, i = F.col("ts").cast("timestamp_ntz"), F.get_json_object("props", "$.k").cast("double"), F.col("event_id")
    raw = e.select(
        "event_id", F.when(i % 3 == 0, t).alias("timestamp"), (t + F.expr("interval 1 second")).alias("exchange_timestamp"), F.lit(None).cast("timestamp_ntz").alias("last_trade_time"),
        F.when(i % 7 != 0, F.col("value")).alias("last_price"), F.when(i % 2 == 0, F.coalesce(k, F.lit(0.0))).otherwise(0.0).alias("last_traded_quantity"),
        F.lit(None).cast("double").alias("last_quantity"), F.lit(5.0).alias("quantity"),
    )
    return ticks.tick_fields(raw).select("event_id", "event_time", "trade_quantity")


# --- geometry ----------------------------------------------------------------

GEOMETRY_SQL = views.ROWS_SQL + """,
    sized as (select *, abs(close - open) as body_size, greatest(high - low, 0.0) as candle_size,
        greatest(high - greatest(open, close), 0.0) as upper_wick_size, greatest(least(open, close) - low, 0.0) as lower_wick_size from candles),
    shaped as (select *, upper_wick_size / nullif(candle_size, 0) - 0.5 as upper_wick_to_candle_ratio, lower_wick_size / nullif(candle_size, 0) - 0.5 as lower_wick_to_candle_ratio,
        body_size / nullif(candle_size, 0) - 0.5 as body_to_candle_ratio, upper_wick_size / nullif(body_size, 0) as upper_wick_to_body_ratio,
        lower_wick_size / nullif(body_size, 0) as lower_wick_to_body_ratio, (upper_wick_size - lower_wick_size) / nullif(candle_size, 0) as wick_difference_to_candle_ratio,
        case when lower_wick_size > upper_wick_size then 'green' else 'red' end as candle_color,
        case when candle_size = 0 or body_size <= candle_size * 0.1::double then 'doji' when body_size >= candle_size * 0.9::double then 'marubozu'
            when lower_wick_size >= body_size * 2 and upper_wick_size <= body_size then 'hammer' when upper_wick_size >= body_size * 2 and lower_wick_size <= body_size then 'inverted_hammer'
            when body_size <= candle_size * 0.3::double then 'spinning_top' else 'standard' end as candle_type from sized)"""
_SHAPE = ["body_size", "candle_size", "upper_wick_size", "lower_wick_size", "upper_wick_to_candle_ratio", "lower_wick_to_candle_ratio", "body_to_candle_ratio", "upper_wick_to_body_ratio", "lower_wick_to_body_ratio", "wick_difference_to_candle_ratio"]


@query("candle_geometry", f"with {GEOMETRY_SQL} select {_K}, {', '.join(f'{r6(c)} as {c}' for c in _SHAPE)} from shaped")
def _(spark, sf):
    return rounded(geometry.with_geometry(views.rows(spark, sf)).select(*KEYS, *_SHAPE))


@query("candle_color", f"with {GEOMETRY_SQL} select {_K}, candle_color from shaped")
def _(spark, sf):
    return geometry.with_geometry(views.rows(spark, sf)).select(*KEYS, "candle_color")


_DESCRIBE = "case candle_type " + " ".join(f"when '{k}' then '{v}'" for k, v in geometry.DESCRIPTIONS.items()) + " end"


@query("candle_type", f"with {GEOMETRY_SQL} select {_K}, candle_type, {_DESCRIBE} as description from shaped")
def _(spark, sf):
    return geometry.with_geometry(views.rows(spark, sf)).select(*KEYS, "candle_type", geometry.describe_type(F.col("candle_type")).alias("description"))


_HOT = {f"candle_color_{v}": f"candle_color = '{v}'" for v in geometry.COLORS} | {f"candle_type_{v}": f"candle_type = '{v}'" for v in geometry.TYPES}


@query("one_hot", f"with {GEOMETRY_SQL} select {_K}, {', '.join(f'cast({v} as int) as {k}' for k, v in _HOT.items())} from shaped")
def _(spark, sf):
    return geometry.with_geometry(views.rows(spark, sf)).select(*KEYS, *[c.alias(n) for n, c in geometry.one_hot().items()])


# --- indicators over day candles ----------------------------------------------

_BASE = f"with recursive {views.DAY_SQL}, numbered as (select *, row_number() over ({_W}) as rn, lag(close) over ({_W}) as pc, lag(high) over ({_W}) as ph, lag(low) over ({_W}) as pl from candles)"


def window_sql(value: str, ctes: str = "") -> str:
    """Rows (symbol, interval, ts, value) of an expression over ``numbered`` (with rn from 1), or over ``staged``."""
    return f"{_BASE}{ctes} select {_K}, ({value}) as value from {'staged' if 'staged as' in ctes else 'numbered'}"


def cut_value(raw: str) -> str:
    return f"select {_K}, {r6('value')} as value from ({raw})"


def indicator(name: str, add: Callable[[], ind.Add], sql: str, ctes: str = "") -> None:
    """A window indicator on day candles and its SQL (``window_sql``)."""
    query(name, cut_value(window_sql(sql, ctes)))(lambda spark, sf: rounded(add()(views.day(spark, sf), "value").select(*KEYS, "value")))


def _avg(x: str, p: int) -> str:
    return f"avg({x}) over {back(p - 1)}"


_TP = "(high + low + close) / 3"
_TR = "case when pc is not null then greatest(high - low, abs(high - pc), abs(low - pc)) end"
_CHANGES = ", moved as (select *, case when pc is not null then greatest(close - pc, 0.0) end as g, case when pc is not null then greatest(pc - close, 0.0) end as l from numbered)"


def _rsi_ctes(p: int) -> str:
    return _CHANGES + f", means as (select *, avg(g) over {back(p - 1)} as ag, avg(l) over {back(p - 1)} as al from moved), staged as (select *, case when rn > {p} then case when al = 0 then 100.0 else 100.0 - 100.0 / (1.0 + ag / al) end end as rsi from means)"


def _stoch(high: str, low: str, value: str, p: int) -> str:
    lo, hi = f"min({low}) over {back(p - 1)}", f"max({high}) over {back(p - 1)}"
    return f"({value} - {lo}) / nullif({hi} - {lo}, 0) * 100.0"


def _stage(value: str, source: str = "numbered") -> str:
    return f", staged as (select *, {value} from {source})"


def sma_sql(p: int, x: str = "close") -> str:
    return window_sql(f"case when rn >= {p} then {_avg(x, p)} end")


def vwap_sql(p: int | None) -> str:
    v = f"sum({_TP} * volume) over {back(p and p - 1)} / nullif(sum(volume) over {back(p and p - 1)}, 0)"
    return window_sql(f"case when rn >= {p or 1} then {v} end")


def vwap_distance_sql(p: int) -> str:
    return window_sql("(close - v) / nullif(v, 0)", _stage(f"case when rn >= {p} then sum({_TP} * volume) over {back(p - 1)} / nullif(sum(volume) over {back(p - 1)}, 0) end as v"))


def rsi_sql(p: int) -> str:
    return window_sql("rsi", _rsi_ctes(p))


def bbw_sql(p: int) -> str:
    return window_sql(f"case when rn >= {p} then 4.0 * stddev_pop(close) over {back(p - 1)} / nullif({_avg('close', p)}, 0) end")


def atr_sql(p: int) -> str:
    return window_sql(f"case when rn > {p} then a end", f", ranged as (select *, {_TR} as tr from numbered)" + _stage(f"{_avg('tr', p)} as a", "ranged"))


def volatility_sql(p: int, scale: str = "1.0") -> str:
    return window_sql(f"case when rn > {p} and count(r) over {back(p - 1)} = {p} then stddev_pop(r) over {back(p - 1)} * {scale} end", _stage("case when pc > 0 and close > 0 then ln(close / pc) end as r"))


def stochastic_sql(p: int) -> str:
    return window_sql(f"case when rn >= {p} then {_stoch('high', 'low', 'close', p)} end")


def stochastic_rsi_sql(p: int, q: int) -> str:
    return window_sql(f"case when rn > {p + q - 1} then {_stoch('rsi', 'rsi', 'rsi', q)} end", _rsi_ctes(p))


def obv_sql() -> str:
    return window_sql(f"case when rn > 1 then sum(case when close > pc then volume when close < pc then -volume else 0.0 end) over {back(None)} end")


def zscore_sql(n: int) -> str:
    """Unscaled; infinite where all volumes before are equal and this one is not."""
    past = f"({_W} rows between {n} preceding and 1 preceding)"
    return window_sql(f"case when c = {n} and x is not null then case when s > 0 then (x - m) / s when x > m then 'inf'::double when x < m then '-inf'::double else 0.0 end end",
                      ", logged as (select *, case when volume >= 0 then ln(1 + volume) end as x from numbered)" + _stage(f"count(x) over {past} as c, avg(x) over {past} as m, stddev_samp(x) over {past} as s", "logged"))


def _put(name: str, add: Callable[[], ind.Add], raw: str, value: str = "value") -> None:
    query(name, cut_value(raw) if value == "value" else f"select {_K}, {r6(value)} as value from ({raw})")(lambda spark, sf: rounded(add()(views.day(spark, sf), "value").select(*KEYS, "value")))


def _ratio_to_close(x: str, low: float) -> str:
    return f"case when {x} / nullif(close, 0) is not null then greatest(least({x} / nullif(close, 0), 0.05::double), {low}::double) / 0.05::double else 0.0 end"


_Z = "case when value is not null then greatest(least(value, 3.0), -3.0) / 3 else 0.0 end"
_put("sma", lambda: ind.sma(20), sma_sql(20))
_put("vma", lambda: ind.vma(20), sma_sql(20, "volume"))
_put("vwap", lambda: ind.vwap(), vwap_sql(None))
_put("vwap_rolling", lambda: ind.vwap(20), vwap_sql(20))
_put("vwap_distance", lambda: ind.vwap_distance(20), vwap_distance_sql(20))
_put("rsi", lambda: ind.rsi(14), rsi_sql(14))
_put("bbw", lambda: ind.bbw(20), bbw_sql(20))
indicator("true_range", lambda: ind.true_range(), _TR)
_put("atr", lambda: ind.atr(14), atr_sql(14))
indicator("directional_movement_plus", lambda: ind.directional_movement(True), "case when pc is null then null when high - ph > pl - low and high - ph > 0 then high - ph else 0.0 end")
indicator("directional_movement_minus", lambda: ind.directional_movement(False), "case when pc is null then null when pl - low > high - ph and pl - low > 0 then pl - low else 0.0 end")
_put("rolling_volatility", lambda: ind.rolling_volatility(20, 252), volatility_sql(20, "sqrt(252.0)"))
_put("stochastic", lambda: ind.stochastic(14), stochastic_sql(14))
_put("stochastic_rsi", lambda: ind.stochastic_rsi(14, 14), stochastic_rsi_sql(14, 14))
_put("obv", lambda: ind.obv(), obv_sql())
_put("scale_oscillator", lambda: lambda df, n: ind.stochastic(14)(df, "_x").withColumn(n, scale_oscillator(F.col("_x"))).drop("_x"), stochastic_sql(14), "(value - 50.0) / 50.0")
_put("log_volume_zscore", lambda: lambda df, n: ind.log_volume_zscore(5)(df, n).withColumn(n, clip_zscore(F.col(n))), zscore_sql(5), _Z)
indicator("clip_atr", lambda: lambda df, n: ind.atr(14)(df, "_x").withColumn(n, clip_atr(F.col("_x"), F.col("close"))).drop("_x"), _ratio_to_close("case when rn > 14 then a end", 0.0), f", ranged as (select *, {_TR} as tr from numbered)" + _stage(f"{_avg('tr', 14)} as a", "ranged"))


def _ema_cte(name: str, source: str, p: int, alpha: str | None = None) -> str:
    """EMA of (symbol, k, x) seeded with the mean of the first ``p``; rows (symbol, k, v)."""
    a = alpha or f"(2.0::double / ({p} + 1))"
    return (
        f", {name} as (select symbol, {p}::bigint as k, avg(x)::double as v from {source} where k <= {p} group by symbol having count(*) = {p}"
        f" union all select s.symbol, s.k, e.v + (s.x - e.v) * {a} from {name} e join {source} s on s.symbol = e.symbol and s.k = e.k + 1)"
    )


def scan_sql(cte: str, ctes: str) -> str:
    """Rows (symbol, interval, ts, value) of a recurrence: ``cte`` has (symbol, k, v)."""
    return f"{_BASE}, xc as (select symbol, rn as k, close as x from numbered), xv as (select symbol, rn as k, volume as x from numbered){ctes} select n.symbol, n.\"interval\", n.ts, e.v as value from numbered n left join {cte} e on e.symbol = n.symbol and e.k = n.rn"


def scan(name: str, spec: recurrence.Scan, raw: str) -> None:
    query(name, cut_value(raw))(lambda spark, sf: rounded(recurrence.with_recurrences(views.day(spark, sf), {"value": spec}).select(*KEYS, "value")))


def ema_sql(p: int, source: str = "xc") -> str:
    return scan_sql("e1", _ema_cte("e1", source, p))


_MACD = _ema_cte("f", "xc", 12) + _ema_cte("s", "xc", 26) + ", m as (select s.symbol, s.k, f.v - s.v as v from s join f using (symbol, k))"
SLOPE_SQL = scan_sql("sl", _ema_cte("e1", "xc", 9) + ", sl as (select a.symbol, a.k, (a.v - b.v) / 3 / nullif(abs(b.v), 0) as v from e1 a join e1 b on a.symbol = b.symbol and b.k = a.k - 3)")
MACD_SQL = scan_sql("m", _MACD)
HIST_SQL = scan_sql("h", _MACD + ", xm as (select symbol, k - 25 as k, v as x from m)" + _ema_cte("g", "xm", 9) + ", h as (select m.symbol, m.k, m.v - g.v as v from m join g on g.symbol = m.symbol and g.k = m.k - 25)")
scan("ema", recurrence.ema(9), ema_sql(9))
scan("vema", recurrence.ema(9, "volume"), ema_sql(9, "xv"))
scan("ema_slope", recurrence.ema_slope(9, 3), SLOPE_SQL)
scan("macd", recurrence.macd(12, 26), MACD_SQL)
scan("vmacd", recurrence.macd(12, 26, "volume"), scan_sql("m", _MACD.replace("xc", "xv")))
scan("macd_hist", recurrence.macd_hist(12, 26, 9), HIST_SQL)
_ADX = (
    f", moves as (select symbol, rn - 1 as k, {_TR} as tr, case when high - ph > pl - low and high - ph > 0 then high - ph else 0.0 end as dp, case when pl - low > high - ph and pl - low > 0 then pl - low else 0.0 end as dm from numbered where pc is not null)"
    ", xt as (select symbol, k, tr as x from moves), xp as (select symbol, k, dp as x from moves), xq as (select symbol, k, dm as x from moves)"
    + "".join(_ema_cte(n, s, 14, "(1.0::double / 14)") for n, s in (("wt", "xt"), ("wp", "xp"), ("wq", "xq")))
    + ", dx as (select symbol, k, 100.0 * abs(p.v / t.v - q.v / t.v) / (p.v / t.v + q.v / t.v) as x from wt t join wp p using (symbol, k) join wq q using (symbol, k) where t.v <> 0 and p.v + q.v <> 0)"
    ", xd as (select symbol, row_number() over (partition by symbol order by k) as k, k as row, x from dx)"
    + _ema_cte("wa", "xd", 14, "(1.0::double / 14)")
    + ", ax as (select d.symbol, d.row + 1 as k, a.v from wa a join xd d on d.symbol = a.symbol and d.k = a.k)"
)
ADX_SQL = scan_sql("ax", _ADX)
scan("adx", recurrence.adx(14), ADX_SQL)


def joined(parts: dict[str, str], source: str = "candles", ctes: str = "") -> str:
    """SQL: ``source`` (k) with the value of each part under its name."""
    return f"(select k.*, {', '.join(f'{n}.value as {n}' for n in parts)} from {source} k " + " ".join(f"join ({raw}) {n} on {n}.symbol = k.symbol and {n}.ts = k.ts" for n, raw in parts.items()) + ")"


@query("clip_macd", f"with recursive {views.DAY_SQL} select {_K}, {r6(_ratio_to_close('m', -0.05))} as value from {joined({'m': MACD_SQL})}")
def _(spark, sf):
    out = recurrence.with_recurrences(views.day(spark, sf), {"_m": recurrence.macd()})
    return rounded(out.select(*KEYS, clip_macd(F.col("_m"), F.col("close")).alias("value")))


@query("chunked_ema", ORACLE["ema"])
def _(spark, sf):
    return rounded(longseries.scan(views.day(spark, sf), "value", longseries.ema(9), 256).select(*KEYS, "value"))


def _long(name: str, add: Callable[[DataFrame], DataFrame], raw: str) -> None:
    """An indicator by chunks of 64 rows, where one series holds nine rows in ten; the SQL is that of the unchunked one."""
    query(f"long_{name}", cut_value(raw).replace(views.DAY_SQL, views.LONG_SQL))(lambda spark, sf: rounded(add(views.long(spark, sf)).select(*KEYS, "value")))


_long("vema", lambda c: longseries.scan(c, "value", longseries.ema(9, "volume"), 64), ema_sql(9, "xv"))
_long("macd", lambda c: longseries.scan(c, "value", longseries.macd(12, 26), 64), MACD_SQL)
_long("macd_hist", lambda c: longseries.scan(c, "value", longseries.macd_hist(12, 26, 9), 64), HIST_SQL)
_long("adx", lambda c: longseries.adx(c.select(*KEYS, "high", "low", "close"), "value", 14, size=64), ADX_SQL)
_long("vwap", lambda c: longseries.vwap(c, "value", 64), vwap_sql(None))
_long("obv", lambda c: longseries.obv(c, "value", 64), obv_sql())


@query("halo_sma", ORACLE["sma"])
def _(spark, sf):
    """The moving average over chunks of rows with copies of their neighbours' ends."""
    dealt = series.halo(series.number_rows(views.day(spark, sf)), 256, 19, 0)
    w = Window.partitionBy("symbol", "interval", "chunk").orderBy("rn").rowsBetween(-19, 0)
    out = dealt.withColumn("value", F.when(F.col("rn") >= 19, F.avg("close").over(w))).filter("core")
    return rounded(out.select(*KEYS, "value"))


_POPULAR = {
    "ma_20": sma_sql(20), "ma_50": sma_sql(50), "vwap": vwap_sql(None), "vwapdist_20": vwap_distance_sql(20), "rsi_14": rsi_sql(14), "bbw_20": bbw_sql(20), "atr_14": atr_sql(14),
    "rvol_20": volatility_sql(20), "stoch_14": stochastic_sql(14), "stochrsi_14_14": stochastic_rsi_sql(14, 14), "obv": obv_sql(),
    "ema_9": ema_sql(9), "ema_21": ema_sql(21), "emaslope_9_3": SLOPE_SQL, "macd_12_26": MACD_SQL, "macdhist_12_26_9": HIST_SQL, "adx_14": ADX_SQL,
}
_POPULAR_SQL = f"with {views.DAY_SQL} select {_K}, {', '.join(f'{r6(c)} as {c}' for c in ('open', 'high', 'low', 'close', 'volume', *_POPULAR))} from {joined(_POPULAR)}"


@query("popular_indicators", _POPULAR_SQL)
def _(spark, sf):
    windows, scans = ind.popular()
    return rounded(ind.add_indicators(views.day(spark, sf), windows, scans))


def drained(spark: SparkSession, rows: DataFrame, name: str, live_rows: Callable[[DataFrame], DataFrame], batch: str | None = None, batches: int = 1) -> DataFrame:
    """Rows written down, read as a stream, and what ``live_rows`` makes of it, drained to a table.

    With ``batch`` (a number from 0 to ``batches`` - 1 in each row) the rows of a number come in a micro-batch of their own, in order.
    """
    path = _fresh(spark, name)
    # so many files a micro-batch
    files = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // batches)
    if batch:
        # the rows are made once, by number, and then put in place number by number: a source takes files as they come
        rows.write.partitionBy(batch).parquet(f"{path}-all")
    for k in range(batches):
        at = f"{path}-all/{batch}={k}"
        if batch and not store.exists(spark, at):
            # an empty part would leave a file, and files are what a micro-batch counts
            continue
        part = spark.read.schema(rows.drop(batch).schema).parquet(at).repartition(files) if batch else rows
        part.write.mode("append").parquet(f"{path}-in")
        if batch:
            store.remove(spark, at)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    # a commit writes its changes, not all of the state
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    source = spark.readStream.schema(rows.drop(batch).schema if batch else rows.schema)
    source = source.option("maxFilesPerTrigger", files) if batch else source
    made = live_rows(source.parquet(f"{path}-in"))
    made.writeStream.format("parquet").option("checkpointLocation", f"{path}-cp").outputMode("append").trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.schema(made.schema).parquet(path)


def _stamped(df: DataFrame, kind: str, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(kind) for c in columns})


def _by_years(spark: SparkSession, sf: str) -> DataFrame:
    """Day candles for a stream, two years a micro-batch, so that a series' candles come in order."""
    c = _stamped(views.day(spark, sf), "timestamp", "ts")
    return c.withColumn("batch", F.least(F.lit(3), F.greatest(F.lit(0), F.floor((F.year("ts") - 1995) / 2))).cast("int"))


@query("stream_indicators", _POPULAR_SQL)
def _(spark, sf):
    """All popular indicators of live candles over four micro-batches; a series' values are those of the batch form."""
    out = drained(spark, _by_years(spark, sf), "indicators", live.stream_indicators, "batch", 4)
    return rounded(_stamped(out, "timestamp_ntz", "ts"))


#: Micro-batches of the live chain, each a sixth of the ticks' time.
_BATCHES = 6
_SLICED = f"sliced as (select *, least({_BATCHES - 1}, (epoch_us(event_time) - (select min(epoch_us(event_time)) from deltas)) * {_BATCHES} // (select greatest(1, max(epoch_us(event_time)) - min(epoch_us(event_time))) from deltas)) as slice, {views.bucket_sql('event_time', 60)} as ts from deltas)"


def _tick_slices(spark: SparkSession, sf: str) -> DataFrame:
    """Ticks with the number of their micro-batch."""
    t = _stamped(views.ticks(spark, sf), "timestamp", "event_time")
    at = F.unix_micros("event_time")
    least, most = t.agg(F.min(at), F.max(at)).first()
    slice_ = F.least(F.lit(_BATCHES - 1), F.expr(f"(unix_micros(event_time) - {least or 0}) * {_BATCHES} div {max(1, (most or 0) - (least or 0))}"))
    return t.withColumn("slice", slice_)


def _chain(spark: SparkSession, sf: str) -> DataFrame:
    """All that the live chain emits for the tick stream in six micro-batches: forming candles, then closed ones."""
    return drained(spark, _tick_slices(spark, sf), "chain", lambda s: live.live_chain(s, "60minute", "10 minutes"), "slice", _BATCHES)


@query("live_chain", f"select * from ({_POPULAR_SQL.replace(views.DAY_SQL, views.HOURLY_SQL)}) where ts + interval 60 minute <= (select max(ts) - interval 10 minute from events)")
def _(spark, sf):
    """One query from ticks over volume deltas and candles to indicators: closed candles equal the batch form."""
    return rounded(_chain(spark, sf).where("closed").drop("closed", "ticks", "end"))


@query("live_forming_candles", f"with {views.DELTAS_SQL}, {_SLICED}, seen as (select distinct symbol, ts, slice from sliced) select s.symbol, '60minute' as \"interval\", s.ts, count(*) as ticks, {r6('first(last_price order by event_time, event_id)')} as open, {r6('max(last_price)')} as high, {r6('min(last_price)')} as low, {r6('last(last_price order by event_time, event_id)')} as close, {r6('sum(volume_delta)')} as volume from seen s join sliced t on t.symbol = s.symbol and t.ts = s.ts and t.slice <= s.slice group by s.symbol, s.ts, s.slice")
def _(spark, sf):
    """Every micro-batch gives the candles it touched as the ticks so far make them."""
    return rounded(_chain(spark, sf).where("not closed").select(*KEYS, "ticks", "open", "high", "low", "close", "volume"))


@query("stream_volume_delta", f"with {views.DELTAS_SQL} select token, event_id, {r6('volume_delta')} as volume_delta from deltas")
def _(spark, sf):
    out = drained(spark, _tick_slices(spark, sf), "deltas", live.stream_volume_delta, "slice", _BATCHES)
    return rounded(out.select("token", "event_id", "volume_delta"))


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    """(event_id, value): a JSON message for each event, some of two ticks, some cut off, some with no price, zoned and naive times."""
    e, i = views.table(spark, sf, "events"), F.col("event_id")
    text = F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss")
    tick = F.struct(F.col("user_id").alias("instrument_token"), F.when(i % 11 != 0, F.col("value")).alias("last_price"), (i % 4).cast("double").alias("last_traded_quantity"), F.lit(3.0).alias("quantity"),
                    F.when(i % 2 == 0, F.concat(text, F.lit("Z"))).otherwise(text).alias("exchange_timestamp"), F.lit("x").alias("tradable"))
    one = F.to_json(tick)
    value = F.when(i % 13 == 0, F.expr("substring(m, 1, length(m) - 5)")).when(i % 17 == 0, F.lit("no json")).when(i % 3 == 0, F.concat(F.lit("["), "m", F.lit(", "), "m", F.lit("]"))).otherwise(F.col("m"))
    return e.select("event_id", one.alias("m")).select("event_id", value.alias("value"))


_GOOD = "event_id % 13 <> 0 and event_id % 17 <> 0"


@query("tick_messages", f"with n as (select *, unnest(range(case when event_id % 3 = 0 then 2 else 1 end)) as copy from events) select event_id, user_id as instrument_token, {r6('value')} as last_price, {r6('case when event_id % 4 = 0 then 3.0 else event_id % 4 end')} as trade_quantity, date_trunc('second', ts) + case when event_id % 2 = 0 then interval 330 minute else interval 0 minute end as event_time from n where {_GOOD} and event_id % 11 <> 0")
def _(spark, sf):
    """JSON tick messages, read as a stream: ticks with their fields settled."""
    out = drained(spark, _messages(spark, sf), "messages", lambda m: store.parse_messages(m)[0])
    return rounded(out.select("event_id", "instrument_token", "last_price", "trade_quantity", "event_time"))


@query("tick_messages_bad", f"select event_id, case when event_id % 13 = 0 then 'cut off' else 'no json' end as kind from events where not ({_GOOD})")
def _(spark, sf):
    """The messages of the same stream that are no ticks."""
    out = drained(spark, _messages(spark, sf), "messages", lambda m: store.parse_messages(m)[1])
    return out.select("event_id", F.when(F.col("value") == "no json", "no json").otherwise("cut off").alias("kind"))


@query("add_indicator_columns", f"with {views.DAY_SQL}, n as (select *, row_number() over ({_W}) as rn from candles) select {_K}, {', '.join(f'{r6(c)} as {c}' for c in ('open', 'high', 'low'))}, {r6(f'case when rn >= 5 then avg(close) over {back(4)} end')} as close, {r6('volume')} as volume, {r6(f'case when rn >= 3 then avg(volume) over {back(2)} end')} as vma_3 from n")
def _(spark, sf):
    return rounded(ind.add_indicators(views.day(spark, sf), {"vma_3": ind.vma(3), "close": ind.sma(5)}))


def running_mean() -> recurrence.Scan:
    """A user's indicator: the mean of all closes so far; the state is their number and sum."""

    def run(g, state):
        n, total = state[0] + np.arange(1, len(g["close"]) + 1), state[1] + np.cumsum(g["close"])
        return total / n, [float(n[-1]), float(total[-1])]

    return recurrence.Scan(("close",), (0.0, 0.0), run)


@query("custom_indicator", f"with {views.DAY_SQL}, n as (select *, row_number() over ({_W}) as rn from candles) select {_K}, {r6(f'max(high) over {back(9)} - min(low) over {back(9)}')} as range_10, {r6(f'avg(close) over {back(None)}')} as running from n")
def _(spark, sf):
    made = Registry()
    made.column("range_10", lambda: F.max("high").over(series.frame(9)) - F.min("low").over(series.frame(9)))
    made.scan("running", running_mean())
    return rounded(made.compute(views.day(spark, sf), ["range_10", "running"]).select(*KEYS, "range_10", "running"))


_RUNNING_SQL = f"with {views.DAY_SQL} select {_K}, {r6(f'avg(close) over {back(None)}')} as running_mean from candles"


@query("custom_indicator_sql", _RUNNING_SQL)
def _(spark, sf):
    """The same scan as a table function, called from SQL."""
    table_function(spark, "running_mean", running_mean())
    return rounded(spark.sql("select symbol, `interval`, ts, running_mean from running_mean(table({candles}))", candles=views.day(spark, sf)))


@query("custom_indicator_live", _RUNNING_SQL)
def _(spark, sf):
    """The same scan over a stream in four micro-batches."""
    out = drained(spark, _by_years(spark, sf), "custom", lambda s: live.stream_indicators(s, {"running_mean": running_mean()}), "batch", 4)
    return rounded(_stamped(out, "timestamp_ntz", "ts").select(*KEYS, "running_mean"))


_LONG = f"select {_K}, name, {r6('value')} as value, unit from (select {_K}, 'MA_5' as name, case when rn >= 5 then avg(close) over {back(4)} end as value, 'price' as unit from n union all select {_K}, 'STOCH_5', case when rn >= 5 then {_stoch('high', 'low', 'close', 5)} end, 'oscillator' from n union all select {_K}, 'XYZ', volume, 'raw' from n) where value is not null"


@query("indicators_long", f"with {views.DAY_SQL}, n as (select *, row_number() over ({_W}) as rn from candles) {_LONG}")
def _(spark, sf):
    out = ind.add_indicators(views.day(spark, sf), {"MA_5": ind.sma(5), "STOCH_5": ind.stochastic(5)}).withColumn("XYZ", F.col("volume"))
    return rounded(units.indicators_long(out, ["MA_5", "STOCH_5", "XYZ"]))


@query("indicator_unit", "select event_id, case event_id % 6 when 0 then 'price' when 1 then 'volatility' when 2 then 'percent' when 3 then 'oscillator' when 4 then 'raw' else 'price' end as unit from events")
def _(spark, sf):
    name = F.get(F.array(*[F.lit(x) for x in ("ema_9", "MACDHIST_12", "EMASLOPE_9_3", "stochrsi_14", "other", "VWAP")]), (F.col("event_id") % 6).cast("int"))
    return views.table(spark, sf, "events").select("event_id", units.indicator_unit(name).alias("unit"))


@query("custom_unit", f"with {views.DAY_SQL} select {_K}, 'SPREAD' as name, {r6('high - low')} as value, 'ticks' as unit from candles where high - low is not null union all select {_K}, 'EMA_X', {r6('close')}, 'points' from candles where close is not null union all select {_K}, 'EMASLOPE_X', {r6('open')}, 'percent' from candles where open is not null")
def _(spark, sf):
    """User-made units: a new prefix, and one that replaces a known unit; the longest prefix still wins."""
    out = views.day(spark, sf).withColumns({"SPREAD": F.col("high") - F.col("low"), "EMA_X": F.col("close"), "EMASLOPE_X": F.col("open")})
    long = units.indicators_long(out, ["SPREAD", "EMA_X", "EMASLOPE_X"])
    return rounded(long.withColumn("unit", units.indicator_unit(F.col("name"), {"spread": "ticks", "EMA": "points"})))


# --- sorts, limits, storage -----------------------------------------------------

@query("sort_series", f"with {views.DAY_SQL} {_OHLC} order by {_K}")
def _(spark, sf):
    return series.sort_series(rounded(views.day(spark, sf)))


def _ranked(order: str, test: str) -> str:
    return f"with {views.DAY_SQL}, n as (select *, row_number() over (partition by symbol, \"interval\" order by ts {order}) as rn from candles) select {_K}, {r6('close')} as close from n where {test}"


@query("latest_candles", _ranked("desc", "rn <= 60"))
def _(spark, sf):
    return rounded(series.latest_candles(views.day(spark, sf), 60).select(*KEYS, "close"))


@query("head_rows", _ranked("", "rn <= 100"))
def _(spark, sf):
    return rounded(series.head_rows(views.day(spark, sf), 100).select(*KEYS, "close"))


@query("nth_candle", _ranked("", "rn = 43"))
def _(spark, sf):
    return rounded(series.nth_candle(views.day(spark, sf), 42).select(*KEYS, "close"))


@query("latest_point", f"with {views.DAY_SQL}, n as (select *, row_number() over ({_W}) as rn from candles), v as (select *, case when rn >= 5 then avg(close) over {back(4)} end as m from n) select symbol, \"interval\", {r6('arg_max(m, ts)')} as ma_5 from v group by 1, 2")
def _(spark, sf):
    return rounded(series.latest_point(ind.sma(5)(views.day(spark, sf), "ma_5"), ["ma_5"]))


_UPSERT = f"with {views.HOURLY_SQL}, new as (select {_K}, open, high, low, close + 1 as close, volume, 1 as s from candles where extract(hour from ts) % 2 = 0 union all select {_K}, open, high, low, close + 2, volume, 2 from candles where extract(hour from ts) % 4 = 0 union all select symbol, \"interval\", ts + interval 100 day, open, high, low, close, volume, 1 from candles where extract(hour from ts) = 5), every as (select {_K}, open, high, low, close, volume, 0 as s from candles union all select * from new)"


def _updates(c: DataFrame) -> DataFrame:
    hour = F.hour("ts")
    one = c.filter(hour % 2 == 0).withColumns({"close": F.col("close") + 1, "load_seq": F.lit(1)})
    two = c.filter(hour % 4 == 0).withColumns({"close": F.col("close") + 2, "load_seq": F.lit(2)})
    more = c.filter(hour == 5).withColumns({"ts": F.col("ts") + F.expr("interval 100 day"), "load_seq": F.lit(1)})
    return one.unionByName(two).unionByName(more)


@query("upsert_candles", f"{_UPSERT} select {_K}, {r6('arg_max(close, s)')} as close from every group by {_K}")
def _(spark, sf):
    c = views.hourly(spark, sf)
    return rounded(store.upsert_candles(c, _updates(c)).select(*KEYS, "close"))


@query("merge_recent", f"{_UPSERT}, kept as (select *, row_number() over ({_W} desc) as r from candles qualify r <= 60), last as (select symbol, max(ts) as t from kept group by 1), fresh as (select {_K}, close, s from new join last using (symbol) where ts >= t), m as (select {_K}, arg_max(close, s) as close from (select {_K}, close, 0 as s from kept union all select * from fresh) group by {_K}) select {_K}, {r6('close')} as close from m qualify row_number() over ({_W} desc) <= 60")
def _(spark, sf):
    c = views.hourly(spark, sf)
    return rounded(series.merge_recent(series.latest_candles(c, 60), _updates(c), 60).select(*KEYS, "close"))


@query("load_range", f"with {views.DAY_SQL} {_OHLC} where ts >= timestamp '1996-01-01' and ts < timestamp '1996-07-01'")
def _(spark, sf):
    return rounded(store.load_range(views.day(spark, sf), "1d", "1996-01-01", "1996-06-30"))


#: Folders of the series of a stored table; the views' series grow in number with the tables.
_BUCKETS = 64


@query("read_years", f"with {views.DAY_SQL} {_OHLC} where ts >= timestamp '1996-01-01' and ts < timestamp '1996-07-01'")
def _(spark, sf):
    """Half a year of a table kept by years, its many series in buckets."""
    path = _fresh(spark, "years")
    store.write_candles(views.day(spark, sf), path, by_year=True, buckets=_BUCKETS)
    return rounded(store.read_years(spark, path, CANDLE, "1d", "1996-01-01", "1996-06-30"))


@query("series_bounds", f"with {views.DAY_SQL} select symbol, \"interval\", min(ts) as earliest, max(ts) as latest, count(*) as rows from candles group by 1, 2")
def _(spark, sf):
    return store.series_bounds(views.day(spark, sf))


@query("coverage_audit", f"with {views.DAY_SQL}, s as (select distinct 'S' || (l_suppkey % 9) as symbol from lineitem), w as (select symbol, unnest(['day', '60minute']) as \"interval\" from s) select w.*, 'no rows' as reason from w anti join candles c on c.symbol = w.symbol and c.\"interval\" = w.\"interval\"")
def _(spark, sf):
    symbols = views.table(spark, sf, "lineitem").select(F.concat(F.lit("S"), (F.col("l_suppkey") % 9).cast("string")).alias("symbol"))
    return store.coverage_audit(views.day(spark, sf), symbols, ["day", "60minute"])


@query("audit_files", f"with {views.DAY_SQL}, c as (select symbol, count(*) as n, cast(substr(symbol, 2) as bigint) as k from candles group by 1), w as (select c.*, unnest(['day', '60minute']) as \"interval\" from c) select symbol, \"interval\", case when \"interval\" = 'day' and k % 10 > 0 then n else 0 end as rows, case when \"interval\" = 'day' and k = 10 then 'empty' when \"interval\" <> 'day' or k % 10 = 0 then 'no file' when k % 10 = 1 then 'columns missing: high, volume' end as reason from w")
def _(spark, sf):
    """A stored table with all that an audit should find: series without a file, a file without a row, files without two columns."""
    path, c = _fresh(spark, "audit"), views.day(spark, sf)
    k = F.substring("symbol", 2, 20).cast("long") % 10
    save = lambda df: df.repartition("symbol").write.mode("append").partitionBy("interval", "symbol").parquet(path)
    save(c.where(k > 1))
    save(c.where(k == 1).drop("high", "volume"))
    c.drop("interval", "symbol").limit(0).coalesce(1).write.parquet(f"{path}/interval=day/symbol=S10")
    return store.audit_files(spark, path, c.select("symbol"), ["day", "60minute"]).drop("files")


@query("plan_backfill", f"""with {views.DAY_SQL}, r as (select symbol, "interval", min(ts) as s, max(ts) as e from candles group by 1, 2),
    k as (select *, unnest(case "interval" when 'day' then [1800] end) as d from r union all select symbol, '60minute', s, e, 365 from r union all select symbol, '5minute', s, e, 55 from r),
    c as (select *, unnest(range(cast(floor(date_diff('second', s, e) / (d * 86400.0 + 1)) as bigint) + 1)) as chunk from k)
    select symbol, "interval", chunk, s + to_seconds(chunk * (d * 86400 + 1)) as chunk_start, least(s + to_seconds(chunk * (d * 86400 + 1)) + to_days(d), e) as chunk_end from c""")
def _(spark, sf):
    b = store.series_bounds(views.day(spark, sf)).select("symbol", F.explode(F.array(F.lit("day"), F.lit("60minute"), F.lit("5minute"))).alias("interval"), F.col("earliest").alias("start"), F.col("latest").alias("end"))
    return store.plan_backfill(b).select("symbol", "interval", "chunk", "chunk_start", "chunk_end")


@query("resolve_instruments", "with i as (select case when s_suppkey % 2 = 0 then 'NSE' else 'BSE' end as exchange, 'S' || (s_suppkey % 50) as symbol, min(s_suppkey) as instrument_token from supplier group by 1, 2), q as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, 'NSE' as exchange, 'S' || (l_suppkey % 60) as symbol from lineitem) select q.*, instrument_token from q left join i using (exchange, symbol)")
def _(spark, sf):
    master = views.table(spark, sf, "supplier").select(F.when(F.col("s_suppkey") % 2 == 0, "NSE").otherwise("BSE").alias("exchange"), F.concat(F.lit("s"), (F.col("s_suppkey") % 50).cast("string")).alias("tradingsymbol"), F.col("s_suppkey").alias("instrument_token"))
    wanted = views.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.lit("NSE").alias("exchange"), F.concat(F.lit("S"), (F.col("l_suppkey") % 60).cast("string")).alias("symbol"))
    return store.resolve_instruments(wanted, master)


_WIDE_SQL = f"select {_K}, {r6('open')} as open, {r6('close')} as close, candle_type, candle_color, {r6('body_size')} as body_size, {r6('wick_difference_to_candle_ratio')} as wick_difference_to_candle_ratio"


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/candlemill/{name}-{uuid.uuid4().hex}"


@query("write_candles", f"with {GEOMETRY_SQL.replace(views.ROWS_SQL, views.HOURLY_SQL)} {_WIDE_SQL} from shaped")
def _(spark, sf):
    """Written by series with all geometry columns, and read again."""
    path = _fresh(spark, "candles")
    store.write_candles(views.hourly(spark, sf), path)
    back = spark.read.parquet(path).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return rounded(back.select(*KEYS, "open", "close", "candle_type", "candle_color", "body_size", "wick_difference_to_candle_ratio"))


@query("write_dataset", f"with {views.HOURLY_SQL} select {_K}, {r6('close')} as close from candles")
def _(spark, sf):
    """Half of the series first, then all: the second call writes only what is missing."""
    path, c = _fresh(spark, "dataset"), views.hourly(spark, sf).select(*KEYS, "close")
    store.write_dataset(c.filter("symbol < 'f'"), path, ["close"])
    store.write_dataset(c, path, ["close"])
    return rounded(spark.read.parquet(path).select(*KEYS, "close"))


@query("read_candles_csv", f"with {views.DAY_SQL} select {_K}, {', '.join(f'{r6(c)} as {c}' for c in ('open', 'close', 'volume'))} from candles")
def _(spark, sf):
    """Day candles written as one CSV folder a series, and read by the folders' names."""
    path, c = _fresh(spark, "csv"), views.day(spark, sf)
    named = c.select(F.concat_ws("_", "symbol", "interval", F.lit("all")).alias("series"), F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:30")).alias("timestamp"), "open", "high", "low", "close", "volume")
    named.repartition("series").write.partitionBy("series").option("header", True).csv(path)
    return rounded(store.read_candles_csv(spark, path, ["day"]).select(*KEYS, "open", "close", "volume"))


@query("validate_columns", f"with {views.DAY_SQL}, {views.HOURLY_SQL.replace('candles as', 'hours as')} select 'day' as source, count(*) as rows from candles union all select 'hourly', count(*) from hours union all select 'lineitem lacks symbol, interval, ts, open, high, low, close, volume', count(*) from lineitem")
def _(spark, sf):
    """Rows of candle tables that have all columns, and what a table that has not is told."""
    day, hourly = (require(c, CANDLE_COLUMNS) or c for c in (views.day(spark, sf), views.hourly(spark, sf)))
    lines = views.table(spark, sf, "lineitem")
    try:
        require(lines, CANDLE_COLUMNS, "lineitem")
        said = "none missing"
    except ValueError as e:
        said = str(e).replace(" columns:", "")
    count = lambda df, name: df.agg(F.lit(name).alias("source"), F.count(F.lit(1)).alias("rows"))
    return count(day, "day").unionByName(count(hourly, "hourly")).unionByName(count(lines, said))


_STREAM_SQL = f"with {views.TICKS_SQL}, candles as (select symbol, '60minute' as \"interval\", {views.bucket_sql('event_time', 60)} as ts, first(last_price order by event_time, event_id) as open, max(last_price) as high, min(last_price) as low, last(last_price order by event_time, event_id) as close, sum(trade_quantity) as volume from ticks group by 1, 2, 3) {_OHLC} where ts + interval 60 minute <= (select max(event_time) - interval 10 minute from ticks)"


@query("stream_candles", _STREAM_SQL)
def _(spark, sf):
    """Closed hourly candles of the event stream, drained to a table."""
    events = store.read_ticks(spark, f"{sf}/events.parque*", views.table(spark, sf, "events").schema)
    q = F.coalesce(F.get_json_object("props", "$.k").cast("double"), F.lit(0.0))
    ticks_ = events.select(views.symbol().alias("symbol"), F.col("ts").cast("timestamp").alias("event_time"), "event_id", F.col("value").alias("last_price"), q.alias("volume_delta"))
    path = _fresh(spark, "stream")
    run = live.stream_candles(ticks_, "60minute", "10 minutes").writeStream.format("parquet").option("checkpointLocation", f"{path}-cp").outputMode("append").trigger(availableNow=True).start(path)
    run.awaitTermination()
    return rounded(spark.read.parquet(path))


_CUT = "timestamp '1970-01-01' + to_microseconds(cast((select (max(epoch_us(ts)) + min(epoch_us(ts))) // 2 from events) as bigint))"


@query("stream_late_data", _STREAM_SQL.replace("from ticks group by", f"from ticks where event_time >= {_CUT} group by"))
def _(spark, sf):
    """Later ticks first: the earlier half of the stream's time comes late and is dropped by the watermark."""
    e = views.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    cut = e.agg(F.expr("(max(unix_micros(cast(ts as timestamp))) + min(unix_micros(cast(ts as timestamp)))) div 2")).first()[0]
    q = F.coalesce(F.get_json_object("props", "$.k").cast("double"), F.lit(0.0))
    ticks_ = e.select(views.symbol().alias("symbol"), F.col("ts").cast("timestamp").alias("event_time"), "event_id", F.col("value").alias("last_price"), q.alias("volume_delta"), (micros >= cut).alias("later"))
    path = _fresh(spark, "late")
    for later in (True, False):
        ticks_.filter(F.col("later") == later).write.mode("append").parquet(f"{path}-in")
        rows = live.stream_candles(store.read_ticks(spark, f"{path}-in", ticks_.schema), "60minute", "10 minutes")
        rows.writeStream.format("parquet").option("checkpointLocation", f"{path}-cp").outputMode("append").trigger(availableNow=True).start(path).awaitTermination()
    return rounded(spark.read.schema(rows.schema).parquet(path))


def _upserted(spark: SparkSession, sf: str, by_year: bool) -> DataFrame:
    """Hourly candles, then their updates, merged into a table bucket by bucket of series."""
    path, c = _fresh(spark, "upserts"), written(views.hourly(spark, sf), "hourly")
    for batch in (c.withColumn("load_seq", F.lit(0)), _updates(c)):
        batch = batch.select(*c.columns, "load_seq")
        batch.write.mode("append").parquet(f"{path}-in")
        live.stream_upsert(spark.readStream.schema(batch.schema).parquet(f"{path}-in"), path, f"{path}-cp", by_year=by_year, buckets=_BUCKETS).awaitTermination()
    return rounded(store.read_years(spark, path, c.schema) if by_year else spark.read.schema(c.schema).parquet(path)).select(*KEYS, "close")


@query("stream_upsert", f"{_UPSERT} select {_K}, {r6('arg_max(close, s)')} as close from every group by {_K}")
def _(spark, sf):
    """Hourly candles, then their updates, merged into a table."""
    return _upserted(spark, sf, False)


@query("stream_upsert_years", ORACLE["stream_upsert"])
def _(spark, sf):
    """The same into a table kept by years."""
    return _upserted(spark, sf, True)


# --- features, labels, windows ------------------------------------------------------

_F = features.Features(["candle_color", "wick_ratios", "log_volume_zscore", "indicators"])


_RAW = {f"rsi_{p}": rsi_sql(p) for p in (7, 14)} | {f"stochastic_{p}": stochastic_sql(p) for p in (7, 14)} | {f"stochastic_rsi_{p}": stochastic_rsi_sql(p, p) for p in (7, 14)}
_RAW |= {"macd": MACD_SQL, "atr": atr_sql(14), "adx": ADX_SQL, "log_volume_zscore": zscore_sql(5)}


def _feature_sql(column: str, fill: bool) -> str:
    """A feature column over the joined raw values."""
    if column in _HOT:
        return f"cast({_HOT[column]} as int)"
    if column not in _RAW:
        return column
    value = {"macd": _ratio_to_close("macd", -0.05), "atr": _ratio_to_close("atr", 0.0), "adx": "adx / 100", "log_volume_zscore": _Z.replace("value", "log_volume_zscore")}.get(column, f"({column} - 50.0) / 50.0")
    return f"coalesce({value}, 0.0)" if fill else f"case when {column} is not null then {value} end"


def encoded_sql(fill: bool = True) -> str:
    """Keys and all feature columns, uncut."""
    day = GEOMETRY_SQL.replace(views.ROWS_SQL, views.DAY_SQL)
    return f"with {day} select {_K}, {', '.join(f'{_feature_sql(c, fill)} as {c}' for c in _F.columns())} from {joined(_RAW, 'shaped')}"


def _cut_features(prefix: str = "") -> str:
    return ", ".join(f"{c}" if c in _HOT else f"{r6(prefix + c)} as {c}" for c in _F.columns())


@query("encode_features", f"select {_K}, {_cut_features()} from ({encoded_sql()})")
def _(spark, sf):
    return rounded(features.encode_features(views.day(spark, sf), _F).select(*KEYS, *_F.columns()))


@query("stream_features", f"select {_K}, {_cut_features()} from ({encoded_sql(fill=False)})")
def _(spark, sf):
    """The whole configured feature row of live candles, null in warm-up."""
    out = drained(spark, _by_years(spark, sf), "features", lambda c: live.stream_features(c, _F), "batch", 4)
    return rounded(_stamped(out, "timestamp_ntz", "ts"))


@query("feature_columns", f"with e as ({encoded_sql(fill=False)}) " + " union all ".join(f"select '{c}' as name, {i}::int as position, count({c}) as known from e" for i, c in enumerate(_F.columns())))
def _(spark, sf):
    """Feature columns in their order, with the rows that have a value (none in warm-up)."""
    rows = features.encode_features(views.day(spark, sf), _F, fill=False)
    places = F.create_map(*[F.lit(x) for pair in _F.positions().items() for x in pair])
    known = rows.agg(*[F.count(c).alias(c) for c in _F.columns()]).unpivot([], _F.columns(), "name", "known")
    return known.select("name", places[F.col("name")].alias("position"), "known")


@query("feature_vector", f"with {GEOMETRY_SQL} select {_K}, [{r6('upper_wick_to_candle_ratio')}, {r6('lower_wick_to_candle_ratio')}, {r6('body_to_candle_ratio')}] as features from shaped")
def _(spark, sf):
    cols = features.WICKS
    return features.feature_vector(rounded(geometry.with_geometry(views.rows(spark, sf)).select(*KEYS, *cols)), cols).select(*KEYS, "features")


@query("fixed_horizon_return", f"with {views.DAY_SQL} select {_K}, {r6(f'lead(close, 5) over ({_W}) / nullif(close, 0) - 1')} as value from candles")
def _(spark, sf):
    return rounded(labels.return_label(views.day(spark, sf), 5, "value").select(*KEYS, "value"))


#: Rows ahead that the SQL looks at by ``lead``; the few candles without a touch there look further by a join.
_NEAR = 8


def _barrier_sql(vertical: str, horizon: int = 5, tie: str = "lower", source: str = views.DAY_SQL) -> str:
    """Common tables up to ``sided``: candles with the side of the first touch within the horizon."""
    near = range(1, min(horizon, _NEAR) + 1)
    both = {"lower": -1, "upper": 1, "neutral": 0}[tie]
    end = "0" if vertical == "neutral" else "sign(case when isfinite(f) then f end)::int"
    side = lambda h, low: f"case when {h} >= top and {low} <= bottom then {both} when {low} <= bottom then -1 when {h} >= top then 1 end"
    leads = ", ".join(f"lead(high, {k}) over ({_W}) as h{k}, lead(low, {k}) over ({_W}) as l{k}" for k in near)
    first = "coalesce(" + ", ".join(side(f"h{k}", f"l{k}") for k in near) + ", null)"
    out = f"""{source}, n as materialized (select *, row_number() over ({_W}) as rn, lead(1, {horizon}) over ({_W}) as there, lead(close, {horizon}) over ({_W}) / nullif(close, 0) - 1 as f,
        close * (1 + 5.0::double / 100) as top, close * (1 - 5.0::double / 100) as bottom, {leads} from candles),
    soon as materialized (select *, {first} as s from n)"""
    if horizon <= _NEAR:
        return out + f", sided as (select * exclude (s), case when there is not null then coalesce(s, {end}) end as side from soon)"
    return out + f""",
    later as (select a.symbol, a.rn, arg_min({side("b.high", "b.low").replace("top", "a.top").replace("bottom", "a.bottom")}, b.rn) as t
        from (select symbol, rn, top, bottom from soon where s is null and there is not null) a join n b on a.symbol = b.symbol and b.rn between a.rn + {_NEAR + 1} and a.rn + {horizon} and (b.high >= a.top or b.low <= a.bottom) group by 1, 2),
    sided as (select soon.* exclude (s), case when there is not null then coalesce(s, t, {end}) end as side from soon left join later using (symbol, rn))"""


_ONE = ", ".join(f"cast(side = {v} as int) as {n}" for n, v in zip(labels.LABELS, (-1, 0, 1), strict=True))
for _name, _v, _tie in (("return", "return", "lower"), ("neutral", "neutral", "lower"), ("tie_upper", "return", "upper"), ("tie_neutral", "return", "neutral")):

    @query(f"triple_barrier_{_name}", f"with {_barrier_sql(_v, tie=_tie)} select {_K}, {_ONE} from sided")
    def _(spark, sf, v=_v, tie=_tie):
        return labels.triple_barrier(views.day(spark, sf), labels.Barriers(horizon=5, vertical=v, tie=tie)).select(*KEYS, *labels.LABELS)


for _horizon in (5, 35, 2000):

    @query(f"long_triple_barrier_{_horizon}", f"with {_barrier_sql('return', _horizon, source=views.LONG_SQL)} select {_K}, {_ONE} from sided")
    def _(spark, sf, horizon=_horizon):
        """First touches by chunks with a halo of the horizon, where one series holds nine rows in ten."""
        return longseries.triple_barrier(views.long(spark, sf), labels.Barriers(horizon=horizon), 256).select(*KEYS, *labels.LABELS)


@query("custom_labeller", f"with {views.DAY_SQL} select {_K}, cast(lead(close, 2) over ({_W}) > close as int) as label from candles")
def _(spark, sf):
    """A user's labeller by name: does the close rise within two rows?"""
    made = Registry()
    made.labeller("rises", lambda c: c.withColumn("label", (F.lead("close", 2).over(series.series()) > F.col("close")).cast("int")))
    return made.label(views.day(spark, sf), "rises").select(*KEYS, "label")


@query("drop_unlabelled", f"with {_barrier_sql('return')} select {_K}, {_ONE} from sided where side is not null")
def _(spark, sf):
    return labels.drop_unlabelled(labels.triple_barrier(views.day(spark, sf), labels.Barriers(horizon=5))).select(*KEYS, *labels.LABELS)


@query("join_features_labels", f"with {_barrier_sql('return')}, m as (select *, case when rn >= 5 then avg(close) over {back(4)} end as ma_5 from sided) select {_K}, {r6('ma_5')} as ma_5, {_ONE} from m")
def _(spark, sf):
    c = views.day(spark, sf)
    left = ind.sma(5)(c, "ma_5").select(*KEYS, "ma_5", F.lit(9).alias("label_upper"))
    return rounded(labels.join_features_labels(left, labels.triple_barrier(c, labels.Barriers(horizon=5)), labels.LABELS))


@query("labelled_dataset", f"with {_barrier_sql('return', 35)} select s.symbol, s.\"interval\", s.ts, {_cut_features('e.')}, {_ONE} from sided s join ({encoded_sql()}) e on e.symbol = s.symbol and e.ts = s.ts where side is not null")
def _(spark, sf):
    out = labels.labelled_dataset(views.day(spark, sf), _F, labels.Barriers(horizon=35))
    return rounded(out.select(*KEYS, *_F.columns(), *labels.LABELS))


@query("label_classes_hourly", f"""with {_barrier_sql("return", source=views.HOURLY_SQL)}
    select symbol, side, count(*) as n, count(case when greatest(least(open, close) - low, 0.0) > greatest(high - greatest(open, close), 0.0) then 1 end) as green from sided where side is not null group by 1, 2""")
def flagship(spark, sf):
    """Ticks to hourly candles, shape, first barrier touched, and counts by class."""
    shaped = geometry.with_geometry(views.hourly(spark, sf))
    named = ind.rsi(14)(labels.triple_barrier(shaped, labels.Barriers(horizon=5)), "rsi_14")
    side = F.col("label_upper") - F.col("label_lower")
    return labels.drop_unlabelled(named).groupBy("symbol", side.alias("side")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("candle_color") == "green").alias("green"))


_WIN = 8


def _window_rows(spark: SparkSession, sf: str) -> DataFrame:
    return labels.triple_barrier(views.day(spark, sf), labels.Barriers(horizon=5)).withColumn("ret", F.col("close") / F.col("open") - 1)


@query("clean_rows", f"with {_barrier_sql('return')} select {_K}, {r6('x')} as x from (select *, 1.0 / nullif(volume - 30, 0) as x from sided) where x is not null")
def _(spark, sf):
    x = F.when(F.col("volume") == 30, float("inf")).otherwise(F.try_divide(F.lit(1.0), F.col("volume") - 30))
    return rounded(dataset.clean_rows(views.day(spark, sf).withColumn("x", x), ["x"]).select(*KEYS, "x"))


@query("context_windows", f"with {_barrier_sql('return')}, w as (select *, list(close::float) over {back(_WIN - 1)} as xs, lead(case when side is null then null else side + 1 end) over ({_W}) as target from sided) select {_K}, {r6('list_sum(xs)::double')} as total, len(xs) as length, target::bigint as target from w where rn >= {_WIN} and target is not null")
def _(spark, sf):
    rows = _window_rows(spark, sf)
    w = dataset.context_windows(rows, ["close", "volume"], F.when(F.col("label_lower").isNotNull(), dataset.class_index(labels.LABELS)), _WIN)
    total = F.aggregate("window", F.lit(0.0), lambda a, x: a + x[0].cast("double"))
    return rounded(w.select(*KEYS, total.alias("total"), F.size("window").cast("long").alias("length"), "target"))


@query("window_target", f"with {_barrier_sql('return')} select {_K}, (side + 1)::bigint as class_index, [(side = -1)::int::float, (side = 0)::int::float, (side = 1)::int::float] as one_hot, (case when side = -1 then 0 when side = 0 then 1 else 2 end)::bigint as by_value from sided where side is not null")
def _(spark, sf):
    rows = labels.drop_unlabelled(_window_rows(spark, sf)).withColumn("side", F.col("label_upper") - F.col("label_lower"))
    return rows.select(*KEYS, dataset.class_index(labels.LABELS).alias("class_index"), dataset.one_hot_target(labels.LABELS).alias("one_hot"), dataset.label_index("side", [-1, 0, 1]).alias("by_value"))


@query("next_color_windows", f"with {GEOMETRY_SQL}, w as (select *, row_number() over ({_W}) as rn, lead(case when candle_color = 'green' then 0 else 1 end) over ({_W}) as target from shaped) select {_K}, target::bigint as target from w where rn >= 4 and target is not null")
def _(spark, sf):
    g = geometry.with_geometry(views.rows(spark, sf))
    return dataset.next_color_windows(g.withColumns(geometry.one_hot()), ["close", "volume"], 4).select(*KEYS, "target")


@query("series_report", "with n as (select cast(l_suppkey as varchar) as symbol, 'minute' as \"interval\", count(*) as rows from lineitem group by 1) select *, (case when rows < 601 then 0 else rows - 600 end)::bigint as windows, case when rows < 601 then 'fewer than 601 rows' end as reason from n")
def _(spark, sf):
    return dataset.series_report(views.rows(spark, sf), 600, 1)


_COUNTS = f"with {_barrier_sql('return')}, t as (select lead(side + 1) over ({_W}) as target, rn from sided), c as (select k as class_index, count(target) as n from range(3) r(k) left join t on target = k and rn >= {_WIN} group by 1)"


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    w = dataset.context_windows(_window_rows(spark, sf), ["close"], F.when(F.col("label_lower").isNotNull(), dataset.class_index(labels.LABELS)), _WIN)
    return dataset.label_counts(w, 3)


@query("label_counts", _COUNTS + " select * from c")
def _(spark, sf):
    return _counts(spark, sf)


@query("class_weights", _COUNTS + f" select *, {r6('case when min(n) over () > 0 then sum(n) over () / (3.0 * n) end')} as weight from c")
def _(spark, sf):
    return rounded(dataset.class_weights(_counts(spark, sf)))


@query("distinct_labels", "with d as (select distinct cast(l_suppkey as varchar) as symbol, 'minute' as \"interval\", l_returnflag as label from lineitem) select *, dense_rank() over (partition by symbol order by label) - 1 as class_index from d")
def _(spark, sf):
    rows = views.table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("symbol"), F.lit("minute").alias("interval"), F.col("l_returnflag").alias("label"))
    return dataset.distinct_labels(rows, "label")


@query("split_by_series", "with n as (select cast(l_suppkey as varchar) as symbol, count(*) as n from lineitem group by 1), p as (select *, row_number() over (order by md5(symbol || '|minute|7'), symbol) as place, count(*) over () as series from n) select symbol, case when place <= greatest(1, floor(series * 0.8::double)) then 'train' else 'validation' end as part, n from p")
def _(spark, sf):
    return dataset.split_by_series(views.rows(spark, sf), seed=7).groupBy("symbol", "part").agg(F.count(F.lit(1)).alias("n"))


@query("split_by_window", f"with {views.DAY_SQL}, p as (select {_K}, row_number() over (order by md5(symbol || '|' || \"interval\" || '|' || strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || '|7'), {_K}) as place, count(*) over () as n from candles) select {_K}, case when place <= greatest(1, floor(n * 0.2::double)) then 'validation' else 'train' end as part from p")
def _(spark, sf):
    w = views.day(spark, sf).select(*KEYS)
    return dataset.split_by_window(w, seed=7)


# --- scoring and evaluation -----------------------------------------------------------

def _predictions(spark: SparkSession, sf: str) -> DataFrame:
    d = views.table(spark, sf, "lineitem")
    i = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    p = [(i * k % 11 + 1).cast("double") for k in (3, 5, 7)]
    total = p[0] + p[1] + p[2]
    return d.select((i % 3).cast("int").alias("actual"), F.when(i % 5 == 0, (i + 1) % 3).otherwise(i % 3).cast("int").alias("predicted"), F.array(*[x / total for x in p]).alias("probs"))


_PRED = "p as (select (i % 3)::int as actual, (case when i % 5 = 0 then (i + 1) % 3 else i % 3 end)::int as predicted, (i * 3 % 11 + 1)::double as a, (i * 5 % 11 + 1)::double as b, (i * 7 % 11 + 1)::double as c from (select l_orderkey * 7 + l_linenumber as i from lineitem))"
_CONF = _PRED + ", m as (select k::int as actual, " + ", ".join(f"count(case when predicted = {i} then 1 end) as p{i}" for i in range(3)) + " from range(3) r(k) left join p on actual = k group by 1)"


@query("confusion_matrix", f"with {_CONF} select * from m")
def _(spark, sf):
    return evaluate.confusion_matrix(_predictions(spark, sf), 3)


@query("normalized_confusion", f"with {_CONF} select actual, " + ", ".join(f"{r6(f'p{i} / greatest(p0 + p1 + p2, 1)::double')} as p{i}" for i in range(3)) + " from m")
def _(spark, sf):
    return rounded(evaluate.normalized_confusion(evaluate.confusion_matrix(_predictions(spark, sf), 3), 3))


@query("classification_report", f"""with {_PRED}, k as (select k from range(3) r(k)), s as (select k, count(case when actual = k and predicted = k then 1 end)::double as tp, count(case when predicted = k then 1 end)::double as pp, count(case when actual = k then 1 end)::double as support from k, p group by 1),
    f as (select cast(k as varchar) as class, tp / greatest(pp, 1) as precision, tp / greatest(support, 1) as recall, support from s), g as (select *, 2 * precision * recall / greatest(precision + recall, 1e-12) as f1 from f), a as (select avg((actual = predicted)::int) as accuracy from p)
    select class, {r6('precision')} as precision, {r6('recall')} as recall, {r6('f1')} as f1, {r6('support')} as support, {r6('accuracy')} as accuracy
    from (select class, precision, recall, f1, support from g union all select 'macro', avg(precision), avg(recall), avg(f1), sum(support) from g), a""")
def _(spark, sf):
    return rounded(evaluate.classification_report(evaluate.confusion_matrix(_predictions(spark, sf), 3), 3))


@query("evaluation_loss", f"with {_PRED} select {r6('sum(w * -ln(q)) / sum(w)')} as loss, count(*) as n from (select case actual when 0 then 1.0 when 1 then 2.0 else 0.5 end as w, (case actual when 0 then a when 1 then b else c end) / (a + b + c) as q from p)")
def _(spark, sf):
    return rounded(evaluate.evaluation_loss(_predictions(spark, sf), [1.0, 2.0, 0.5]))


@query("regression_loss", f"with {_PRED} select {r6('avg((predicted - actual) * (predicted - actual))')} as loss, count(*) as n from p")
def _(spark, sf):
    return rounded(evaluate.regression_loss(_predictions(spark, sf)))


def mean_move(x):
    """A predictor for tests: logits from the mean move over the window."""
    import numpy as np

    move = x[:, -1, 0] / x[:, 0, 0] - 1
    return np.stack([-move, 0 * move, move], axis=1)


@query("score_windows", f"with {views.DAY_SQL}, w as (select *, row_number() over ({_W}) as rn, first_value(close::float) over {back(_WIN - 1)} as a, lead(1) over ({_W}) as t from candles), m as (select *, close::float / a - 1::float as d from w where rn >= {_WIN} and t is not null) select {_K}, (case when -d >= 0 and -d >= d then 0 when d > 0 then 2 else 1 end)::int as predicted from m")
def _(spark, sf):
    w = dataset.context_windows(views.day(spark, sf), ["close"], F.lit(1), _WIN)
    return evaluate.score_windows(w, mean_move, KEYS).select(*KEYS, "predicted")


@query("score_rows", ORACLE["score_windows"])
def _(spark, sf):
    """The same scores without windows as rows."""
    return evaluate.score_rows(views.day(spark, sf), ["close"], F.lit(1), _WIN, mean_move).select(*KEYS, "predicted")


def color_balance(x):
    """A predictor for tests: green against red candles over the window (the first two features)."""
    import numpy as np

    d = x[:, :, 0].sum(axis=1) - x[:, :, 1].sum(axis=1)
    return np.stack([-d, 0 * d, d], axis=1)


@query("score_feature_rows", f"with {GEOMETRY_SQL.replace(views.ROWS_SQL, views.DAY_SQL)}, w as (select *, row_number() over ({_W}) as rn, sum(case when candle_color = 'green' then 1 else -1 end) over {back(127)} as d, lead(1, 2) over ({_W}) as t from shaped) select {_K}, d::double as balance, (case when d <= 0 then 0 else 2 end)::int as predicted from w where rn >= 128 and t is not null")
def _(spark, sf):
    """Windows of 128 candles and all feature columns, as the reference workload has them, target two candles on."""
    rows = features.encode_features(views.day(spark, sf), _F)
    ordered = ["candle_color_green", "candle_color_red", *[c for c in _F.columns() if not c.startswith("candle_color")]]
    out = evaluate.score_rows(rows, ordered, F.lit(1), 128, color_balance, 2)
    return out.select(*KEYS, F.col("logits")[2].alias("balance"), "predicted")
