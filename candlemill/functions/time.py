"""Intervals, market time and candle buckets as column expressions.

Wall-clock times of the market (Asia/Kolkata, no daylight saving) are ``timestamp_ntz``;
instants are ``timestamp``. Intraday buckets count from the 09:15 opening.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKET_ZONE = "Asia/Kolkata"
OPEN_MINUTE = 9 * 60 + 15

# Interval names, their minutes, and aliases.
MINUTES = {"minute": 1, "3minute": 3, "5minute": 5, "10minute": 10, "15minute": 15, "30minute": 30, "60minute": 60, "day": 1440, "week": 10080}
ALIASES = {
    "1m": "minute", "1min": "minute", "1minute": "minute", "3m": "3minute", "3min": "3minute", "5m": "5minute", "5min": "5minute",
    "10m": "10minute", "10min": "10minute", "15m": "15minute", "15min": "15minute", "30m": "30minute", "30min": "30minute",
    "60m": "60minute", "60min": "60minute", "1h": "60minute", "1d": "day", "1w": "week",
}
#: Second candles have a bucket but no minutes.
SECONDS = {"1s": 1, "1second": 1}


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def canonical_interval(name: str) -> str:
    """``normalize_interval`` of a known name."""
    plain = name.strip().lower()
    return ALIASES.get(plain, plain)


def normalize_interval(name: Column) -> Column:
    """Canonical interval name; unknown names pass through trimmed and lower-cased."""
    plain = F.lower(F.trim(name))
    return F.coalesce(F.element_at(literal_map(ALIASES), plain), plain)


def interval_minutes(name: Column, strict: bool = False) -> Column:
    """Minutes of a candle; null for unknown intervals, or an error if ``strict``."""
    minutes = F.element_at(literal_map(MINUTES), normalize_interval(name))
    if strict:
        return F.coalesce(minutes, F.raise_error(F.concat(F.lit("unsupported interval: "), name)).cast("int"))
    return minutes


def to_market_time(instant: Column) -> Column:
    """Market wall clock of an instant, whatever the session's zone."""
    return F.convert_timezone(F.current_timezone(), F.lit(MARKET_ZONE), instant.cast("timestamp_ntz"))


def _day(wall: Column) -> Column:
    return F.to_date(wall).cast("timestamp_ntz")


def _plus_minutes(start: Column, minutes: Column) -> Column:
    return start + F.make_dt_interval(F.lit(0), F.lit(0), minutes.cast("int"), F.lit(0))


def candle_bucket(wall: Column, interval: Column) -> Column:
    """Start of the candle a wall-clock time falls in; null for unknown intervals."""
    name, minutes = normalize_interval(interval), interval_minutes(interval)
    seconds = F.hour(wall) * 3600 + F.minute(wall) * 60 + F.second(wall)
    slot = F.floor((seconds - OPEN_MINUTE * 60) / (minutes * 60)).cast("int")
    whole = F.floor(seconds).cast("int")
    opening = F.lit(OPEN_MINUTE)
    monday = F.next_day(F.date_sub(F.to_date(wall), 7), "Mon").cast("timestamp_ntz")
    return (
        F.when(name == "day", _plus_minutes(_day(wall), opening))
        .when(name == "week", _plus_minutes(monday, opening))
        .when(name.isin(list(SECONDS)), _day(wall) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), whole))
        .when(minutes.isNotNull(), _plus_minutes(_day(wall), opening + slot * minutes))
    )


def is_same_candle(a: Column, b: Column, interval: Column) -> Column:
    return candle_bucket(a, interval) == candle_bucket(b, interval)


def parse_bound(text: Column, is_end: bool = False) -> Column:
    """A user's date or time as market wall clock; a date alone is its start, or its last microsecond."""
    t = F.trim(text)
    day = F.try_to_date(t, "yyyy-MM-dd").cast("timestamp_ntz")
    if is_end:
        day = day + F.expr("interval 1 day") - F.expr("interval 1 microsecond")
    zoned = t.rlike(r"(Z|[+-]\d\d:?\d\d)$")
    instant = F.try_to_timestamp(F.regexp_replace(t, "Z$", "+00:00"))
    return F.when(F.length(t) == 10, day).when(zoned, to_market_time(instant)).otherwise(t.try_cast("timestamp_ntz"))
