"""Fields of trade ticks and symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_EXCHANGE = "NSE"


def parse_symbol(symbol: Column) -> tuple[Column, Column]:
    """(exchange, symbol) of ``EXCH:SYM`` or ``SYM``, trimmed and upper-cased."""
    parts = F.split(symbol, ":", 2)
    two = F.size(parts) == 2
    exchange = F.when(two, F.upper(F.trim(parts[0]))).when(symbol.isNotNull(), F.lit(DEFAULT_EXCHANGE))
    return exchange, F.upper(F.trim(F.when(two, F.get(parts, F.lit(1))).otherwise(symbol)))


def event_time() -> Column:
    return F.coalesce("timestamp", "exchange_timestamp", "last_trade_time")


def trade_quantity() -> Column:
    """The first quantity field that is neither null nor zero, else 0."""
    fields = ("last_traded_quantity", "last_quantity", "quantity")
    return F.coalesce(*[F.when(F.col(c) != 0, F.col(c)) for c in fields], F.lit(0.0))


def tick_fields(ticks: DataFrame) -> DataFrame:
    """Ticks with an event time and a price, their fields settled."""
    out = ticks.withColumns({"event_time": event_time(), "trade_quantity": trade_quantity()})
    return out.filter(F.col("event_time").isNotNull() & F.col("last_price").isNotNull())
