"""User-made indicators and labellers by name, run in the same passes as the built-in ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from candlemill.operators import indicators as ind
from candlemill.operators import recurrence
from candlemill.operators.series import KEYS

#: Rows that a table function runs its scan over at once.
ROWS_AT_ONCE = 1024


class Registry:
    """Names of column builders (over the series window), of scans or functions of a whole series, and of labellers."""

    def __init__(self) -> None:
        self.columns: dict[str, Callable[[], Column]] = {}
        self.scans: dict[str, recurrence.Scan | recurrence.Whole] = {}
        self.labellers: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def column(self, name: str, build: Callable[[], Column]) -> None:
        self.columns[name] = build

    def scan(self, name: str, run: recurrence.Scan | recurrence.Whole) -> None:
        self.scans[name] = run

    def labeller(self, name: str, label: Callable[[DataFrame], DataFrame]) -> None:
        self.labellers[name] = label

    def compute(self, candles: DataFrame, names: list[str]) -> DataFrame:
        unknown = [n for n in names if n not in self.columns and n not in self.scans]
        if unknown:
            raise KeyError(f"unknown indicators: {', '.join(unknown)}")
        windows = {n: _adder(self.columns[n]) for n in names if n in self.columns}
        return ind.add_indicators(candles, windows, {n: self.scans[n] for n in names if n in self.scans})

    def label(self, candles: DataFrame, name: str) -> DataFrame:
        return self.labellers[name](candles)


def _adder(build: Callable[[], Column]) -> ind.Add:
    return lambda df, name: df.withColumn(name, build())


def table_function(spark: SparkSession, name: str, scan: recurrence.Scan) -> None:
    """Make a scan callable from SQL: ``select * from name(table(candles))`` gives the rows with a column ``name``.

    The function asks for whole series in time order itself, and holds a bounded number of rows and the scan's state.
    The same scan runs in ``Registry.compute`` and, live, in ``streaming.live.stream_indicators``.
    """

    class Run:
        @staticmethod
        def analyze(candles: AnalyzeArgument) -> AnalyzeResult:
            schema = StructType([*candles.dataType.fields]).add(name, DoubleType())
            return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn(k) for k in KEYS], orderBy=[OrderingColumn("ts")])

        def __init__(self) -> None:
            self.rows: list[Row] = []
            self.state = list(scan.start)

        def eval(self, candles: Row) -> Iterator[tuple]:
            self.rows.append(candles)
            if len(self.rows) == ROWS_AT_ONCE:
                yield from self.flushed()

        def terminate(self) -> Iterator[tuple]:
            yield from self.flushed()

        def flushed(self) -> Iterator[tuple]:
            rows, self.rows = self.rows, []
            if rows:
                columns = {c: np.array([r[c] for r in rows], float) for c in scan.columns}
                values, self.state = scan.run(columns, self.state)
                for r, v in zip(rows, values.tolist(), strict=True):
                    yield (*r, None if v != v else v)

    spark.udtf.register(name, udtf(Run))
