"""Candle tables kept by years: what is read, and what is rewritten."""

import datetime as dt

from pyspark.sql import functions as F

from candlemill.schemas import CANDLE, CANDLE_COLUMNS
from candlemill.sources import store
from candlemill.streaming import live


def rows():
    day = lambda s, i: (s, "day", dt.datetime(2019, 1, 1, 9, 15) + dt.timedelta(days=i), 1.0, 2.0, 0.5, float(i), 1.0)
    return [day(s, i) for s in ("A", "B&C", "7") for i in range(0, 1500, 3)]


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.rglob("*.parquet") if "_merged" not in str(p)}


def scanned(df):
    """Files that the scan of a query read, by its own metrics."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()))


def test_a_range_reads_its_years_alone(spark, tmp_path):
    df = spark.createDataFrame(rows(), CANDLE)
    store.write_candles(df, str(tmp_path / "t"), by_year=True)
    assert len(files(tmp_path / "t")) == 3 * 5
    half = store.read_years(spark, str(tmp_path / "t"), CANDLE, "1d", "2021-01-01", "2021-06-30")
    assert scanned(half) == 3
    plan = half._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(ts" in plan and "PartitionFilters" in plan
    want = df.where("ts >= timestamp'2021-01-01' and ts < timestamp'2021-07-01'")
    assert sorted(map(tuple, half.collect())) == sorted(map(tuple, want.select(CANDLE_COLUMNS).collect()))
    assert store.read_years(spark, str(tmp_path / "t"), CANDLE).count() == df.count()
    assert scanned(half.where("symbol = '7'")) == 1
    assert scanned(store.read_years(spark, str(tmp_path / "t"), CANDLE)) == 15


def test_one_candle_rewrites_one_file(spark, tmp_path):
    schema = CANDLE + ", load_seq long"
    put = lambda part: spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: live.stream_upsert(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "t"), str(tmp_path / "cp"), by_year=True).awaitTermination()
    put([(*r, 0) for r in rows()])
    run()
    before = files(tmp_path / "t")
    put([("B&C", "day", dt.datetime(2020, 5, 5, 9, 15), 5.0, 6.0, 4.0, 5.5, 9.0, 1)])
    run()
    after = files(tmp_path / "t")
    changed = {f for f in after if before.get(f) != after[f]}
    assert len(changed) == 1 and "year=2020" in changed.pop() and len(after) == len(before)
    got = store.read_years(spark, str(tmp_path / "t"), CANDLE)
    assert got.count() == len(rows()) + (("B&C", dt.datetime(2020, 5, 5, 9, 15)) not in {(r[0], r[2]) for r in rows()})
    assert got.where("close = 5.5 and volume = 9").count() == 1 and got.where(F.col("symbol") == "7").count() == 500


def test_audit_of_files(spark, tmp_path):
    """Every reason, symbols that look like numbers or hold signs, and a table kept by years."""
    df = spark.createDataFrame(rows(), CANDLE)
    at = str(tmp_path / "t")
    store.write_candles(df, at, by_year=True)
    part = df.where("symbol = '7'").drop("symbol", "interval")
    part.drop("close").coalesce(1).write.parquet(f"{at}/interval=day/symbol=007/year=2019")
    part.limit(0).coalesce(1).write.parquet(f"{at}/interval=day/symbol=E/year=2019")
    wanted = spark.createDataFrame([(s,) for s in ("A", "B&C", "7", "007", "E", "F", "A")], "symbol string")
    got = {(r.symbol, r.interval): (r.files, r.rows, r.reason) for r in store.audit_files(spark, at, wanted, ["day", "week"]).collect()}
    whole = (5, 500, None)
    assert got == {
        ("A", "day"): whole, ("B&C", "day"): whole, ("7", "day"): whole, ("007", "day"): (1, 500, "columns missing: close"), ("E", "day"): (1, 0, "empty"), ("F", "day"): (0, 0, "no file"),
        **{(s, "week"): (0, 0, "no file") for s in ("A", "B&C", "7", "007", "E", "F")},
    }


def test_many_series_share_buckets(spark, tmp_path):
    """Files are as many as buckets and years, not as series; a range reads its year, one new candle rewrites one bucket's year."""
    at, day = str(tmp_path / "t"), lambda s, i: (f"S{s}", "day", dt.datetime(2019, 1, 1, 9, 15) + dt.timedelta(days=i), 1.0, 2.0, 0.5, float(i), 1.0)
    made = [day(s, i) for s in range(120) for i in (0, 100, 400, 500, 800)]
    df = spark.createDataFrame(made, CANDLE)
    store.write_candles(df, at, by_year=True, buckets=4)
    assert len(files(tmp_path / "t")) == 4 * 3
    half = store.read_years(spark, at, CANDLE, "1d", "2020-01-01", "2020-06-30")
    assert scanned(half) == 4 and half.columns == CANDLE_COLUMNS
    assert sorted(map(tuple, half.collect())) == sorted(r for r in made if dt.datetime(2020, 1, 1) <= r[2] < dt.datetime(2020, 7, 1))
    schema = CANDLE + ", load_seq long"
    put = lambda part: spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for by_year, table in ((True, "u"), (False, "v")):
        run = lambda: live.stream_upsert(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / table), str(tmp_path / f"cp-{table}"), by_year=by_year, buckets=4).awaitTermination()  # noqa: E731, B023
        if by_year:
            put([(*r, 0) for r in made])
        else:
            put([("S8", "day", dt.datetime(2020, 5, 5, 9, 15), 5.0, 6.0, 4.0, 6.5, 9.0, 2)])
        run()
        before = files(tmp_path / table)
        assert len(before) == (4 * 3 if by_year else 4)
        put([("S7", "day", dt.datetime(2020, 5, 5, 9, 15), 5.0, 6.0, 4.0, 5.5, 9.0, 3)])
        run()
        after = files(tmp_path / table)
        changed = [f for f in after if before.get(f) != after[f]]
        assert len(changed) == 1 and len(after) == len(before)
        got = store.read_years(spark, str(tmp_path / table), CANDLE)
        assert got.where("close = 5.5").count() == 1
        new = {("S7", dt.datetime(2020, 5, 5, 9, 15))} | (set() if by_year else {("S8", dt.datetime(2020, 5, 5, 9, 15))})
        assert got.count() == len({(r[0], r[2]) for r in made} | new)
