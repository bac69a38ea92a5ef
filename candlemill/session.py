"""Make the package importable in Spark's Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); one of our own only where it is unset and Spark is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="candlemill-")
    return _own[app]


#: Spark deletes an action's shuffle files at its end, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str, paths: list[str] | None = None) -> DataFrame:
    """Cut lineage: the rows written to the shared folder as Parquet, and read back; the shuffle files behind them go.

    The folder's path is added to ``paths``, for a caller who removes it once no plan reads it any more.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/candlemill/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(at)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    if paths is not None:
        paths.append(at)
    return spark.read.schema(df.schema).parquet(at)


#: Bytes of the Arrow batches that texts travel in; a batch holds one row at least.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes: rows alone say little about texts."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    given = spark.conf.get(key).lower().removesuffix("b")
    if not given.isdigit() or int(given) > BATCH_BYTES or int(given) <= 0:
        spark.conf.set(key, str(BATCH_BYTES))


def ship(spark: SparkSession) -> None:
    """Send the package to the workers once a session, unless PYTHONPATH has it already."""
    bound_batches(spark)
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    if str(ROOT.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    at = os.path.join(tempfile.mkdtemp(prefix="candlemill-"), "candlemill.zip")
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(ROOT.rglob("*.py")):
            z.write(p, p.relative_to(ROOT.parent))
    sc.addPyFile(at)
    # a stateful stream reads its processor on the driver first, in a worker that is given no files
    sc.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [at, sc.environment.get("PYTHONPATH")]))
