"""Tables between two steps, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a temporary folder is taken in local mode only."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    have = spark.sparkContext._jsc.sc().getCheckpointDir()
    if have.isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tesserae-"))
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
    return have.get().rstrip("/")


def _drop(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may have ended already
        pass


#: Tables of the scopes that are open in this context.
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are dropped at the end: for one request, or one batch of a stream."""
    paths: list[str] = []
    token = _SCOPES.set((*_SCOPES.get(), paths))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        for path in paths:
            _drop(spark, path)


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a table and read it again; it is dropped when the ``scratch`` around ends, or without one
    when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tesserae-{name}-{uuid.uuid4().hex}"
    scopes = _SCOPES.get()
    if scopes:
        scopes[-1].append(path)
    else:
        atexit.register(_drop, spark, path)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
