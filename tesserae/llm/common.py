"""Helpers that the corpus operators share: tables, shared folders, partition counts."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of the corpus operators: space and the ASCII controls from tab to carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, read by Spark (the path may be in a store only Spark reads)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the session names none a temporary folder is taken, in local mode only."""
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


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system layer; nothing if it is gone."""
    try:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
    except Exception:  # the session may have ended; a leftover folder does no harm
        pass


def shared_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new folder name in the shared folder; deleted when the driver ends unless ``keep``."""
    path = f"{shared_dir(spark)}/tesserae-{name}-{uuid.uuid4().hex}"
    if not keep:
        atexit.register(drop_path, spark, path)
    return path


_SCRATCH: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside, but for those to keep, are dropped at the end."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            drop_path(spark, path)


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, survives lost executors.

    The table goes when the ``scratch`` around ends; without one, or with ``keep``, when the
    driver ends."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    if _SCRATCH and not keep:
        _SCRATCH[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_parts(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(text: str | Column = "text") -> Column:
    """The text column with null as the empty string."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def tokenizer_file(name: str) -> str:
    """Where the public tokenizer files are installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def hash_sample(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """At most ``rows`` rows, the first by a hash of the keys.  Where there are more, tasks let
    through about a quarter more than that altogether, so that what meets in one place is small
    however many tasks there are."""
    span = 1 << 30
    at = F.pmod(F.xxhash64(*keys), F.lit(span))
    n = df.count()
    near = df if n <= rows else df.where(at < -(-5 * rows * span // (4 * n)))
    return near.orderBy(at, *keys).limit(rows)


def tidied(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A batch function that gives freed memory back to the system when its task ends.

    Python workers live on between tasks and stages; what they keep is lost to their executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return run
