"""What several training-data operators share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkcorr.shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a session on one machine (tests, a laptop) has none, a folder of its own is set once; a cluster must name one.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not re.fullmatch(r"local(\[[^]]*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    context.setCheckpointDir("/tmp/checkpoints")
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone, and its files with the cluster's folder
        pass


def stash(df: DataFrame, by: str | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    Unlike a cache, the rows outlive the executors that made them. ``by``, a column of few values, has a folder for each.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stash-{uuid.uuid4().hex}"
    if by:
        writers = "spark.sql.maxConcurrentOutputFileWriters"
        before = spark.conf.get(writers)
        spark.conf.set(writers, "4")  # else rows are sorted by the column first
        try:
            df.write.partitionBy(by).parquet(path)
        finally:
            spark.conf.set(writers, before)
    else:
        df.write.parquet(path)
    atexit.register(_delete, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash = path
    return out


def unstash(*stashes: DataFrame, part: str = "") -> None:
    """Delete tables of ``stash``, or a ``part`` of them, that no later job reads."""
    for df in stashes:
        _delete(df.sparkSession, f"{df._stash}/{part}".rstrip("/"))


def release(spark: SparkSession) -> None:
    """Let go of shuffle files that no plan refers to any more. Spark deletes them when the driver
    collects its garbage, which on a large heap may be long after a stage that needs the disk. The
    cleaner works beside us, and what the first round frees may hold more."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def rest() -> None:
    """Give back what this process has freed, which its allocators keep. For the end of a task: the worker waits for the
    next one beside an executor's heap that only grows, and numpy's and Arrow's leavings of each stage would add up."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not the GNU library
        pass


def map_batches(df: DataFrame, fn: Callable[..., Iterable[list]], schema: str | StructType, step: int = 1000) -> DataFrame:
    """Apply ``fn`` to slices of at most ``step`` rows of each Arrow batch.

    ``fn`` gets one Python list a column and returns one sequence an output column. Slicing
    bounds what Python holds at once, whatever the size of Spark's batches.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(df.sparkSession)
    out = to_arrow_schema(schema if isinstance(schema, StructType) else StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                columns = fn(*(c.to_pylist() for c in part.columns))
                arrays = [pa.array(c, type=f.type) for c, f in zip(columns, out)]
                yield pa.RecordBatch.from_arrays(arrays, schema=out)
                del part, columns, arrays
        rest()

    return df.mapInArrow(run, schema)


def hash_sample(df: DataFrame, key: str, max_rows: int) -> DataFrame:
    """About ``max_rows`` rows at most, chosen by the hash of ``key``: the same ones each time.

    All rows if there are no more than that. Rows without a key are none of them, as they have one hash. Only
    for fitting a model; the bound is the caller's documented parameter.
    """
    df = df.where(F.col(key).isNotNull())
    total = df.count()
    if total <= max_rows:
        return df
    buckets = 1 << 30
    keep = int(buckets * max_rows / total)
    return df.where(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)) < keep)
