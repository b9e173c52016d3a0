"""Session helpers: a shared folder for cut lineage, and Python workers that can import this package."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


#: Bytes of rows that Spark hands to a Python worker at once.
BATCH = 1 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on Spark hands the session's rows to Python by BATCH bytes, or by fewer where fewer are set, in place of by 10,000 rows or 64 MB.

    Whole texts by the 10,000 make buffers of tens of MB outside the heap, two at a time while they grow, and what the system's allocator leaves unused of them stays with the executor. Results
    don't depend on it. It isn't undone, as a returned table is read later.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > BATCH:
        spark.conf.set(name, str(BATCH))


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files and local rows that df reads, as Spark knows them without reading; a table whose size isn't known counts as none."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 60)


#: Bytes of input for a partition of what is made of it, where that is dealt by other keys.
SHARE = 16 << 20


def partitions_for(df: DataFrame) -> int:
    """The session's number of shuffle partitions, or more where the input is large: what a task sorts then doesn't grow with the input."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(df) // SHARE))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one where that is unset and Spark runs in one process (tests)."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quillet-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage into the shared folder; Spark's cleaner drops the files with the last reference."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished jobs: it does so when their plans are collected as garbage.

    The scheduler holds on to the last job's until another one ends, so a job of one row comes first.
    """
    spark.range(0, 1, 1, 1).collect()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work for mapInArrow, with its memory given back to the system when a task ends: workers live on for later tasks, while other stages need the memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        give_back()

    return run


def give_back() -> None:
    """Return freed memory of Arrow and of the C library (where it is glibc) to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


class Stored:
    """A table written to the shared folder. `df` reads it; `drop()` deletes it once nothing reads it any more."""

    def __init__(self, df: DataFrame, name: str = "t"):
        spark = df.sparkSession
        self.path = f"{shared_dir(spark)}/quillet-{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        release(spark)
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self.df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package where it lies outside their path (same path on all machines)."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)
