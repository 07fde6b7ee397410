"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(path)
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    target = system.makeQualified(target)
    system.deleteOnExit(target)
    path = target.toString()
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a folder that scratch() named, once nothing reads it any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Size of Arrow batches to Python where the session sets none: the JVM holds twice a task's batch outside its heap while it grows.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs within sends Python batches of BATCH's size, not of 10,000 rows of any length, unless the session has a size of its own."""
    key, size = BATCH
    own = spark.conf.get(key, None)
    if own is None:
        spark.conf.set(key, size)
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(key)


def cut(df: DataFrame, label: str) -> DataFrame:
    """df as a table written to the shared folder: its lineage ends there, so a lost executor costs a read and no recomputation."""
    spark = df.sparkSession
    path = scratch(spark, label)
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", chars: int = 300_000, rows: int = 512) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cuts Arrow batches into pieces of bounded rows and text, with the texts as strings (null: empty). One longer text is a piece of its own."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, rows)
            texts, size, n = [], 0, 0
            for t in part.column(part.schema.get_field_index(text)):
                t = t.as_py() or ""
                if n and size + len(t) > chars:
                    break
                texts.append(t)
                size += len(t)
                n += 1
            yield part.slice(0, n), texts
            at += n


@cache
def _trim() -> Callable[[int], int] | None:
    """malloc_trim of the C library, if it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Gives freed memory back to the system, which Arrow's pool and malloc keep otherwise."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, with memory released before and after each partition: workers are used again, so that what one operation has
    freed would stay with them, up to its peak, while the next takes its own."""

    @wraps(run)
    def tidied(batches):
        release()
        yield from run(batches)
        release()

    return tidied


def released(run: Callable) -> Callable:
    """run for the driver, with memory released when it has returned: what it took for a while would stay with the driver else."""

    @wraps(run)
    def done(*args, **named):
        try:
            return run(*args, **named)
        finally:
            release()

    return done


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in order; by sorting, which beats a hash table where most values are distinct."""
    x = np.sort(x)
    return x[np.concatenate((np.ones(min(1, len(x)), bool), x[1:] != x[:-1]))]


def ranked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and for each of x the place of its value among them."""
    order = np.argsort(x, kind="stable")
    own = x[order]
    new = np.concatenate((np.ones(min(1, len(x)), bool), own[1:] != own[:-1]))
    own, place = own[new], np.cumsum(new)
    place -= 1
    at = np.empty(len(x), np.int64)
    at[order] = place
    return own, at


#: Directories of a table that tasks look up by their partition's number, at most.
PLACES = 4096


@dataclass(frozen=True)
class Places:
    """A table whose rows lie where the task of their partition finds them: `each` partitions share a directory, in order."""

    folder: str
    each: int

    def read(self, part: int, columns: list[str]) -> pa.Table | None:
        system, root = pafs.FileSystem.from_uri(self.folder)
        files = [f.path for f in system.get_file_info(pafs.FileSelector(f"{root}/place={part // self.each}", allow_not_found=True)) if f.path.endswith(".parquet")]
        found = [pq.read_table(f, columns=columns, filters=[("part", "==", part)], filesystem=system, partitioning=None) for f in files]
        return pa.concat_tables(found) if found else None


def write_by_partition(df: DataFrame, label: str, parts: int, gathered: bool = True) -> Places:
    """df (part, ...) in the shared folder, for tasks that know the number of their partition, one of `parts`. Unless gathered, each task
    of df writes its own files to every directory: no shuffle, but as many files as tasks times directories."""
    spark = df.sparkSession
    path, each = scratch(spark, label), -(-parts // PLACES) or 1
    placed = df.withColumn("place", F.expr(f"part div {each}"))
    placed = (placed.repartition("place") if gathered else placed).sortWithinPartitions("place", "part")
    with small_batches(spark):
        placed.write.option("compression", "zstd").partitionBy("place").parquet(path)
    return Places(path, each)


def from_files(docs: DataFrame, label: str) -> DataFrame:
    """docs, written to the shared folder first unless its rows come straight from files, so that each reading has the same partitions."""
    return cut(docs, label) if "Exchange" in docs._jdf.queryExecution().executedPlan().toString() else docs
