"""What the operators share: Python tasks, tables in the shared folder, size-checked broadcasts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])

#: On a worker: what empties each module's caches, and the module that ran last.
RELEASE: list[Callable[[], None]] = []
LAST: list[str] = [""]


def entered(module: str) -> None:
    """A worker outlives its task: what another module has cached goes before this one fills its own caches."""
    if LAST[0] != module:
        import gc

        for release in RELEASE:
            release()
        gc.collect()
        trim()
        LAST[0] = module


def trim() -> None:
    """Memory that is free goes back to the system: a worker lives on, idle, while JVM stages run. (Arrow's pool; glibc's heap.)"""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    heap = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if heap:
        heap(0)


def task(target: str, *args) -> Callable[[Iterator], Iterator]:
    """A mapInArrow / mapInPandas function that calls ``module:function(batches, *args)``.

    The function is imported on the worker, so module-level caches live on until another module's task comes.
    """
    root = ROOT

    def run(batches):
        import importlib
        import sys

        if root not in sys.path:
            sys.path.append(root)
        module, name = target.split(":")
        work = getattr(importlib.import_module(f"quillspark.llm.{module}"), name)
        shared = importlib.import_module("quillspark.llm._spark")
        shared.entered(module)
        try:
            yield from work(batches, *args)
        finally:
            shared.trim()

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, in local mode only (tests): /tmp/checkpoints."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        there = "file:///tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", there)
    return there.rstrip("/")


#: Folders that this process has written, so that they can be deleted when the results that read them are written.
WRITTEN: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/quillspark/{name}-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    return path


@contextmanager
def workspace(spark: SparkSession):
    """What the operators write inside the block is deleted at its end: write their results to their own place before that."""
    first = len(WRITTEN)
    try:
        yield
    finally:
        for path in WRITTEN[first:]:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        del WRITTEN[first:]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: its lineage ends there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """The name, or the name with underscores behind it where df has such a column: a helper column never meets one of the input's."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def broadcast_if_small(df: DataFrame, rows: int, most: int = 500_000) -> DataFrame:
    """Hint a broadcast only for a counted number of (narrow) rows; beyond it Spark's shuffled joins do the work."""
    return F.broadcast(df) if rows <= most else df
