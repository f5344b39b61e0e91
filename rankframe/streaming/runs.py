"""Runs that can be repeated: waves whose failures are tried again, and one writer at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def run_wave(todo: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, key: str) -> None:
    """Work on what ``out`` does not hold yet.  Items for which ``work`` returns no row stay open, so the
    next run tries them again; ``out`` must be a table, if an empty one."""
    done = todo.sparkSession.read.parquet(out).select(key).distinct()
    work(todo.join(done, key, "left_anti")).write.mode("append").parquet(out)


@contextmanager
def single_writer(spark: SparkSession, folder: str) -> Iterator[None]:
    """Hold the folder's lock file; fail if another writer holds it.  The file system creates it atomically."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/_writer.lock")
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.createNewFile(path):
        raise RuntimeError(f"another writer holds {folder}")
    try:
        yield
    finally:
        system.delete(path, False)
