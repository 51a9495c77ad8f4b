"""What the operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeflow.operators.common import cut, shared_folder

__all__ = ["WORD", "Tables", "cut", "forget", "release", "table", "within"]

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders of tables of this process, with what it takes to delete them.
_ROOTS: list[tuple] = []


def forget() -> None:
    """Delete all tables of this process; results that haven't been read or written yet are lost. Runs when the process ends."""
    while _ROOTS:
        jvm, conf, root = _ROOTS.pop()
        with contextlib.suppress(Exception):  # the JVM may have ended before
            path = jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(conf).delete(path, True)


atexit.register(forget)


class Tables:
    """Intermediate tables in the shared folder.

    ``put`` writes a frame as Parquet and reads it back, which cuts its lineage, lets later steps read
    only the columns that they need, and packs small files into few tasks. ``drop`` deletes those
    that nothing reads any more; the last, which a result reads, go with forget().
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
        _ROOTS.append((spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), self.root))
        self.kept: list[tuple[DataFrame, str]] = []
        self.written = 0

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.written}"
        self.written += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.kept.append((out, path))
        return out

    def drop(self, *frames: DataFrame | None) -> None:
        spark = self.spark.sparkContext
        for _, path in [x for x in self.kept if any(x[0] is y for y in frames)]:
            there = spark._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
        self.kept = [x for x in self.kept if not any(x[0] is y for y in frames)]


def within(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is.

    ``df`` should be cheap to count: a checkpoint or a small aggregate.
    """
    return F.broadcast(df) if df.count() <= rows else df


def release() -> None:
    """Give back the memory that a Python worker's finished batches leave in Arrow's pool and in the C heap.

    Workers outlive their tasks, and the next stage's tasks share the executor with them.
    """
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)
