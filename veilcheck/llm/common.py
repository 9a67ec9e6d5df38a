"""What the operators of this subpackage share: rows' keys, tables between steps, settings."""

from __future__ import annotations

import atexit
import ctypes
import sys
import uuid
from collections.abc import Callable
from contextvars import ContextVar

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import scratch_dir

WORD = "[^\\x20\\x09-\\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def row_key(id_col: str, text_col: str) -> Column:
    """A key of a row's id and text: equal rows share it, and get equal results."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k, id, body): the row's key, its id as it is, and its text as UTF-8 bytes (null: empty)."""
    return df.select(row_key(id_col, text_col).alias("k"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"))


#: Paths of the tables that settled() wrote within a finished() call.
_within: ContextVar[list[str] | None] = ContextVar("within", default=None)
#: Tables that are still there, with the JVM and the Hadoop settings that reach them.
_there: dict[str, tuple] = {}


def settled(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: later jobs read it instead of making it anew, whatever executor is lost.

    The reader is held to the schema that was written, so an empty table works.
    A table stays until the finished() it belongs to ends, or the driver's process.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _there[path] = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    if (within := _within.get()) is not None:
        within.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def finished(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """make()'s frame, settled; the tables settled on the way to it are deleted, as nothing else reads them."""
    steps: list[str] = []
    token = _within.set(steps)
    try:
        df = make()
    finally:
        _within.reset(token)
    out = settled(df, name)
    forget(steps)
    return out


def forget(paths: list[str]) -> None:
    """Deletes settled tables. One that can't be deleted, as when its session has ended, is left: that costs room and no rows."""
    for path in paths:
        jvm, settings = _there.pop(path)
        try:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(settings).delete(at, True)
        except (Py4JError, OSError):
            continue


atexit.register(lambda: forget(list(_there)))


def lean(run):
    """A mapInArrow function that gives what it has freed back to the system when it ends.

    Workers are used again and again; without this each keeps the most that any
    task has ever held, and an executor pays for all of them at once.
    """

    def task(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
                if trim is not None:
                    trim(0)

    return task


def type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()
