"""Sends this package to the executors, once for each SparkContext, so that Arrow functions import it wherever they run."""

from __future__ import annotations

import io
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_done: set[str] = set()

#: The bytes of an Arrow batch, where a session leaves Spark's default of 64 MB: batches of whole texts would else take hundreds of MB in each worker.
_BATCH, _DEFAULT, _OURS = "spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20), str(4 << 20)
#: The rows that Spark's Parquet reader decodes at once, where a session leaves its default: it has no limit by bytes, and 4,096 texts of 100 KB would take 400 MB of an executor's heap.
_ROWS, _ROWS_DEFAULT, _ROWS_OURS = "spark.sql.parquet.columnarReaderBatchSize", "4096", "256"


def ship(spark: SparkSession) -> SparkSession:
    if spark.conf.get(_BATCH).rstrip("b") == _DEFAULT:
        spark.conf.set(_BATCH, _OURS)
    if spark.conf.get(_ROWS) == _ROWS_DEFAULT:
        spark.conf.set(_ROWS, _ROWS_OURS)
    context = spark.sparkContext
    if context.applicationId in _done:
        return spark
    top = Path(__file__).resolve().parent.parent
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*")):
            if p.suffix in (".py", ".json") and "__pycache__" not in p.parts:
                z.write(p, p.relative_to(top.parent))
    folder = tempfile.mkdtemp(prefix="veilcheck-")
    path = Path(folder, "veilcheck.zip")
    path.write_bytes(buffer.getvalue())
    context.addPyFile(str(path))
    _done.add(context.applicationId)
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir.

    Where it is unset, a local master gets a folder of its own; on a cluster
    executors would each write to a disk of theirs, so that is an error.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = f"file:{tempfile.gettempdir()}/veilcheck-tables"
    spark.conf.set("spark.checkpoint.dir", own)
    return own
