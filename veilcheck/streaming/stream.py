"""Screening of streams. A document is judged by itself, so a stream needs no state, no watermark and no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.screen import screen
from ..sources.stores import Hadoop


def read_stream(spark: SparkSession, path: str, schema: str | StructType, format: str = "parquet", files_each: int = 100) -> DataFrame:
    """The files of a folder, or one file, as a stream. Spark takes a path without wildcards for a folder, so the last character of a file's becomes a class of its own."""
    store = Hadoop(spark)
    if store.exists(path) and not store.is_folder(path):
        path = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.format(format).schema(schema).option("maxFilesPerTrigger", files_each).load(path)


def screen_stream(docs: DataFrame, out: str, checkpoint: str, id_col: str = "doc_id", text_col: str = "text", available_now: bool = True, **asked) -> StreamingQuery:
    """Findings of a stream of documents, appended to a parquet folder exactly once."""
    writer = screen(docs, id_col, text_col, **asked).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start(out)
