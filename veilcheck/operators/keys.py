"""Key paths of whole columns of structured texts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .formats import format_column
from .keypaths import key_spans


def key_paths(docs: DataFrame, id_col: str, text_col: str, format: str | None = None, filename: Column | None = None) -> DataFrame:
    """(id, start, end, path): the byte span and path of each value of a structured text."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), format_column(format, filename).alias("format"))

    def run(batches):
        for batch in batches:
            row, start, end, path = [], [], [], []
            for i, (text, name) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                for a, b, p in key_spans(text, name):
                    row.append(i)
                    start.append(a)
                    end.append(b)
                    path.append(p)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(path, pa.string())], names=["id", "start", "end", "path"])

    return rows.mapInArrow(run, f"id {kind}, start long, end long, path string").withColumnRenamed("id", id_col)


def keys_at(findings: DataFrame, spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """findings with the path of the span that holds each offset, null outside.

    A document's spans come in order and apart, so the one that may hold an
    offset is the last to begin before it: one window over both, and no pairs
    of findings and spans. Each id has one text.
    """
    none = F.lit(None)
    held = F.struct(*(F.col(f"`{c}`") for c in findings.columns))
    kinds = {f.name: f.dataType for f in spans.schema}
    found = findings.select(F.col(id_col).alias("id"), F.col("offset").alias("at"), F.lit(1).alias("side"), held.alias("finding"), none.cast("long").alias("stop"), none.cast(kinds["path"]).alias("path"))
    begun = spans.select(F.col(id_col).alias("id"), F.col("start").alias("at"), F.lit(0).alias("side"), none.cast(found.schema["finding"].dataType).alias("finding"), F.col("end").alias("stop"), "path")
    so_far = W.partitionBy("id").orderBy("at", "side").rowsBetween(W.unboundedPreceding, W.currentRow)
    span = F.last(F.when(F.col("side") == 0, F.struct("stop", "path")), ignorenulls=True).over(so_far)
    both = found.unionByName(begun).withColumn("span", span).where("side = 1")
    return both.select("finding.*", F.when(F.col("at") < F.col("span.stop"), F.col("span.path")).alias("path"))
