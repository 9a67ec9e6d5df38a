"""Bytes to text, or a refusal by name."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship

SNIFF = 8192
UNKNOWN, BINARY = "encoding_unknown", "binary_or_undecodable"
# Byte order marks, the longest first.
MARKS = (("UTF-32BE", "0000FEFF"), ("UTF-32LE", "FFFE0000"), ("UTF-16BE", "FEFF"), ("UTF-16LE", "FFFE"))


def mark_of(content: Column) -> Column:
    """The encoding that a byte order mark other than UTF-8's names."""
    head = F.hex(F.substring(content, 1, 4))
    out = None
    for name, mark in MARKS:
        fits = head.startswith(mark)
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out


def first_nul(content: Column) -> Column:
    """The index of the first NUL in the bytes that are sniffed; null without."""
    pairs = F.regexp_replace(F.hex(F.substring(content, 1, SNIFF)), "(..)", "$1 ")
    at = F.instr(pairs, "00 ")
    return F.when(at > 0, ((at - 1) / 3).cast("long"))


def first_invalid(frame: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """(id, at): the first byte of each content that is not UTF-8. For the few rows that fail the test in the JVM."""
    ship(frame.sparkSession)
    kind = frame.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            at = []
            for x in batch.column(1):
                try:
                    x.as_py().decode()
                    at.append(None)
                except UnicodeDecodeError as e:
                    at.append(e.start)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.int64())], names=["id", "at"])

    return frame.select(F.col(id_col).alias("id"), F.col(content_col).alias("content")).mapInArrow(run, f"id {kind}, at long").withColumnRenamed("id", id_col)


def decoded(files: DataFrame, content_col: str = "content") -> DataFrame:
    """files with `text`, or `reason` and `refusal` where there is none: a mark of another encoding, a NUL near the start, or bytes that are not UTF-8. A UTF-8 mark stays in the text."""
    content = F.col(content_col)
    mark, nul = mark_of(content), first_nul(content)
    bad = ~F.is_valid_utf8(content.cast("string"))
    reason = F.when(mark.isNotNull(), UNKNOWN).when(nul.isNotNull() | bad, BINARY)
    said = F.when(mark.isNotNull(), F.concat(F.lit("starts with a byte order mark of "), mark)).when(nul.isNotNull(), F.concat(F.lit("a NUL at byte "), nul.cast("string"))).when(bad, "not UTF-8")
    out = files.withColumn("reason", reason).withColumn("refusal", said)
    return out.withColumn("text", F.when(F.col("reason").isNull(), content.cast("string")))


def editor_text(content: Column) -> Column:
    """The editor's rule: a NUL anywhere, or bytes that are not UTF-8, and it is no text (null)."""
    nul = F.instr(F.regexp_replace(F.hex(content), "(..)", "$1 "), "00 ") > 0
    return F.when(~nul & F.is_valid_utf8(content.cast("string")), content.cast("string"))
