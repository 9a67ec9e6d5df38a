"""screen(): documents to findings and refusals.

A text of ASCII alone has no finding of any kind, so those are told apart in
the JVM and never reach Python; the rest go to the kernel in Arrow batches.
Every document is judged by itself: no shuffle, and the same on a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.options import Options, options
from ..functions.shipping import ship
from ..functions.ucd import shared
from .formats import format_column
from .kernel import FIELDS, examine_texts, slices

FINDING = "kind string, severity string, line long, column long, offset long, key string, codepoints array<string>, scripts array<string>, resembles array<string>, detail string"
REFUSAL = "reason string, detail string"
CONTEXT = "intentional_script_context"
_REFUSAL = pa.struct([("reason", pa.string()), ("detail", pa.string())])


def examined(docs: DataFrame, id_col: str, text_col: str, asked: Options, format: Column | None, every: bool = False) -> DataFrame:
    """(id, findings, refusals) of each document whose text is not ASCII alone; with `every`, of the others too, whose texts stay behind."""
    _, tables = shared(ship(docs.sparkSession))
    kind = docs.schema[id_col].dataType.simpleString()
    odd = F.col(text_col).rlike("[^\\x00-\\x7F]")
    text = F.when(odd, F.col(text_col)) if every else F.col(text_col)
    rows = (docs if every else docs.where(odd)).select(F.col(id_col).alias("id"), text.alias("text"), (F.lit("text") if format is None else format).alias("format"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in slices(batch.column(1), tables.value):
                bounds, columns, refused = examine_texts(texts, batch.column(2)[lo:hi].to_pylist(), asked)
                findings = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(columns, names=list(FIELDS)))
                why = pa.array([[{"reason": CONTEXT, "detail": refused[d]}] if d in refused else [] for d in range(hi - lo)], pa.list_(_REFUSAL))
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], findings, why], names=["id", "findings", "refusals"])

    return rows.mapInArrow(run, f"id {kind}, findings array<struct<{_fields(FINDING)}>>, refusals array<struct<{_fields(REFUSAL)}>>")


def _fields(columns: str) -> str:
    return ", ".join(":".join(c.rsplit(" ", 1)) for c in columns.split(", "))


def _asked(docs: DataFrame, kinds, scripts) -> Options:
    return options(shared(docs.sparkSession)[0], kinds, scripts)


def screen(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds=(), scripts=(), format: str | None = None, filename: Column | None = None) -> DataFrame:
    """Findings of every text, one row each: (id, seq, kind, severity, line, column, offset, key, codepoints, scripts, resembles, detail).

    seq numbers a document's findings from 0, by offset and then rank of kind.
    kinds keeps some kinds only; scripts are those a document may be written in;
    format names the reader of keys, else it follows from `filename`.
    """
    out = examined(docs, id_col, text_col, _asked(docs, kinds, scripts), format_column(format, filename))
    return out.select("id", F.posexplode("findings").alias("seq", "f")).select(F.col("id").alias(id_col), "seq", "f.*")


def refusals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds=(), scripts=()) -> DataFrame:
    """(id, reason, detail) of texts that some check could not judge."""
    out = examined(docs, id_col, text_col, _asked(docs, kinds, scripts), None)
    return out.select("id", F.explode("refusals").alias("r")).select(F.col("id").alias(id_col), "r.*")


def file_reports(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds=(), scripts=(), format: str | None = None, filename: Column | None = None) -> DataFrame:
    """A row for each document, clean ones too: (id, findings, refusals, n_findings, n_bidi, n_refusals, unexamined).

    One scan, and no shuffle: of a clean ASCII document only the id leaves the JVM.
    """
    both = examined(docs, id_col, text_col, _asked(docs, kinds, scripts), format_column(format, filename), every=True)
    return both.select(
        F.col("id").alias(id_col), "findings", "refusals",
        F.size("findings").cast("long").alias("n_findings"),
        F.size(F.filter("findings", lambda f: f["kind"] == "bidi-control")).cast("long").alias("n_bidi"),
        F.size("refusals").cast("long").alias("n_refusals"),
        F.exists("refusals", lambda r: r["reason"] != CONTEXT).alias("unexamined"),
    )
