"""The same questions in DataFrame functions alone, for what they can express.

Save for surveyed(), no Python runs on the executors: a regular expression cuts a text behind each
hazard, so the rows that follow are findings and not characters, and running
windows within a document give positions. For a few documents of millions of
hazards, or on a stream, screen() is the way.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.expressions import code_point, u_render, utf16_units
from ..functions.shipping import ship
from ..functions.ucd import BIDI, INVISIBLE, SEVERITY, SPACES, hazard_class, shared, unknown
from .kernel import slices, surveys

KINDS = ("bidi-control", "invisible", "unusual-whitespace", "unassigned-or-private-use")


def kind_of(ch: Column, spans) -> Column:
    """The kind of a hazardous character, in order of precedence; spans are the ranges of the last."""
    cp = code_point(ch)
    return F.when(cp.isin(*BIDI), "bidi-control").when(cp.isin(*INVISIBLE), "invisible").when(cp.isin(*SPACES), "unusual-whitespace").when(ch.rlike(hazard_class(KINDS[3], spans=spans)), KINDS[3])


def severity_of(kind: Column) -> Column:
    return reduce(lambda e, k: e.when(kind == k, SEVERITY[k]), KINDS[1:], F.when(kind == KINDS[0], SEVERITY[KINDS[0]]))


def hazards(docs: DataFrame, *keep: str, text_col: str = "text", kinds=KINDS) -> DataFrame:
    """(keep..., cp, kind, severity): a row for each hazardous character, a leading byte order mark aside. No shuffle."""
    spans = unknown(docs.sparkSession)
    sought = hazard_class(*kinds, spans=spans)
    text = F.when(F.col(text_col).startswith("\ufeff"), F.substring(F.col(text_col), 2, 2147483647)).otherwise(F.col(text_col))
    chars = docs.where(F.col(text_col).rlike(sought)).select(*keep, F.explode(F.regexp_extract_all(text, F.lit(f"({sought})"), 1)).alias("ch"))
    named = chars.select(*keep, code_point(F.col("ch")).alias("cp"), kind_of(F.col("ch"), spans).alias("kind"))
    return named.withColumn("severity", severity_of(F.col("kind")))


def located(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds=KINDS, spans=None) -> DataFrame:
    """(id, line, column, offset, codepoint, kind, severity) of each hazard: 1-based line and UTF-16 column, byte offset. Windows go by the id and the row, so ids may repeat. spans: ranges of the last kind, all by default."""
    text = F.col(text_col)
    spans = unknown(docs.sparkSession) if spans is None else spans
    sought = hazard_class(*kinds, spans=spans)
    pieces = docs.where(text.rlike(sought)).select(F.col(id_col).alias("id"), text.alias("text"), F.monotonically_increasing_id().alias("row")).select("id", "row", F.posexplode(F.split("text", f"(?<={sought})")).alias("pos", "piece"))
    before = W.partitionBy("id", "row").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy("id", "row").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    piece = F.col("piece")
    last = F.substring(piece, -1, 1)
    head = F.substring(piece, F.lit(1), F.length(piece) - 1)
    rows = pieces.select("id", "row", "pos", last.alias("ch"), F.octet_length(piece).alias("bytes"), utf16_units(piece).alias("units"), (F.length(piece) - F.length(F.replace(piece, F.lit("\n"), F.lit("")))).alias("feeds"), F.octet_length(head).alias("head_bytes"), utf16_units(head).alias("head_units"), utf16_units(F.substring_index(piece, "\n", -1)).alias("tail_units"))
    start = F.coalesce(F.sum("units").over(before), F.lit(0))
    rows = rows.withColumn("at", start).withColumn("line_at", F.when(F.col("feeds") > 0, F.col("at") + F.col("units") - F.col("tail_units")))
    rows = rows.select("id", "ch", (F.sum("feeds").over(upto) + 1).alias("line"), (F.col("at") + F.col("head_units") - F.coalesce(F.max("line_at").over(upto), F.lit(0)) + 1).alias("column"), (F.coalesce(F.sum("bytes").over(before), F.lit(0)) + F.col("head_bytes")).alias("offset"))
    cp = code_point(F.col("ch"))
    found = rows.withColumn("kind", kind_of(F.col("ch"), spans)).where("kind is not null").where(~((F.col("offset") == 0) & (cp == 0xFEFF)))
    return found.select(F.col("id").alias(id_col), F.col("line").cast("long"), F.col("column").cast("long"), F.col("offset").cast("long"), u_render(cp).alias("codepoint"), "kind", severity_of(F.col("kind")).alias("severity"))


def surveyed(docs: DataFrame, *keep: str, text_col: str = "text", scripts=()) -> DataFrame:
    """(keep..., script, letters, n): letters in all and of each script but Latin and the values that are no scripts, by the kernel's survey; scripts keeps only those, if any are given."""
    _, tables = shared(ship(docs.sparkSession))
    rows = docs.where(F.col(text_col).rlike("[^\\x00-\\u024F]")).select(*keep, F.col(text_col).alias("surveyed_text"))
    only = set(scripts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tables.value
        wanted = np.array([not only or s in only for s in t.scripts])
        names = pa.array(t.scripts)
        for batch in batches:
            for lo, _, texts in slices(batch.column(len(keep)), t):
                letters, at, script, n = surveys(texts)
                some = wanted[script]
                at, script, n = at[some], script[some], n[some]
                own = [batch.column(k).take(pa.array(at + lo)) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(letters[at]), names.take(pa.array(script)), pa.array(n)], names=[*keep, "letters", "script", "n"])

    more = StructType().add("letters", "long").add("script", "string").add("n", "long")
    return rows.mapInArrow(run, StructType([*rows.schema.fields[: len(keep)], *more.fields]))


def shares(docs: DataFrame, *keep: str, declared=(), text_col: str = "text") -> DataFrame:
    """(keep..., letters, undeclared, share, scripts, refused): the whole percentage of letters in undeclared scripts."""
    found = surveyed(docs, *keep, text_col=text_col).where(~F.col("script").isin(*declared) if declared else F.lit(True))
    out = found.groupBy(*keep, "letters").agg(F.sum("n").alias("undeclared"), F.array_join(F.array_sort(F.collect_set("script")), ",").alias("scripts"))
    share = F.expr("(undeclared * 100) div greatest(letters, 1)")
    return out.withColumn("share", share).withColumn("refused", F.col("share") >= 10)
