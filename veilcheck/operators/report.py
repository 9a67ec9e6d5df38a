"""Roll-ups, caps and gates over findings, as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCHEMA = 1


def by(findings: DataFrame, *keys: str) -> DataFrame:
    """(keys..., n): how many findings; partial counts before the shuffle."""
    return findings.groupBy(*keys).agg(F.count("*").alias("n"))


def rolled_up(findings: DataFrame, *keys: str) -> DataFrame:
    """Counts of each level of the keys, from all together to each combination."""
    return findings.rollup(*keys).agg(F.count("*").alias("n"))


def run_summary(files: DataFrame) -> DataFrame:
    """One row: schema, files, findings, bidi, refusals, unexamined, of file_reports()."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return files.agg(F.lit(SCHEMA).alias("schema"), F.count("*").alias("files"), total("n_findings").alias("findings"), total("n_bidi").alias("bidi"), total("n_refusals").alias("refusals"), F.count_if("unexamined").alias("unexamined"))


def exit_code(fail_on: str = "any", strict: bool = False) -> Column:
    """Over a run summary: 2 if strict and something was refused, 1 if what is counted was found, else 0."""
    counted = F.col("bidi") if fail_on == "bidi" else F.col("findings")
    return F.when(F.lit(strict) & (F.col("refusals") > 0), 2).when(counted > 0, 1).otherwise(0)


def capped(files: DataFrame, most: int, id_col: str = "doc_id") -> DataFrame:
    """The first `most` findings of each document of file_reports(), a row each, with the document's count and whether some were left out. No shuffle."""
    first = files.where("n_findings > 0").select(id_col, F.col("n_findings").alias("n_found"), F.posexplode(F.slice("findings", 1, most)).alias("seq", "f"))
    return first.select(id_col, "seq", "f.*", "n_found", (F.col("n_found") > most).alias("truncated"))


def capped_over_files(files: DataFrame, most: int, id_col: str = "doc_id") -> DataFrame:
    """The first `most` findings of file_reports() in order of documents, the crossing one cut.

    The `most` least ids of documents with findings hold them all; of each no
    more than `most` are kept. So the one ordered window sees that many rows,
    and texts are examined once.
    """
    first = files.where("n_findings > 0").select(id_col, "n_findings", F.slice("findings", 1, most).alias("findings")).orderBy(id_col).limit(most)
    before = F.coalesce(F.sum("n_findings").over(W.orderBy(id_col).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    held = first.withColumn("before", before).where(F.col("before") < most)
    each = held.select(id_col, "before", F.posexplode("findings").alias("seq", "f"))
    return each.select(id_col, "seq", "f.*", (F.col("before") + F.col("seq") + 1).alias("place")).where(F.col("place") <= most)


def header_totals(files: DataFrame) -> DataFrame:
    """One row over file_reports(): findings, files, and files with a refusal."""
    return files.agg(F.coalesce(F.sum("n_findings"), F.lit(0)).alias("findings"), F.count("*").alias("files"), F.count_if(F.col("n_refusals") > 0).alias("refused"))


STATES = ("read", "too-large", "not-text", "unreadable")


def scan_counts(files: DataFrame, ignored: int = 0, limit_reached: bool = False) -> DataFrame:
    """One row of counters over sources.files.read_for_editor(): read, too_large, not_text, unreadable; and what the listing says: ignored, limit_reached."""
    counts = (F.count_if(F.col("state") == s).alias(s.replace("-", "_")) for s in STATES)
    return files.agg(*counts).select("*", F.lit(ignored).cast("long").alias("ignored"), F.lit(limit_reached).alias("limit_reached"))
