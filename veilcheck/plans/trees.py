"""A report over files: what the command line prints and the tree tool answers."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import report
from ..operators.screen import file_reports
from ..sources import files
from . import sinks


def tree_reports(read: DataFrame, kinds=(), scripts=()) -> DataFrame:
    """file_reports() of sources.files.read_files(), files that could not be read among them."""
    judged = file_reports(read.where("reason is null"), "file", "text", kinds, scripts, filename=F.col("file"))
    types = {f.name: f.dataType for f in judged.schema}
    refusal = F.array(F.struct(F.col("reason"), F.col("refusal").alias("detail"))).cast(types["refusals"])
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    refused = read.where("reason is not null").select("file", F.array().cast(types["findings"]).alias("findings"), refusal.alias("refusals"), zero.alias("n_findings"), zero.alias("n_bidi"), one.alias("n_refusals"), F.lit(True).alias("unexamined"))
    return judged.unionByName(refused)


def document(reports: DataFrame) -> dict:
    """The report as one document: schema, files in order of path, summary. It is asked for whole, so its files come to the driver."""
    summary = report.run_summary(reports).first().asDict()
    rows = sorted(sinks.json_rows(reports, "file").collect(), key=lambda r: files.path_key(r.file))
    return {"schema": summary.pop("schema"), "files": [json.loads(r.json) for r in rows], "summary": summary}


def write_document(reports: DataFrame, write: Callable[[str], object]) -> None:
    """The same document as text, piece by piece: a part of the files is on the driver at a time."""
    summary = report.run_summary(reports).first().asDict()
    write(f'{{"schema": {summary.pop("schema")}, "files": [')
    for i, row in enumerate(sinks.json_rows(reports.orderBy(F.split("file", "/")), "file").toLocalIterator()):
        write((", " if i else "") + row.json)
    write(f'], "summary": {json.dumps(summary)}}}\n')
