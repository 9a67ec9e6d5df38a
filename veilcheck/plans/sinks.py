"""Findings as text: lines, Markdown, JSON reports and reply envelopes. What leaves here is ASCII."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import escape_ascii
from ..operators import report
from ..operators.report import SCHEMA


def human_line(file: Column) -> Column:
    """file:line:col  [severity] kind U+... (resembles ...)  at key  detail, over a finding's columns."""
    resembles = F.when(F.size("resembles") > 0, F.concat(F.lit(" (resembles "), F.array_join("resembles", " "), F.lit(")"))).otherwise(F.lit(""))
    key = F.when(F.col("key").isNotNull(), F.concat(F.lit("  at "), escape_ascii(F.col("key")))).otherwise(F.lit(""))
    place = F.concat_ws(":", escape_ascii(file), F.col("line").cast("string"), F.col("column").cast("string"))
    return F.concat(place, F.lit("  ["), F.col("severity"), F.lit("] "), F.col("kind"), F.lit(" "), F.array_join("codepoints", " "), resembles, key, F.lit("  "), F.col("detail"))


def refusal_line(file: Column) -> Column:
    return F.concat(escape_ascii(file), F.lit(": "), escape_ascii(F.col("detail")))


def plural(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, f" {one}").otherwise(f" {many}"))


def summary_line(summary: DataFrame) -> DataFrame:
    """The last line of a run, over run_summary()."""
    refused = F.when(F.col("refusals") == 0, "").otherwise(F.format_string(", %d refused (%d not read at all)", "refusals", "unexamined"))
    return summary.select(F.concat(plural(F.col("findings"), "finding", "findings"), F.lit(" in "), plural(F.col("files"), "file", "files"), refused).alias("line"))


def finding_json(f: Column) -> Column:
    """A finding with empty lists left out, fields in order."""
    some = lambda c: F.when(F.size(f[c]) > 0, f[c])
    fields = [f[c].alias(c) for c in ("kind", "severity", "line", "column", "offset", "key", "codepoints")]
    return F.struct(*fields, some("scripts").alias("scripts"), some("resembles").alias("resembles"), f["detail"].alias("detail"))


def json_rows(reports: DataFrame, file_col: str) -> DataFrame:
    """(file, json): each document's report as one ASCII line."""
    row = F.struct(
        F.col(file_col).cast("string").alias("file"),
        F.transform("findings", finding_json).alias("findings"),
        F.col("refusals"),
        F.struct(F.col("n_findings").alias("findings"), F.col("n_bidi").alias("bidi"), F.col("n_refusals").alias("refusals")).alias("summary"),
    )
    return reports.select(file_col, escape_ascii(F.to_json(row)).alias("json"))


def write_json_report(reports: DataFrame, summary: DataFrame, path: str, file_col: str) -> None:
    """A folder of one report: files/ with a line for each document, written by every task, and summary/ with one line."""
    json_rows(reports, file_col).select("json").write.text(f"{path}/files")
    summary.select(escape_ascii(F.to_json(F.struct(F.lit(SCHEMA).alias("schema"), F.struct("files", "findings", "bidi", "refusals", "unexamined").alias("summary"))))).write.text(f"{path}/summary")


def code(text: Column) -> Column:
    """Text within Markdown's backquotes."""
    out = F.replace(escape_ascii(text), F.lit("\\"), F.lit("\\\\"))
    return F.concat(F.lit("`"), F.replace(F.replace(out, F.lit("`"), F.lit("'")), F.lit("\n"), F.lit(" ")), F.lit("`"))


def markdown_section(reports: DataFrame, file_col: str, positions: bool = True) -> DataFrame:
    """(file, section): a heading and an item for each finding and refusal."""

    def item(f: Column) -> Column:
        place = F.concat(F.lit(" at "), f["line"].cast("string"), F.lit(":"), f["column"].cast("string")) if positions else F.lit("")
        key = F.when(f["key"].isNotNull(), F.concat(F.lit(" in "), code(f["key"]))).otherwise(F.lit(""))
        return F.concat(F.lit("- **"), f["severity"], F.lit("** "), f["kind"], F.lit(" "), F.array_join(f["codepoints"], " "), place, key, F.lit(": "), f["detail"])

    refused = F.transform("refusals", lambda r: F.concat(F.lit("- refused: "), r["reason"], F.lit(": "), r["detail"]))
    head = F.array(F.concat(F.lit("## "), code(F.col(file_col).cast("string"))), F.lit(""))
    return reports.where("n_findings > 0 or n_refusals > 0").select(file_col, F.array_join(F.concat(head, F.transform("findings", item), refused), "\n").alias("section"))


def markdown_header(files: DataFrame) -> DataFrame:
    """(header,): the head of a report over file_reports(), with its totals."""
    said = F.format_string("%d findings in %d files; %d files not judged in full.", "findings", "files", "refused")
    nothing = F.when((F.col("findings") == 0) & (F.col("refused") == 0), F.array(F.lit(""), F.lit("Nothing was found. That clears no text of what the tables do not know."))).otherwise(F.array().cast("array<string>"))
    lines = F.concat(F.array(F.lit("# Screening report"), F.lit(""), said, F.lit(""), F.lit("> Characters are written as code points and never as themselves.")), nothing)
    return report.header_totals(files).select(F.array_join(lines, "\n").alias("header"))


def sorted_finding(f: Column) -> Column:
    """A finding with empty lists left out, fields by name."""
    some = lambda c: F.when(F.size(f[c]) > 0, f[c])
    return F.struct(*(some(c).alias(c) if c in ("resembles", "scripts") else f[c].alias(c) for c in ("codepoints", "column", "detail", "key", "kind", "line", "offset", "resembles", "scripts", "severity")))


def envelope(reports: DataFrame, id_col: str, tool: str, most: int) -> DataFrame:
    """(id, reply): a reply for each document with at most `most` findings, ASCII, keys in order. ok: no diagnostic is an error; a refusal is a warning."""
    warnings = F.transform("refusals", lambda r: F.struct(r["reason"].alias("code"), r["detail"].alias("message"), F.lit("warning").alias("severity")))
    held = reports.select(id_col, "findings", "n_findings", "refusals", warnings.alias("diagnostics"))
    reply = F.struct(
        F.struct(F.transform(F.slice("findings", 1, most), sorted_finding).alias("findings"), F.transform("refusals", lambda r: F.struct(r["detail"].alias("detail"), r["reason"].alias("reason"))).alias("refusals")).alias("data"),
        F.col("diagnostics"),
        F.struct(F.least(F.col("n_findings"), F.lit(most)).alias("count"), F.lit(tool).alias("tool"), (F.col("n_findings") > most).alias("truncated")).alias("meta"),
        (~F.exists("diagnostics", lambda d: d["severity"] == "error")).alias("ok"),
    )
    return held.select(id_col, escape_ascii(F.to_json(reply)).alias("reply"))


def problems(findings: DataFrame, *keep: str) -> DataFrame:
    """Findings as an editor's markers: from 0, one character wide."""
    start = F.col("column") - 1
    return findings.select(*keep, (F.col("line") - 1).alias("line"), start.alias("start"), (start + 1).alias("end"), F.lit("warning").alias("level"), F.concat_ws(": ", "kind", "detail").alias("message"))
