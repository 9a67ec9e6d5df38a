"""Command line: python -m veilcheck.cli [options] PATH...

One JSON document on stdout where it is no terminal, a summary on stderr.
Exit codes: 0 clean, 1 findings, 2 the question was malformed, or --strict and
something was refused.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.options import check_gate, parse_kind, parse_script
from .functions.ucd import tables
from .operators import report
from .plans import sinks
from .plans.trees import document, tree_reports, write_document
from .sources import files


@dataclass
class Arguments:
    inputs: list[str] = field(default_factory=list)
    kinds: list[str] = field(default_factory=list)
    scripts: list[str] = field(default_factory=list)
    fail_on: str = "any"
    strict: bool = False
    stdin: bool = False
    hidden: bool = False
    respect_ignore: bool = True


def parse(args: list[str]) -> Arguments:
    """Arguments, or ValueError: a flag that is not known, an empty value, nothing named, or a gate that the filter decides."""
    out, rest = Arguments(), iter(args)

    def values(flag: str) -> list[str]:
        found = [v.strip() for v in next(rest, "").split(",") if v.strip()]
        if not found:
            raise ValueError(f"{flag} needs a value")
        return found

    for arg in rest:
        if arg in ("--strict", "--stdin", "--hidden"):
            setattr(out, arg[2:], True)
        elif arg == "--no-ignore":
            out.respect_ignore = False
        elif arg == "--kind":
            out.kinds += map(parse_kind, values(arg))
        elif arg == "--script":
            out.scripts += values(arg)
        elif arg == "--fail-on":
            out.fail_on = ",".join(values(arg))
        elif arg.startswith("-"):
            raise ValueError(f"{arg!a} is not an option")
        else:
            out.inputs.append(arg)
    if out.stdin and out.inputs:
        raise ValueError("reading from stdin takes no paths")
    if not out.stdin and not out.inputs:
        raise ValueError("name a file or a folder")
    check_gate(out.fail_on, tuple(out.kinds))
    return out


def judged(spark: SparkSession, asked: Arguments, content: bytes = b"") -> DataFrame:
    """tree_reports() of what is asked for, cached."""
    scripts = [parse_script(s, tables(spark)) for s in asked.scripts]
    if asked.stdin:
        read = files.stdin(spark, content)
    else:
        read = files.read_files(spark, files.collect(asked.inputs, files.Walk(asked.hidden, asked.respect_ignore), spark))
    return tree_reports(read, asked.kinds, scripts).cache()


def lines(reports: DataFrame) -> Iterator[str]:
    """What people are told: refusals, findings in order, the sum, and what to do about undeclared scripts."""
    refused = reports.select("file", F.explode("refusals").alias("r")).select("file", "r.detail").orderBy(F.split("file", "/"))
    found = reports.select("file", F.posexplode("findings").alias("seq", "f")).select("file", "seq", "f.*").orderBy(F.split("file", "/"), "seq")
    for rows, line in ((refused, sinks.refusal_line), (found, sinks.human_line)):
        for row in rows.select(line(F.col("file")).alias("line")).toLocalIterator():
            yield row.line
    yield sinks.summary_line(report.run_summary(reports)).first().line
    if reports.where(F.exists("refusals", lambda r: r["reason"] == "intentional_script_context")).head(1):
        yield "name the expected script with --script to have those files judged too"


def exit_code(reports: DataFrame, asked: Arguments) -> int:
    return report.run_summary(reports).select(report.exit_code(asked.fail_on, asked.strict)).first()[0]


def scan(spark: SparkSession, asked: Arguments, content: bytes = b"") -> tuple[dict, list[str], int]:
    """(report as one document, lines for people, exit code)."""
    reports = judged(spark, asked, content)
    out = document(reports), list(lines(reports)), exit_code(reports, asked)
    reports.unpersist()
    return out


def main(args: list[str] | None = None) -> int:
    try:
        asked = parse(sys.argv[1:] if args is None else args)
        spark = SparkSession.builder.getOrCreate()
        reports = judged(spark, asked, sys.stdin.buffer.read() if asked.stdin else b"")
    except (ValueError, FileNotFoundError) as e:
        print(str(e).encode("ascii", "backslashreplace").decode(), file=sys.stderr)
        return 2
    if not sys.stdout.isatty():
        write_document(reports, sys.stdout.write)
    for line in lines(reports):
        print(line, file=sys.stderr)
    return exit_code(reports, asked)


if __name__ == "__main__":
    sys.exit(main())
