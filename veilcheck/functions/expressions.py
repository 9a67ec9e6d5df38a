"""Column expressions for code points, escapes and lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def code_point(ch: Column) -> Column:
    return F.ascii(ch)


def u_render(cp: Column) -> Column:
    """U+0041: four digits at least, no padding beyond."""
    digits = F.hex(cp)
    return F.concat(F.lit("U+"), F.lpad(digits, F.greatest(F.lit(4), F.length(digits)), F.lit("0")))


def utf16_units(text: Column) -> Column:
    return F.length(text) + F.regexp_count(text, F.lit("[\\x{10000}-\\x{10FFFF}]"))


def escape_ascii(text: Column) -> Column:
    """Every UTF-16 unit beyond ASCII as a backslash, u and four upper-case digits."""
    units = F.transform(F.split(text, ""), lambda c: F.when(F.ascii(c) < 128, c).otherwise(F.regexp_replace(F.hex(F.encode(c, "UTF-16BE")), "(....)", "\\\\u$1")))
    return F.when(text.rlike("[^\\x00-\\x7F]"), F.array_join(units, "")).otherwise(text)


def line_number(text: Column, at: Column) -> Column:
    """The line of the at-th code point, from 1."""
    head = F.substring(text, F.lit(1), at - 1)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def redacted(message: Column) -> Column:
    """An error's text without home folders and secrets."""
    out = F.regexp_replace(message, "(/home/|/Users/|[A-Za-z]:\\\\Users\\\\)[^/\\\\\\s]+", "$1***")
    return F.regexp_replace(out, "(?i)((?:password|token|secret|api[_-]?key)\\s*[=:]\\s*)\\S+", "$1***")
