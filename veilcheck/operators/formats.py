"""Which reader of keys a document has, as a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.options import ALIASES, resolve_format


def _known(name: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
    return F.coalesce(F.element_at(table, F.regexp_replace(F.lower(F.trim(name)), "^\\.+", "")), F.lit("text"))


def format_of(format: Column, filename: Column) -> Column:
    """An explicit name, else the file's whole name, else its extension, else text."""
    base = F.regexp_extract(filename, "[^/\\\\]*$", 0)
    names = [_known(format), _known(base), _known(F.when(base.contains("."), F.regexp_extract(base, "[^.]*$", 0)))]
    return F.coalesce(*(F.when(n != "text", n) for n in names), F.lit("text"))


def format_column(format: str | None, filename: Column | None) -> Column:
    if filename is None:
        return F.lit(resolve_format(format))
    return format_of(F.lit(format).cast("string"), filename)
