"""Functions for SQL: unicode_findings, key_spans and escape_spans as table functions; u_render, escape_ascii, is_single_script and resolve_format as functions.

A table function is SQL over a function of Arrow batches, so `LATERAL` becomes
one projection and an inline, and no Python is called row by row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udf, pandas_udf

from .options import ALIASES, options
from .shipping import ship
from .ucd import shared

FOUND = "kind string, severity string, line bigint, column bigint, offset bigint, key string, codepoints array<string>, scripts array<string>, resembles array<string>, detail string"
KEYS = "start bigint, `end` bigint, path string"
SPANS = "start bigint, `end` bigint"


def _rows(columns: str) -> str:
    return f"array<struct<{columns.replace(' string', ':string').replace(' bigint', ':bigint').replace(' array', ':array')}>>"


def _lists(found: list[list[tuple]], names: tuple[str, ...], types: tuple[pa.DataType, ...]) -> pa.Array:
    bounds = np.cumsum([0, *map(len, found)])
    flat = [x for each in found for x in each]
    columns = [pa.array([x[i] for x in flat], t) for i, t in enumerate(types)]
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(columns, names=list(names)))


def register(spark: SparkSession) -> None:
    """Registers the functions with a session; `SELECT * FROM docs, LATERAL unicode_findings(text, 'text', '', '')`."""
    tables, held = shared(ship(spark))

    @arrow_udf(_rows(FOUND))
    def findings_of(text: pa.Array, format: pa.Array, kinds: pa.Array, scripts: pa.Array) -> pa.Array:
        from veilcheck.operators.kernel import FIELDS, examine_texts, slices

        formats = [f or "text" for f in format.to_pylist()]
        asked = list(zip(kinds.to_pylist(), scripts.to_pylist(), strict=True))
        parts, order = [], []
        for key in dict.fromkeys(asked):
            own = options(held.value, *([y for y in (x or "").split(",") if y] for x in key))
            rows = np.array([a == key for a in asked])
            at = np.flatnonzero(rows)
            order.append(at)
            for lo, hi, texts in slices(text.filter(pa.array(rows)), held.value):
                bounds, columns, _ = examine_texts(texts, [formats[i] for i in at[lo:hi]], own)
                parts.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(columns, names=list(FIELDS))))
        out = pa.concat_arrays(parts)
        return out if len(order) == 1 else out.take(pa.array(np.argsort(np.concatenate(order))))

    @arrow_udf(_rows(KEYS))
    def key_spans_of(text: pa.Array, format: pa.Array) -> pa.Array:
        from veilcheck.operators.keypaths import key_spans

        found = [key_spans(t or "", f or "text") for t, f in zip(text.to_pylist(), format.to_pylist(), strict=True)]
        return _lists(found, ("start", "end", "path"), (pa.int64(), pa.int64(), pa.string()))

    @arrow_udf(_rows(SPANS))
    def escape_spans_of(text: pa.Array) -> pa.Array:
        from veilcheck.operators.keypaths import json_escapes

        return _lists([json_escapes(t or "") for t in text.to_pylist()], ("start", "end"), (pa.int64(), pa.int64()))

    @pandas_udf("boolean")
    def single(words: pd.Series) -> pd.Series:
        from veilcheck.operators.kernel import Text, is_single_script

        # words repeat: each is looked at once a batch
        codes, distinct = pd.factorize(words)
        found = np.array([*(is_single_script(Text(w, held.value).points, held.value) for w in distinct), None], object)
        return pd.Series(found[codes])

    for name, f in (("findings_of", findings_of), ("key_spans_of", key_spans_of), ("escape_spans_of", escape_spans_of), ("is_single_script", single)):
        spark.udf.register(name, f)
    known = ", ".join(f"'{k}', '{v}'" for k, v in ALIASES.items())
    base = r"regexp_extract(file, '[^/\\\\]*$', 0)"
    for what in (
        f"unicode_findings(text STRING, format STRING, kinds STRING, scripts STRING) RETURNS TABLE({FOUND}) RETURN SELECT inline(findings_of(text, format, kinds, scripts))",
        f"key_spans(text STRING, format STRING) RETURNS TABLE({KEYS}) RETURN SELECT inline(key_spans_of(text, format))",
        f"escape_spans(text STRING) RETURNS TABLE({SPANS}) RETURN SELECT inline(escape_spans_of(text))",
        "u_render(cp INT) RETURNS STRING RETURN 'U+' || lpad(hex(cp), greatest(4, length(hex(cp))), '0')",
        r"escape_ascii(s STRING) RETURNS STRING RETURN CASE WHEN s RLIKE '[^\\x00-\\x7F]' THEN array_join(transform(split(s, ''), c -> if(ascii(c) < 128, c, regexp_replace(hex(encode(c, 'UTF-16BE')), '(....)', '\\\\u$1'))), '') ELSE s END",
        f"format_named(name STRING) RETURNS STRING RETURN nullif(coalesce(element_at(map({known}), regexp_replace(lower(trim(name)), '^[.]+', '')), 'text'), 'text')",
        f"resolve_format(format STRING, file STRING) RETURNS STRING RETURN coalesce(format_named(format), format_named({base}), format_named(if(contains({base}, '.'), regexp_extract({base}, '[^.]*$', 0), NULL)), 'text')",
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {what}")
