"""Documents with hazards planted by a rule, as the given tables hold none. The rule is one SQL expression that Spark and DuckDB read alike."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


def planting(id_col: str, text: str) -> str:
    """An expression over an id and a text: one of fourteen plantings, or the text itself."""
    cases = {
        0: f"replace({text}, '. ', '.\u202e ')",
        1: f"replace({text}, ', ', ',\u200b ')",
        2: f"replace({text}, '. ', '.\u00a0')",
        3: f"replace({text}, ' a', ' \u0430')",
        4: f"replace({text}, 'f', '\uff46')",
        5: f"replace(replace({text}, '\u00e9', 'e\u0301'), 'o.', 'o\u0302.')",
        6: f"replace({text}, '.', '.\ue000')",
        7: f"'\ufeff' || {text}",
        8: f"replace({text}, ' i', '\ufeff i')",
        9: f"translate({text}, 'aeou', '\u0430\u0435\u043e\u0443')",
        10: f"replace({text}, '.', '.\u0378')",
        11: f"replace({text}, 'er', 'e\u00adr')",
        12: f"replace({text}, ' i', ' \U0001d41a')",
        13: f"replace({text}, ', ', ',\u3000\u2066')",
    }
    whens = " ".join(f"WHEN {k} THEN {v}" for k, v in cases.items())
    return f"CASE {id_col} % 16 {whens} ELSE {text} END"


def planted(spark: SparkSession, sf_dir: str, table: str = "documents", id_col: str = "doc_id", text_col: str = "text", more: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return rows.selectExpr(id_col, *more, f"{planting(id_col, text_col)} AS text")


def planted_sql(table: str = "documents", id_col: str = "doc_id", text_col: str = "text", more: tuple[str, ...] = ("lang", "source")) -> str:
    return f"SELECT {', '.join((id_col, *more))}, {planting(id_col, text_col)} AS text FROM {table}"


def _call(number: int, name: str, **arguments) -> str:
    return json.dumps({"jsonrpc": "2.0", "id": number, "method": "tools/call", "params": {"name": name, "arguments": arguments}})


#: Request lines, among them some that are none and some with several faults.
REQUESTS = (
    "{", "[]", '{"jsonrpc": "1.0", "id": 1, "method": "ping"}', '{"jsonrpc": "2.0", "id": 2, "method": "none"}', '{"jsonrpc": "2.0", "id": 3, "method": "ping"}', '{"jsonrpc": "2.0", "method": "ping"}', "  ",
    _call(4, "other"), _call(5, "screen_text", maxResults=0), _call(6, "screen_text", content="x", maxResults=0, kinds=["no"]), _call(7, "screen_text", content="x", kinds=["no"]),
    _call(8, "screen_text", content="\ud800"), _call(9, "screen_text", content="x"),
)
