"""The registered queries of the screening engine, over whole tables and whole texts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import escape_ascii, redacted, u_render
from ..functions.options import check_gate, language_format, max_results, parse_kind, parse_script, typed
from ..functions.shipping import scratch_dir
from ..functions.sqlfuncs import register
from ..functions.ucd import KINDS, PRIVATE, tables
from ..operators import native, report
from ..operators.formats import format_of
from ..operators.keys import key_paths, keys_at
from ..operators.screen import file_reports, refusals, screen
from ..sources import files
from ..sources.decode import decoded, first_invalid
from ..sources.ignore import ignored_column
from ..streaming.stream import read_stream, screen_stream
from . import sinks
from .planted import REQUESTS, planted, planting
from .requests import TOOL, answers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _hazards(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return native.hazards(planted(spark, sf_dir), *keep)


@query
def hazard_kind_counts(spark, sf_dir):
    return report.by(_hazards(spark, sf_dir), "kind", "severity")


@query
def hazard_by_codepoint(spark, sf_dir):
    found = _hazards(spark, sf_dir, "doc_id").groupBy("cp", "kind").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))
    return found.select(u_render(F.col("cp")).alias("codepoint"), "kind", "n", "docs")


@query
def hazard_severity_by_source(spark, sf_dir):
    return report.by(_hazards(spark, sf_dir, "source"), "source", "severity")


@query
def hazard_by_lang_rollup(spark, sf_dir):
    return report.rolled_up(_hazards(spark, sf_dir, "lang"), "lang", "kind")


@query
def hazard_labels_join(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = _hazards(spark, sf_dir, "doc_id").groupBy("doc_id").agg(F.count("*").alias("hazards"))
    return found.join(labels, "doc_id").groupBy("quality", "toxic").agg(F.count("*").alias("docs"), F.sum("hazards").alias("hazards"))


def _located(kind: str) -> Query:
    return lambda spark, sf_dir: native.located(planted(spark, sf_dir), kinds=(kind,), spans=PRIVATE).drop("kind", "severity")


QUERIES["bidi_findings"] = _located("bidi-control")
QUERIES["invisible_findings"] = _located("invisible")
QUERIES["whitespace_findings"] = _located("unusual-whitespace")
QUERIES["private_use_findings"] = _located("unassigned-or-private-use")


def _first(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "line", "column", "offset", F.array_join("codepoints", " ").alias("codepoint"), "kind", "severity", F.array_join("scripts", " ").alias("scripts"))


@query
def finding_positions(spark, sf_dir):
    return _first(screen(planted(spark, sf_dir), kinds=native.KINDS)).drop("scripts")


@query
def unassigned_findings(spark, sf_dir):
    return _first(screen(planted(spark, sf_dir), kinds=["unassigned"]))


@query
def kind_filter(spark, sf_dir):
    return report.by(screen(planted(spark, sf_dir), kinds=["bidi", "whitespace"]), "kind", "severity")


@query
def all_kinds(spark, sf_dir):
    return report.by(screen(planted(spark, sf_dir)), "kind", "severity")


@query
def letter_survey(spark, sf_dir):
    return native.surveyed(planted(spark, sf_dir), "doc_id")


@query
def foreign_share(spark, sf_dir):
    return native.shares(planted(spark, sf_dir), "doc_id")


@query
def scripts_except(spark, sf_dir):
    return native.shares(planted(spark, sf_dir), "doc_id", declared=("Cyrillic", "Greek")).unionByName(native.shares(planted(spark, sf_dir), "doc_id", declared=("Greek",))).select("doc_id", "scripts", "share")


@query
def script_context_refusals(spark, sf_dir):
    return refusals(planted(spark, sf_dir)).select("doc_id", "reason", F.regexp_extract("detail", "^[0-9]+", 0).cast("long").alias("share"))


@query
def refusals_with_declared(spark, sf_dir):
    rows = planted(spark, sf_dir)
    each = [refusals(rows, scripts=s).groupBy("reason").agg(F.count("*").alias("n")).select(F.lit(name).alias("declared"), "reason", "n") for name, s in (("Greek", ["Grek"]), ("Cyrillic", ["Cyrl"]))]
    return each[0].unionByName(each[1])


@query
def mixed_script_words(spark, sf_dir):
    return _first(screen(planted(spark, sf_dir), kinds=["mixed"]))


@query
def mixed_script_declared(spark, sf_dir):
    return _first(screen(planted(spark, sf_dir), kinds=["mixed", "confusable"], scripts=["Cyrillic"])).groupBy("kind", "codepoint").agg(F.count("*").alias("n"))


@query
def confusables(spark, sf_dir):
    found = screen(planted(spark, sf_dir), kinds=["confusable"])
    return found.select("doc_id", "line", "column", "offset", F.array_join("codepoints", " ").alias("codepoint"), F.array_join("resembles", " ").alias("resembles"), F.array_join("scripts", " ").alias("scripts"))


@query
def non_nfc_lines(spark, sf_dir):
    found = screen(planted(spark, sf_dir), kinds=["nfc"])
    return found.select("doc_id", "line", "offset", F.regexp_extract("detail", "in (NFD|neither NFC nor NFD)", 1).alias("form"), F.array_join("codepoints", " ").alias("codepoints"))


NAMES = "CASE doc_id % 10 WHEN 0 THEN 'conf/a.JSON' WHEN 1 THEN '.env' WHEN 2 THEN 'x.yml' WHEN 3 THEN 'd.json/Settings.INI' WHEN 4 THEN 'notes' WHEN 5 THEN 'prod.env' WHEN 6 THEN 'b.tsv' WHEN 7 THEN 'a.b/c' WHEN 8 THEN 'x.properties' ELSE 'y.md' END"
FORMATS = "CASE doc_id % 3 WHEN 0 THEN ' .JSONC ' WHEN 1 THEN 'txt' END"


@query
def resolve_format(spark, sf_dir):
    named = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", f"{NAMES} AS file", f"{FORMATS} AS format")
    return named.select("doc_id", format_of(F.col("format"), F.col("file")).alias("reader"))


def _customers(spark, sf_dir, text: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey AS doc_id", f"{text} AS text")


ENV = "'# own\n export NAME = ' || c_name || ' # note\nSEG=\"' || c_mktsegment || ' # in\"\n=none\n'"
INI = "'; own\n[buyer]\nname = ' || c_name || '\nurl: ' || c_mktsegment || '\n'"
TOML = "'top = 1\n[[ buyer ]]\n\"name\" = ' || c_name || '\n# no\n'"
CSV = "'name,,\"seg\"\n\n' || c_name || ',\"a,b\",' || c_mktsegment || '\n'"
YAML = "'items:\n  - id: ' || c_name || '\n    url: http://x\n  - ' || c_mktsegment || '\n'"


def _keys(name: str, text: str, format: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: key_paths(_customers(spark, sf_dir, text), "doc_id", "text", format)


_keys("dotenv_keys", ENV, "env")
_keys("ini_keys", INI, "ini")
_keys("toml_keys", TOML, "toml")
_keys("csv_keys", CSV, "csv")
_keys("yaml_keys", YAML, "yaml")


@query
def json_keys(spark, sf_dir):
    return key_paths(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_id", "props", "json")


TREE = "'{\"a\": [\"x\u202ey\", \"' || event_type || '\u200b\"], \"b\": {\"c\": \"\u00a0\"}}'"


@query
def key_at_offset(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", f"{TREE} AS text")
    return screen(rows, "event_id", "text", format="json").select("event_id", "offset", "kind", "key")


@query
def key_join(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", f"{TREE} AS text")
    spans = key_paths(rows, "event_id", "text", "json")
    return keys_at(native.located(rows, "event_id", "text"), spans, "event_id").select("event_id", "offset", "kind", "path")


@query
def file_summary(spark, sf_dir):
    return file_reports(planted(spark, sf_dir)).select("doc_id", "n_findings", "n_bidi", "n_refusals", "unexamined")


@query
def run_summary(spark, sf_dir):
    return report.run_summary(file_reports(planted(spark, sf_dir)))


@query
def gate_exit_codes(spark, sf_dir):
    total = report.run_summary(file_reports(planted(spark, sf_dir)))
    return total.select(*(report.exit_code(on, strict).alias(f"{on}_{'strict' if strict else 'lenient'}") for on in ("any", "bidi") for strict in (False, True)))


@query
def summary_line(spark, sf_dir):
    return sinks.summary_line(report.run_summary(file_reports(planted(spark, sf_dir))))


@query
def top_findings_capped(spark, sf_dir):
    return report.capped(file_reports(planted(spark, sf_dir), kinds=native.KINDS), 5).select("doc_id", "offset", "kind", "n_found", "truncated")


@query
def results_cap_across_files(spark, sf_dir):
    return report.capped_over_files(file_reports(planted(spark, sf_dir), kinds=native.KINDS), 1000).select("doc_id", "offset", "kind", "place")


@query
def ascii_escape(spark, sf_dir):
    return planted(spark, sf_dir).select("doc_id", escape_ascii(F.col("text")).alias("escaped"))


@query
def human_lines(spark, sf_dir):
    found = screen(planted(spark, sf_dir), kinds=["bidi"])
    return found.select("doc_id", sinks.human_line(F.concat(F.lit("dé/"), F.col("doc_id").cast("string"))).alias("line"))


@query
def problem_markers(spark, sf_dir):
    return sinks.problems(screen(planted(spark, sf_dir), kinds=["bidi", "whitespace"]), "doc_id").drop("message")


@query
def json_report(spark, sf_dir):
    return sinks.json_rows(file_reports(planted(spark, sf_dir)), "doc_id")


@query
def markdown_report(spark, sf_dir):
    return sinks.markdown_section(file_reports(planted(spark, sf_dir)), "doc_id")


@query
def reply_envelopes(spark, sf_dir):
    return sinks.envelope(file_reports(planted(spark, sf_dir)), "doc_id", "screen", 500)


BYTES = {0: "unhex('FFFE') || encode(text, 'utf-8')", 1: "unhex('EFBBBF') || encode(text, 'utf-8')", 2: "encode(text, 'utf-8') || unhex('E9')", 3: "unhex('4142C3A900') || encode(text, 'utf-8')", 4: "unhex('0000FEFF') || encode(text, 'utf-8')"}


@query
def decode_or_refuse(spark, sf_dir):
    whens = " ".join(f"WHEN {k} THEN {v}" for k, v in BYTES.items())
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", f"CASE doc_id % 6 {whens} ELSE encode(text, 'utf-8') END AS content")
    return decoded(rows).select("doc_id", "reason", "refusal", F.octet_length("text").cast("long").alias("text_bytes"))


@query
def first_invalid_bytes(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "encode(text, 'utf-8') || unhex('E9') AS content")
    return first_invalid(rows, "doc_id", "content")


def _other(name: str, table: str, id_col: str, text_col: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: report.by(screen(planted(spark, sf_dir, table, id_col, text_col, ()), id_col, "text", kinds=native.KINDS), id_col, "kind")


_other("pages_hazards", "pages", "page_id", "html")
_other("conversations_hazards", "conversations", "conv_id", "text")
_other("benchmark_hazards", "benchmark", "item_id", "text")


# ---- findings whole


@query
def findings_in_order(spark, sf_dir):
    found = screen(planted(spark, sf_dir))
    return found.select("doc_id", "seq", "kind", "offset", F.array_join("codepoints", " ").alias("codepoint"), F.array_join("scripts", " ").alias("scripts"), F.array_join("resembles", " ").alias("resembles"), "detail")


@query
def refusal_lines(spark, sf_dir):
    return refusals(planted(spark, sf_dir)).select("doc_id", sinks.refusal_line(F.concat(F.lit("d/"), F.col("doc_id").cast("string"))).alias("line"))


@query
def report_header(spark, sf_dir):
    return sinks.markdown_header(file_reports(planted(spark, sf_dir)))


@query
def header_totals(spark, sf_dir):
    return report.header_totals(file_reports(planted(spark, sf_dir)))


# ---- structured texts of many shapes

#: Sixteen customers as one JSON document, and as lines of CSV.
TREE_TEXT = "'{\"group\": \"g' || doc_id || '\", \"customers\": [' || items || ']}'"
ITEM = "'{\"id\": ' || c_custkey || ', \"tags\": [\"' || c_name || '\", \"' || c_mktsegment || '\"]}'"
LINE = "c_custkey || ',\"' || c_name || ', x\",' || c_mktsegment || '\n'"


def _groups(spark, sf_dir, item: str, between: str, text: str) -> DataFrame:
    each = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey DIV 16 AS doc_id", "c_custkey", f"{item} AS item").groupBy("doc_id").agg(F.expr(f"array_join(transform(array_sort(collect_list(struct(c_custkey, item))), x -> x.item), '{between}') AS items"))
    return each.selectExpr("doc_id", f"{text} AS text")


@query
def json_tree_keys(spark, sf_dir):
    return key_paths(_groups(spark, sf_dir, ITEM, ", ", TREE_TEXT), "doc_id", "text", "json")


@query
def csv_table_keys(spark, sf_dir):
    return key_paths(_groups(spark, sf_dir, LINE, "", "'id,name\n' || items"), "doc_id", "text", "csv")


@query
def tsv_table_keys(spark, sf_dir):
    rows = _groups(spark, sf_dir, LINE, "", "'id,name\n' || items").selectExpr("doc_id", "replace(replace(text, ',', '\t'), '\t x', ', x') AS text")
    return key_paths(rows, "doc_id", "text", "tsv")


CRLF = "'A=' || c_name || '\r\nB = ' || c_mktsegment || ' # c\r\n\r\n'"
_keys("crlf_keys", CRLF, "env")

#: A JSON string with an escape before a Cyrillic letter, which a text reads as one word with the escape's letter.
ESCAPED = "'{\"k\": \"\\\\n\u0430 and plain letters\", \"c\": \"' || c_name || '\"}'"


@query
def escaped_words(spark, sf_dir):
    rows = _customers(spark, sf_dir, ESCAPED)
    each = [report.by(screen(rows, format=f), "kind").withColumn("format", F.lit(f)) for f in ("json", "text")]
    return each[0].unionByName(each[1])


# ---- files as tables

INVENTORY = "lower(p_type) || CASE p_size % 3 WHEN 0 THEN '/out/' WHEN 1 THEN '/a/b/' ELSE '/' END || replace(p_name, ' ', '_') || p_partkey || CASE p_size % 5 WHEN 0 THEN '.log' WHEN 1 THEN '.min.js' WHEN 2 THEN '.png' ELSE '.txt' END"
RULES = "*.log\n!*9.log\nout/\n/promo/*\n# none\n**/b/large_*\n"


def _inventory(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey", f"{INVENTORY} AS path")


@query
def ignored_paths(spark, sf_dir):
    return _inventory(spark, sf_dir).select("p_partkey", ignored_column(F.col("path"), RULES).alias("ignored"))


@query
def editor_listing(spark, sf_dir):
    return files.listed(_inventory(spark, sf_dir), always=("promo/cold_*.txt",), excludes=("**/small_*",), rules=RULES).select("p_partkey", "state")


def _contents(spark, sf_dir) -> DataFrame:
    whens = " ".join(f"WHEN {k} THEN {v}" for k, v in BYTES.items())
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("CAST(doc_id AS STRING) AS file", f"CASE doc_id % 6 {whens} ELSE encode(text, 'utf-8') END AS content")
    return rows.withColumn("length", F.octet_length("content").cast("long"))


@query
def editor_states(spark, sf_dir):
    return files.editor_states(_contents(spark, sf_dir), 2000).select("file", "state", F.octet_length("text").cast("long").alias("text_bytes"))


@query
def scan_counters(spark, sf_dir):
    return report.scan_counts(files.editor_states(_contents(spark, sf_dir), 2000), ignored=3)


# ---- settings, requests, streams and SQL


@query
def option_values(spark, sf_dir):
    """What options make of what they are given, or that they refuse it."""
    held = tables(spark)
    asked = [("kind", n, parse_kind) for k in KINDS for n in (k[0], k[2])] + [("kind", "homoglyph", parse_kind)]
    asked += [("script", n, lambda x: parse_script(x, held)) for n in ("cyrl", "Han", "old-persian", "Zyyy", "Klingon", " GREEK ")]
    asked += [("results", n, max_results) for n in (None, 1, 9999, 3.0, 0, 2.5, "7", True)]
    asked += [("gate", n, lambda x: check_gate(*x)) for n in (("any", ()), ("bidi", ("bidi-control",)), ("bidi", ("invisible",)), ("all", ()))]
    asked += [("setting", n, lambda x: typed(*x)) for n in ((5, 1, 10), ("x", 7), (True, 1), ([1], ["a"]), (["b"], []))]
    asked += [("format", n, lambda x: language_format(*x)) for n in (("jsonc", "a.txt"), ("plaintext", ".env"), (None, "b.yml"), ("latex", "c"))]
    rows = []
    for what, given, read in asked:
        try:
            rows.append((what, repr(given), str(read(given))))
        except ValueError:
            rows.append((what, repr(given), "refused"))
    return spark.createDataFrame(rows, "what string, given string, result string")


@query
def request_replies(spark, sf_dir):
    """The document tool's answers about planted documents, three findings of two kinds at most."""
    ask = F.to_json(F.struct(F.lit("2.0").alias("jsonrpc"), F.col("doc_id").alias("id"), F.lit("tools/call").alias("method"), F.struct(F.lit(TOOL).alias("name"), F.struct(F.col("text").alias("content"), F.array(F.lit("bidi"), F.lit("whitespace")).alias("kinds"), F.lit(3).alias("maxResults")).alias("arguments")).alias("params")))
    reply = answers(planted(spark, sf_dir).select(ask.alias("value")))
    got = lambda path: F.get_json_object("reply", f"$.{path}")
    data = "result.structuredContent"
    return reply.select(
        got("id").cast("long").alias("doc_id"), got("result.isError").alias("failed"), got(f"{data}.ok").alias("ok"), got(f"{data}.meta.count").cast("long").alias("count"),
        got(f"{data}.meta.truncated").alias("truncated"), got(f"{data}.data.findings[2].offset").cast("long").alias("third"), F.col("reply").rlike("[^\\x00-\\x7F]").alias("raw"),
    )


@query
def request_errors(spark, sf_dir):
    """Replies to lines that are no request, and to tools asked in the wrong way: of several faults the first counts."""

    got = answers(spark.createDataFrame([(x,) for x in REQUESTS], "value string"))
    json_of = lambda path: F.get_json_object("reply", f"$.{path}")
    return got.select("value", json_of("id").alias("id"), json_of("error.code").alias("code"), json_of("result.isError").alias("failed"), F.regexp_extract(json_of("result.content[0].text"), "^(content|maxResults|unknown kind)", 1).alias("about"))


@query
def sanitised_errors(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return rows.selectExpr("c_custkey", "'at /home/' || c_name || '/x (token=' || c_custkey || ') of C:\\\\Users\\\\' || c_name || ' api-key: ' || c_mktsegment AS message").select("c_custkey", redacted(F.col("message")).alias("message"))


@query
def stream_findings(spark, sf_dir):
    """The documents as a stream, screened and appended to a table, as finding_positions gives them in one go."""
    out = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    table = f"{sf_dir}/documents.parquet"
    docs = read_stream(spark, table, spark.read.parquet(table).schema).selectExpr("doc_id", f"{planting('doc_id', 'text')} AS text")
    screen_stream(docs, f"{out}/rows", f"{out}/checkpoint", kinds=native.KINDS).awaitTermination()
    schema = screen(docs, kinds=native.KINDS).schema
    return _first(spark.read.schema(schema).parquet(f"{out}/rows")).drop("scripts")


@query
def sql_findings(spark, sf_dir):
    register(spark)
    planted(spark, sf_dir).createOrReplaceTempView("planted_documents")
    return spark.sql("SELECT doc_id, f.line, f.column, f.offset, array_join(f.codepoints, ' ') AS codepoint, f.kind, f.severity FROM planted_documents, LATERAL unicode_findings(text, 'text', 'bidi,invisible,whitespace,unassigned', '') f")


@query
def sql_keys(spark, sf_dir):
    register(spark)
    spark.read.parquet(f"{sf_dir}/events.parquet").createOrReplaceTempView("structured_events")
    return spark.sql("SELECT event_id, k.start, k.`end`, k.path FROM structured_events, LATERAL key_spans(props, 'json') k")


@query
def sql_escapes(spark, sf_dir):
    register(spark)
    _customers(spark, sf_dir, ESCAPED).createOrReplaceTempView("escaped_customers")
    return spark.sql("SELECT doc_id, e.start, e.`end` FROM escaped_customers, LATERAL escape_spans(text) e")


@query
def sql_scalars(spark, sf_dir):
    register(spark)
    spark.read.parquet(f"{sf_dir}/documents.parquet").createOrReplaceTempView("named_documents")
    return spark.sql(f"SELECT doc_id, u_render(CAST(doc_id AS INT) + 65) AS rendered, escape_ascii('\u00e9' || doc_id) AS escaped, is_single_script(CASE doc_id % 3 WHEN 0 THEN 'ab' || doc_id WHEN 1 THEN 'a\u0430' END) AS single, resolve_format({FORMATS}, {NAMES}) AS reader FROM named_documents")
