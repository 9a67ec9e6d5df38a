"""Requests as rows: a table of JSON-RPC lines to a table of replies.

The document tool and the protocol's other methods need no file, so each line
is answered by itself, on a stream of lines as on a table. The tree tool reads
files through Spark, so serve() answers it from the driver.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions.options import max_results, options, resolve_format
from ..functions.shipping import ship
from ..functions.ucd import Tables, shared
from ..operators.kernel import FIELDS, examine
from ..sources import files
from .trees import document, tree_reports

FRAME_BYTES = 16 << 20
TOOL, TREE = "screen_text", "screen_files"
PARSE, PARAMETERS, METHOD = -32700, -32602, -32601
_LISTS, _FLAG = {"type": "array", "items": {"type": "string"}}, {"type": "boolean", "default": False}
SCHEMA = {
    "type": "object", "required": ["content"],
    "properties": {"content": {"type": "string"}, "kinds": _LISTS, "scripts": _LISTS, "format": {"type": "string"}, "filename": {"type": "string"}, "maxResults": {"type": "integer", "minimum": 1}},
}
TREE_SCHEMA = {"type": "object", "properties": {"path": {"type": "string"}, "paths": _LISTS, "kinds": _LISTS, "scripts": _LISTS, "hidden": _FLAG, "ignored": _FLAG}}


def ascii_json(value) -> str:
    """JSON in ASCII, escapes with upper-case digits, keys in order."""
    text = json.dumps(value, sort_keys=True, ensure_ascii=False)
    return text if text.isascii() else "".join(c if c < "\x80" else "".join(f"\\u{int.from_bytes(c.encode('utf-16-be', 'surrogatepass')[i : i + 2]):04X}" for i in range(0, 2 if ord(c) < 0x10000 else 4, 2)) for c in text)


def _strings(arguments: dict, name: str) -> list[str]:
    found = arguments.get(name, [])
    if not isinstance(found, list) or not all(isinstance(x, str) for x in found):
        raise ValueError(f"{name} is a list of strings")
    return found


def reply_of(tool: str, data: dict, count: int, diagnostics: list[dict], truncated: bool) -> dict:
    """What every tool answers with. ok: it did its work; what it found is data, and only an error among the diagnostics says otherwise."""
    return {"ok": all(d["severity"] != "error" for d in diagnostics), "data": data, "diagnostics": diagnostics, "meta": {"tool": tool, "count": count, "truncated": truncated}}


def run_tool(arguments: dict, tables: Tables) -> dict:
    """The envelope for a document: content, then the cap, then options; the first that is wrong is the error."""
    content = arguments.get("content")
    if not isinstance(content, str):
        raise ValueError("content is required and is a string")
    if any("\ud800" <= c <= "\udfff" for c in content):
        raise ValueError("content holds half of a surrogate pair")
    most = max_results(arguments.get("maxResults"))
    asked = options(tables, _strings(arguments, "kinds"), _strings(arguments, "scripts"))
    names = [arguments.get(n) for n in ("format", "filename")]
    if names[0] is not None and not isinstance(names[0], str):
        raise ValueError("format is a string")
    found, why = examine(content, resolve_format(*(n if isinstance(n, str) else None for n in names)), asked, tables)
    findings = [{k: v for k, v in zip(FIELDS, f, strict=True) if v not in (None, [])} for f in found[:most]]
    refusals = [] if why is None else [{"reason": "intentional_script_context", "detail": why}]
    warnings = [{"severity": "warning", "code": r["reason"], "message": r["detail"]} for r in refusals]
    return reply_of(TOOL, {"findings": findings, "refusals": refusals}, len(findings), warnings, len(found) > most)


def run_tree(arguments: dict, spark: SparkSession) -> dict:
    """The envelope for files and folders: a report of one run, and a warning for each file that was not judged in full."""
    if isinstance(arguments.get("path"), str):
        inputs = [arguments["path"]]
    elif isinstance(arguments.get("paths"), list):
        inputs = [x for x in arguments["paths"] if isinstance(x, str)]
        if not inputs:
            raise ValueError("paths names no file and no folder")
    else:
        raise ValueError("path or paths is required")
    asked = options(shared(ship(spark))[0], _strings(arguments, "kinds"), _strings(arguments, "scripts"))
    flags = {name: arguments.get(name) is True for name in ("hidden", "ignored")}
    try:
        names = files.collect(inputs, files.Walk(flags["hidden"], not flags["ignored"]), spark)
    except FileNotFoundError as e:
        raise ValueError(f"no such file or folder: {e}") from None
    reports = tree_reports(files.read_files(spark, names), asked.kinds, asked.scripts).cache()
    try:
        found = document(reports)
    finally:
        reports.unpersist()
    warnings = [{"severity": "warning", "code": "refused", "message": f"{f['file']}: {r['detail']}"} for f in found["files"] for r in f["refusals"]]
    return reply_of(TREE, {"report": found}, found["summary"]["files"], warnings, False)


def answer(line: str, tables: Tables, tree: Callable[[dict], dict] | None = None) -> str | None:
    """The reply to a line; none to an empty line or a notification. Without `tree` there is no tree tool."""

    def failed(code: int, message: str, to=None) -> str:
        return ascii_json({"jsonrpc": "2.0", "id": to, "error": {"code": code, "message": message}})

    if len(line.encode(errors="surrogatepass")) > FRAME_BYTES:
        return failed(PARSE, f"a message of more than {FRAME_BYTES} bytes")
    if not line.strip():
        return None
    try:
        request = json.loads(line)
    except ValueError:
        return failed(PARSE, "the line is not JSON")
    if not isinstance(request, dict) or request.get("jsonrpc") != "2.0" or not isinstance(request.get("method"), str):
        return failed(PARSE, "the line is not a JSON-RPC 2.0 request")
    to, method = request.get("id"), request["method"]
    if to is None:
        return None
    tools: dict[str, Callable[[dict], dict]] = {TOOL: lambda a: run_tool(a, tables)}
    said = [{"name": TOOL, "description": "Findings of one text, as code points, never as the characters themselves.", "inputSchema": SCHEMA}]
    if tree is not None:
        tools[TREE] = tree
        said.append({"name": TREE, "description": "One report over files and folders. Reads them and writes none.", "inputSchema": TREE_SCHEMA})
    if method == "ping":
        result: dict = {}
    elif method == "initialize":
        result = {"protocolVersion": "2025-06-18", "capabilities": {"tools": {}}, "serverInfo": {"name": "veilcheck", "version": "1"}}
    elif method == "tools/list":
        result = {"tools": said}
    elif method == "tools/call":
        given = request.get("params")
        if not isinstance(given, dict) or not isinstance(given.get("name"), str):
            return failed(PARAMETERS, "tools/call takes a name", to)
        if given["name"] not in tools:
            return failed(PARAMETERS, f"no tool is named {given['name']}", to)
        try:
            arguments = given.get("arguments", {})
            reply = tools[given["name"]](arguments if isinstance(arguments, dict) else {})
            result = {"content": [{"type": "text", "text": ascii_json(reply)}], "structuredContent": reply, "isError": False}
        except ValueError as e:
            result = {"content": [{"type": "text", "text": str(e)}], "isError": True}
    else:
        return failed(METHOD, f"no method is named {method}", to)
    return ascii_json({"jsonrpc": "2.0", "id": to, "result": result})


def frames(chunks: Iterable[bytes], most: int = FRAME_BYTES) -> Iterator[str | None]:
    """Lines of a stream of bytes; None for one of more than `most` bytes, which is let go as it comes. An unfinished last line is dropped, and bytes that are not UTF-8 become U+FFFD."""
    held, over = bytearray(), False
    for chunk in chunks:
        *whole, rest = chunk.split(b"\n")
        for part in whole:
            if over or len(held) + len(part) > most:
                yield None
            else:
                held += part
                yield held.decode(errors="replace")
            held.clear()
            over = False
        over = over or len(held) + len(rest) > most
        if over:
            held.clear()
        else:
            held += rest


def serve(spark: SparkSession, chunks: Iterable[bytes]) -> Iterator[str]:
    """Replies to a stream of request bytes, with both tools, from the driver."""
    tables = shared(ship(spark))[0]
    for line in frames(chunks):
        reply = answer("x" * (FRAME_BYTES + 1) if line is None else line, tables, lambda a: run_tree(a, spark))
        if reply is not None:
            yield reply


def answers(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """(line, reply) of a column of request lines; the tree tool is not offered, as executors do not start jobs."""
    _, held = shared(ship(lines.sparkSession))

    def run(batches):
        for batch in batches:
            replies = [answer(x or "", held.value) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(replies, pa.string())], names=[line_col, "reply"])

    return lines.select(line_col).mapInArrow(run, f"`{line_col}` string, reply string")
