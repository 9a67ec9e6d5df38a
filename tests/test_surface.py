import json

import pytest

from veilcheck import cli
from veilcheck.plans.requests import FRAME_BYTES, answer, answers, frames, serve


def test_arguments():
    assert cli.parse(["a", "--kind", "bidi, nfc", "--script", "Han,Cyrl", "--strict"]).kinds == ["bidi-control", "non-nfc"]
    for bad in ([], ["--no"], ["a", "--kind", ""], ["a", "--kind"], ["--stdin", "a"], ["a", "--fail-on", "x"], ["a", "--kind", "nfc", "--fail-on", "bidi"], ["a", "--kind", "z"]):
        with pytest.raises(ValueError):
            cli.parse(bad)


def test_scan(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"k": "x\u202ey"}')
    (tmp_path / "b.txt").write_bytes(b"\xff")
    (tmp_path / "c.md").write_text("clean")
    (tmp_path / "d.md").write_text("\u0436\u0436\u0436")
    document, lines, code = cli.scan(spark, cli.parse([str(tmp_path)]))
    assert code == 1 and document["summary"] == {"files": 4, "findings": 1, "bidi": 1, "refusals": 2, "unexamined": 1}
    assert [f["file"][-6:] for f in document["files"]] == ["a.json", "/b.txt", "e/c.md", "e/d.md"] or len(document["files"]) == 4
    assert document["files"][0]["findings"][0]["key"] == "k" and "scripts" in document["files"][0]["findings"][0]
    assert any("1 finding in 4 files, 2 refused (1 not read at all)" == x for x in lines) and lines[-1].startswith("name the expected script")
    assert cli.scan(spark, cli.parse([str(tmp_path), "--strict"]))[2] == 2
    assert cli.scan(spark, cli.parse([str(tmp_path), "--kind", "nfc"]))[2] == 0
    assert cli.scan(spark, cli.parse(["--stdin"]), "a\u200b".encode())[0]["files"][0]["file"] == "<stdin>"


def test_main_prints_what_scan_gives(spark, tmp_path, capsys):
    for name, text in {"b/z.json": '{"k": "x\u202ey"}', "b.txt": "\u0436\u0436", "a.md": "clean", "_c.txt": "\u200b"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "e.txt").write_bytes(b"\xff")
    code = cli.main([str(tmp_path), "--strict"])
    said = capsys.readouterr()
    document, lines, want = cli.scan(spark, cli.parse([str(tmp_path), "--strict"]))
    assert json.loads(said.out) == document and said.out.isascii() and said.err.splitlines() == lines and code == want == 2
    assert [f["file"][len(str(tmp_path)) + 1 :] for f in document["files"]] == ["_c.txt", "a.md", "b/z.json", "b.txt", "e.txt"]


def test_main_refuses(capsys):
    assert cli.main(["--\u00e9"]) == 2 and capsys.readouterr().err.isascii()


def call(arguments, tables, name="screen_text"):
    return json.loads(answer(json.dumps({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": name, "arguments": arguments}}), tables))


def test_requests(spark, tables):
    reply = answer(json.dumps({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": "screen_text", "arguments": {"content": '{"\u00e9": "a\u202e\u200b"}', "format": "json", "maxResults": 1}}}), tables)
    assert reply.isascii()
    data = json.loads(reply)["result"]["structuredContent"]
    assert data["meta"] == {"tool": "screen_text", "count": 1, "truncated": True} and data["data"]["findings"][0]["key"] == "\u00e9"
    assert call({"content": "x", "maxResults": 0}, tables)["result"]["isError"] and call({}, tables)["result"]["isError"] and call({"content": "x", "kinds": "bidi"}, tables)["result"]["isError"]
    assert call({"content": "\u0436"}, tables)["result"]["structuredContent"]["diagnostics"][0]["severity"] == "warning"
    assert call({}, tables, "other")["error"]["code"] == -32602
    for line, code in (("{", -32700), ("[]", -32700), ("x" * (FRAME_BYTES + 1), -32700), ('{"jsonrpc": "2.0", "id": 1, "method": "no"}', -32601)):
        assert json.loads(answer(line, tables))["error"]["code"] == code
    assert answer("  ", tables) is None and answer('{"jsonrpc": "2.0", "id": null, "method": "ping"}', tables) is None
    lines = spark.createDataFrame([('{"jsonrpc": "2.0", "id": 7, "method": "ping"}',), ("",)], "value string")
    assert {r.reply for r in answers(lines).collect()} == {'{"id": 7, "jsonrpc": "2.0", "result": {}}', None}


def test_tree_tool(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"k": "x\u202ey"}')
    (tmp_path / "b.txt").write_bytes(b"\xff")
    (tmp_path / ".h.txt").write_text("a\u200b")

    def ask(i, **arguments):
        return json.dumps({"jsonrpc": "2.0", "id": i, "method": "tools/call", "params": {"name": "screen_files", "arguments": arguments}}).encode() + b"\n"

    where = str(tmp_path)
    lines = [ask(1, path=where), ask(2, paths=[where], hidden=True, kinds=["invisible"]), ask(3), ask(4, paths=[]), ask(5, path=where + "/none"), ask(6, path=where, kinds=["no"]), ask(7, path=f"file://{where}"), b'{"jsonrpc": "2.0", "id": 8, "method": "tools/list"}\n', ask(9, path=where)[:-1]]
    got = {r["id"]: r["result"] for r in map(json.loads, serve(spark, [b"".join(lines)]))}
    assert set(got) == set(range(1, 9)) and [t["name"] for t in got[8]["tools"]] == ["screen_text", "screen_files"]
    one = got[1]["structuredContent"]
    assert one["ok"] and one["meta"] == {"tool": "screen_files", "count": 2, "truncated": False}
    assert [d["code"] for d in one["diagnostics"]] == ["refused"] and one["diagnostics"][0]["message"].startswith(f"{where}/b.txt: ")
    assert one["data"]["report"]["files"][0]["findings"][0]["key"] == "k" and one["data"]["report"]["summary"]["unexamined"] == 1
    two = got[2]["structuredContent"]["data"]["report"]["summary"]
    assert two["files"] == 3 and two["findings"] == 1
    assert all(got[i]["isError"] for i in (3, 4, 5, 6))
    assert got[7]["structuredContent"]["data"]["report"]["summary"] == one["data"]["report"]["summary"]


def test_frames():
    assert list(frames([b"a\nb", b"c\n\nd"])) == ["a", "bc", ""]
    assert list(frames([b"12345", b"6789\nok\n", b"1234567\n\xff\n"], most=6)) == [None, "ok", None, "\ufffd"]
    assert list(frames([b"123456\n"], most=6)) == ["123456"]


REORDERED = "a\u202e } \u2066if\u2069 \u2066 only\n\u202e { \u2066"
HAN = '{"a": "\u4f60\u597d\u4e16\u754c", "b": "title"}'
CASES = [
    ({"content": REORDERED}, 6, False, []),
    ({"content": "const total = 1 + 2;\n"}, 0, False, []),
    ({"content": HAN, "format": "json"}, 0, False, ["intentional_script_context"]),
    ({"content": HAN, "format": "json", "scripts": ["Han"]}, 0, False, []),
    ({"content": HAN, "kinds": ["bidi", "invisible"]}, 0, False, []),
    ({"content": "const p\u0430ypal = 'https://example.com'"}, 2, False, []),
    ({"content": "x\u200by\u00adz\u200d", "maxResults": 2}, 2, True, []),
    ({"content": "x\u200by\u00adz\u200d", "maxResults": 3}, 3, False, []),
    ({"content": "x\u200b" * 600}, 500, True, []),
    ({"content": "x\u200b" * 6000, "maxResults": 10**9}, 5000, True, []),
]


@pytest.mark.parametrize("arguments,count,truncated,refused", CASES)
def test_document_tool(tables, arguments, count, truncated, refused):
    reply = answer(json.dumps({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": "screen_text", "arguments": arguments}}), tables)
    assert reply.isascii()
    result = json.loads(reply)["result"]
    held = result["structuredContent"]
    assert held["ok"] and not result["isError"] and held["meta"] == {"tool": "screen_text", "count": count, "truncated": truncated} and len(held["data"]["findings"]) == count
    assert [d["code"] for d in held["diagnostics"]] == [r["reason"] for r in held["data"]["refusals"]] == refused and {d["severity"] for d in held["diagnostics"]} <= {"warning"}
    assert json.loads(result["content"][0]["text"]) == held and list(held) == sorted(held) and all(list(f) == sorted(f) for f in held["data"]["findings"])


@pytest.mark.parametrize("arguments,about", [
    ({"maxResults": 0, "kinds": ["no"]}, "content"), ({"content": 5}, "content"), ({"content": "x\ud800", "maxResults": 0}, "content"), ({"content": "x", "maxResults": 1.5, "kinds": ["no"]}, "maxResults"),
    ({"content": "x", "kinds": ["homoglyph"], "scripts": ["no"]}, "'homoglyph'"), ({"content": "x", "kinds": "bidi"}, "kinds"), ({"content": "x", "scripts": ["Klingon"]}, "'Klingon'"), ({"content": "x", "format": 1}, "format"),
])
def test_document_tool_names_the_first_fault(tables, arguments, about):
    result = call(arguments, tables)["result"]
    assert result["isError"] and about in result["content"][0]["text"] and "structuredContent" not in result
