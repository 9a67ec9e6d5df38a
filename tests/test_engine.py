import json
import os
import shutil

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from veilcheck.functions.expressions import escape_ascii, redacted
from veilcheck.functions.options import check_gate
from veilcheck.functions.sqlfuncs import register
from veilcheck.operators import native, report
from veilcheck.operators.keys import key_paths, keys_at
from veilcheck.operators.screen import file_reports, refusals, screen
from veilcheck.plans import sinks
from veilcheck.plans.planted import planting
from veilcheck.plans.queries import QUERIES
from veilcheck.sources import files, ignore
from veilcheck.sources.decode import decoded, editor_text, first_invalid
from veilcheck.streaming.stream import read_stream, screen_stream

TEXTS = ["plain", None, "", "a\u202eb\nc\u00a0d \U0001f600\u200b", "\ufeffx\ufeff", "\u0436\u0436\u0436 ab", "p\u0430y and many more plain letters that follow here", "\n\u202e\n\n\u2066\u2069"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("kind", F.lit("x"))


def test_native_and_kernel_agree(docs):
    one = screen(docs, kinds=native.KINDS).select("doc_id", "line", "column", "offset", F.col("codepoints")[0].alias("codepoint"), "kind", "severity")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, native.located(docs).select(*one.columns).collect())) != []


def test_repeated_ids_are_documents_of_their_own(spark, docs):
    twice = docs.unionByName(docs).unionByName(docs.select(F.lit(3).cast("long").alias("doc_id"), "text", "kind"))
    one = screen(twice, kinds=native.KINDS).select("doc_id", "line", "column", "offset", F.col("codepoints")[0].alias("codepoint"), "kind", "severity")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, native.located(twice).select(*one.columns).collect()))


def test_reports_read_once(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "d"))
    plan = file_reports(spark.read.parquet(str(tmp_path / "d")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan


def test_keys_of_many_findings(spark, tables):
    """Findings inside spans, between them, at both ends and of documents without any, against the kernel's search."""
    rows = [(1, '{"a": "x\u200by", "b\u200b": ["\u200b", 1, "\u200b\u200b"]}'), (2, "\u200b"), (3, '["\u200b"] \u200b'), (4, "{}")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = screen(frame, kinds=["invisible"], format="json").withColumnRenamed("key", "want").withColumn("start", F.lit("clash"))
    got = keys_at(found, key_paths(frame, "doc_id", "text", "json")).collect()
    assert len(got) == 8 and all((r.path or None) == r.want for r in got) and {r.want for r in got} == {"a", "b\u200b.[0]", "b\u200b.[2]", "[0]", None}


def test_reports(docs):
    files_ = file_reports(docs)
    rows = {r.doc_id: r for r in files_.collect()}
    assert len(rows) == len(TEXTS) and rows[1].n_findings == 0 and rows[3].n_bidi == 1 and rows[5].n_refusals == 1 and not rows[5].unexamined
    total = report.run_summary(files_)
    assert total.first().asDict() == {"schema": 1, "files": 8, "findings": 9, "bidi": 4, "refusals": 1, "unexamined": 0}
    assert [total.select(report.exit_code(on, strict)).first()[0] for on in ("any", "bidi") for strict in (False, True)] == [1, 2, 1, 2]
    assert sinks.summary_line(total).first().line == "9 findings in 8 files, 1 refused (0 not read at all)"
    assert refusals(docs, kinds=["bidi"]).count() == 0 and refusals(docs, scripts=["Cyrillic"]).count() == 0


def test_empty_table(spark, docs):
    none = docs.where("false")
    assert screen(none).count() == 0 and native.located(none).count() == 0
    assert report.run_summary(file_reports(none)).first().files == 0


def test_caps(docs):
    found = file_reports(docs)
    assert {(r.doc_id, r.truncated) for r in report.capped(found, 2).collect()} == {(3, True), (4, False), (6, False), (7, True)}
    assert [r.place for r in report.capped_over_files(found, 4).orderBy("place").collect()] == [1, 2, 3, 4]


def test_sinks_are_ascii(docs, tmp_path):
    files_ = file_reports(docs.withColumn("name", F.concat(F.lit("\u00e9`\\"), F.col("doc_id").cast("string"))), id_col="name")
    for r in sinks.json_rows(files_, "name").collect():
        assert r.json.isascii() and json.loads(r.json)["file"] == r.name
    assert all(r.section.isascii() for r in sinks.markdown_section(files_, "name").collect())
    reply = [json.loads(r.reply) for r in sinks.envelope(files_, "name", "t", 2).collect()]
    assert all(x["ok"] for x in reply) and sum(x["meta"]["truncated"] for x in reply) == 2
    line = screen(docs).where("doc_id = 3").select(sinks.human_line(F.lit("\u00e9.txt")).alias("l")).first().l
    assert line.startswith("\\u00E9.txt:1:2  [high] bidi-control U+202E  right-to-left override")
    sinks.write_json_report(files_, report.run_summary(files_), str(tmp_path / "r"), "name")
    assert "\\u00E9" in "".join(p.read_text() for p in (tmp_path / "r/files").glob("*.txt"))
    row = docs.sparkSession.createDataFrame([("\U0001f600\u00e9a", "at /home/me/x token=abc")], "t string, m string").select(escape_ascii(F.col("t")), redacted(F.col("m"))).first()
    assert tuple(row) == ("\\uD83D\\uDE00\\u00E9a", "at /home/***/x token=***")


def test_gate_that_cannot_fail():
    with pytest.raises(ValueError):
        check_gate("bidi", ("invisible",))
    assert check_gate("bidi", ()) == "bidi"


def test_decode(spark):
    cases = [(0, b"caf\xe9", "binary_or_undecodable"), (1, b"\xff\xfea\0", "encoding_unknown"), (2, b"ok \xc3\xa9", None), (3, b"a\0b", "binary_or_undecodable"), (4, b"", None), (5, b"\xef\xbb\xbfx", None), (6, b"\xed\xa0\x80", "binary_or_undecodable"), (7, b"\xc3\xa9" * 4000 + b"\0" + b"x" * 300, "binary_or_undecodable"), (8, b"x" * 8192 + b"\0", None)]
    rows = spark.createDataFrame([(i, bytearray(b)) for i, b, _ in cases], "doc_id long, content binary")
    got = {r.doc_id: r for r in decoded(rows).collect()}
    assert [got[i].reason for i, _, _ in cases] == [w for _, _, w in cases]
    assert got[7].refusal == "a NUL at byte 8000" and got[2].text == "ok \u00e9" and got[5].text == "\ufeffx"
    assert {r.doc_id: r.at for r in first_invalid(rows, "doc_id", "content").collect()}[0] == 3
    assert rows.where("doc_id = 8").select(editor_text(F.col("content"))).first()[0] is None


IGNORES = [("*.log\n!keep.log", "a/x.log", True), ("*.log\n!keep.log", "keep.log", False), ("/top", "a/top", False), ("a/**/z", "a/b/c/z", True), ("**/b", "q/b", True), ("a/**", "a/x/y", True), ("[!x]y", "zy", True), ("\\#a", "#a", True), ("# a", "# a", False)]


@pytest.mark.parametrize("rules,path,want", IGNORES)
def test_ignore_rules(rules, path, want):
    assert bool(ignore.verdict(ignore.parse(rules), path, False)) == want


def test_walk_and_read(spark, tmp_path):
    (tmp_path / ".git/info").mkdir(parents=True)
    (tmp_path / ".git/info/exclude").write_text("secret.txt\n")
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "out").mkdir()
    for name, content in {"a/b.md": b"x\xe2\x80\xae", "a/b/z [1].md": b"y", "a.md": b"\xff", "out/n.txt": b"n", ".hidden": b"h", "secret.txt": b"s", "k.log": b"l", "a/keep.log": b"k", "p%20+q.txt": b"p"}.items():
        (tmp_path / name).write_bytes(content)
    (tmp_path / ".gitignore").write_text("*.log\nout/\n")
    (tmp_path / "a/.ignore").write_text("!keep.log\n")
    os.symlink(tmp_path / "a.md", tmp_path / "link.md")
    found = files.walk(str(tmp_path))
    assert [os.path.relpath(f, tmp_path) for f in found] == ["a/b/z [1].md", "a/b.md", "a/keep.log", "a.md", "p%20+q.txt"]
    assert str(tmp_path / "k.log") in files.collect([str(tmp_path), str(tmp_path / "k.log")])
    with pytest.raises(FileNotFoundError):
        files.collect([str(tmp_path / "none")])
    got = {os.path.relpath(r.file, tmp_path): r for r in files.read_files(spark, found).collect()}
    assert set(got) == {os.path.relpath(f, tmp_path) for f in found} and got["a.md"].reason and got["a/b.md"].text == "x\u202e"
    listed = files.listing(str(tmp_path), always=("k.log",))
    names = [os.path.relpath(f, tmp_path) for f in listed.files]
    assert names == [".gitignore", ".hidden", "a.md", "a/.ignore", "a/b.md", "a/b/z [1].md", "k.log", "link.md", "p%20+q.txt", "secret.txt"] and listed.ignored == 1
    assert files.listing(str(tmp_path), most=3).limit_reached and files.listing(str(tmp_path), default_excludes=False, respect_ignore=False).ignored == 0
    assert files.stdin(spark, b"a\xc3\xa9").first().text == "a\u00e9"
    assert report.scan_counts(files.read_for_editor(spark, found, 1)).first().asDict() == {"read": 3, "too_large": 1, "not_text": 1, "unreadable": 0, "ignored": 0, "limit_reached": False}
    assert files.read_folder(spark, str(tmp_path), "*.md").count() >= 3
    # names that Spark's own source passes over, and a store by its URI
    (tmp_path / "__init__.py").write_text("a\u200b")
    hidden = [str(tmp_path / n) for n in (".hidden", "__init__.py", "gone.txt")]
    got = {os.path.basename(r.file): r for r in files.read_files(spark, hidden).collect()}
    assert got[".hidden"].text == "h" and got["__init__.py"].text == "a\u200b" and got["gone.txt"].reason and got["gone.txt"].text is None
    assert report.scan_counts(files.read_for_editor(spark, hidden, 100), ignored=2, limit_reached=True).first().asDict() == {"read": 2, "too_large": 0, "not_text": 0, "unreadable": 1, "ignored": 2, "limit_reached": True}
    root = f"file://{tmp_path}"
    there = files.walk(root, spark=spark)
    assert [f.removeprefix(root + "/") for f in there] == ["__init__.py", *(os.path.relpath(f, tmp_path) for f in found)]
    assert sorted(r.text or "" for r in files.read_folder(spark, root, options=files.Walk()).collect()) == sorted(["a\u200b", "x\u202e", "y", "", "k", "p"])


def test_inventory_is_judged_as_a_tree_is(spark, tmp_path):
    rules = "*.log\n!keep.log\nout/\n/top\n# a\na/**/z\n"
    names = ["x.log", "keep.log", "a/x.log", "out/keep.log", "b/out/f", "top", "c/top", "a/b/z", "a/z/q", "p.png", "node_modules/m.js", "q.min.js", "r.js", ".hidden", "out.txt"]
    (tmp_path / ".git").mkdir()
    (tmp_path / ".gitignore").write_text(rules)
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text("x")
    (tmp_path / ".git").rmdir()
    (tmp_path / ".git").mkdir()
    listed = files.listing(str(tmp_path), always=("a/x.log",))
    got = {r.path: r.state for r in files.listed(spark.createDataFrame([(n,) for n in names], "path string"), always=("a/x.log",), rules=rules).collect()}
    assert {n for n, s in got.items() if s == "listed"} == {os.path.relpath(f, tmp_path) for f in listed.files} - {".gitignore"}
    assert sum(s == "ignored" for s in got.values()) == listed.ignored and got["p.png"] == got["q.min.js"] == "left-out"


def test_sql_functions(spark, docs):
    register(spark)
    docs.createOrReplaceTempView("docs")
    found = spark.sql("SELECT doc_id, f.kind FROM docs, LATERAL unicode_findings(text, 'text', 'bidi', '') f")
    assert found.count() == 4
    assert spark.sql("SELECT path FROM VALUES ('{\"a\": 1}') t(x), LATERAL key_spans(x, 'json')").first().path == "a"
    assert spark.sql("SELECT u_render(65), escape_ascii('\u00e9')").first()[:] == ("U+0041", "\\u00E9")
    assert spark.sql("SELECT is_single_script('ab1'), is_single_script('a\u0430'), resolve_format(NULL, 'x.yml')").first()[:] == (True, False, "yaml")
    assert spark.sql("SELECT start FROM VALUES ('\"a\\\\n\"') t(x), LATERAL escape_spans(x)").first().start == 2


def test_stream_equals_batch(spark, docs, tmp_path):
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = read_stream(spark, str(tmp_path / "in"), "doc_id long, text string", files_each=1)
    screen_stream(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(str, screen(docs).collect()))


@pytest.mark.parametrize("shape", ["file", "folder", "parts"])
def test_a_table_of_any_shape_as_a_stream(spark, tmp_path, shape):
    """One file, a folder of files and one of folders; a table of that name further down is another one."""
    texts = ["one. two. three", "a, b, c", "d. e", "plain", None] * 8
    rows = spark.createDataFrame([(i, x, "ab"[i % 2]) for i, x in enumerate(texts)], "doc_id long, text string, lang string")
    table = tmp_path / "documents.parquet"
    if shape == "file":
        rows.coalesce(1).write.parquet(str(tmp_path / "x"))
        for at in (table, tmp_path / "old" / "documents.parquet"):
            at.parent.mkdir(exist_ok=True)
            shutil.copy(next((tmp_path / "x").glob("part-*")), at)
    else:
        rows.repartition(3).write.partitionBy(*["lang"] * (shape == "parts")).parquet(str(table))
    docs = spark.read.parquet(str(table)).selectExpr("doc_id", f"{planting('doc_id', 'text')} AS text")
    got = QUERIES["stream_findings"](spark, str(tmp_path))
    want = native.located(docs)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect())) != []


def test_a_missing_table_is_no_empty_stream(spark, tmp_path):
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        read_stream(spark, str(tmp_path / "documents.parquet"), "doc_id long, text string")
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        QUERIES["stream_findings"](spark, str(tmp_path))


def test_filters_reach_the_scan(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "d"))
    plan = screen(spark.read.parquet(str(tmp_path / "d")))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan and "Exchange" not in plan


def test_a_store_by_its_uri(spark, tmp_path):
    """Hadoop's file systems list and read what the local disk does."""
    from veilcheck.sources.stores import Hadoop, Local

    (tmp_path / "a").mkdir()
    (tmp_path / "a/_b.txt").write_text("\u00e9")
    there, here, root = Hadoop(spark), Local(), f"file://{tmp_path}"
    assert sorted(there.entries(root)) == sorted(here.entries(root)) == [("a", "folder")]
    assert there.text(f"{root}/a/_b.txt") == here.text(f"{root}/a/_b.txt") == "\u00e9" and there.content(f"{root}/a/_b.txt") == "\u00e9".encode()
    assert there.text(f"{root}/none") is here.text(f"{root}/none") is None and there.why_not(f"{root}/none") and there.why_not(f"{root}/a/_b.txt") is None
    assert there.is_folder(f"{root}/a") and not there.exists(f"{root}/none") and there.whole(root + "/") == root
