"""The golden cases: findings by kind, place and code points that any engine of this kind must give.

Documents are made here from the places alone: a filler up to each, then the
characters that are found there.
"""

import pytest
from pyspark.sql import functions as F

from veilcheck.functions.options import options
from veilcheck.operators.kernel import examine
from veilcheck.operators.screen import file_reports
from veilcheck.sources.decode import decoded
from veilcheck.sources.files import read_files


def made(places, filler="-", lead=""):
    """A text with each (line, column, offset, characters) where it says."""
    out = lead
    for line, column, offset, chars in places:
        size = len(out.encode())
        feeds = line - 1 - out.count("\n")
        if feeds:
            before = offset - (column - 1) - feeds
            assert before >= size
            out += filler * (before - size) + "\n" * feeds + filler * (column - 1)
        else:
            at = len(out.rpartition("\n")[2].encode("utf-16-le")) // 2 + 1
            assert offset - size == column - at, (line, column)
            out += filler * (column - at)
        out += chars
    return out


def run(text, tables, format="text", scripts=()):
    found, why = examine(text, format, options(tables, (), scripts), tables)
    return [(f[0], f[2], f[3], f[4], " ".join(f[6]), " ".join(f[8]) or None, f[5]) for f in found], why


HAZARDS = {
    "reordering": ("bidi-control", "high", [(6, 7, 86, "\u202e"), (6, 11, 92, "\u2066"), (6, 24, 107, "\u2069"), (6, 26, 111, "\u2066"), (8, 24, 198, "\u202e"), (8, 28, 204, "\u2066")]),
    "invisible": ("invisible", "medium", [(3, 11, 99, "\u200b"), (4, 20, 137, "\u00ad"), (5, 18, 163, "\u200d"), (6, 16, 185, "\u2060"), (7, 19, 210, "\ufeff"), (8, 21, 238, "\u180e"), (9, 17, 261, "\u200c")]),
    "spaces": ("unusual-whitespace", "low", [(3, 18, 28, "\u00a0"), (4, 22, 57, "\u3000"), (5, 14, 79, "\u2009")]),
    "no meaning": ("unassigned-or-private-use", "medium", [(1, 14, 13, "\ue000"), (2, 13, 29, "\u0378")]),
}


@pytest.mark.parametrize("name", HAZARDS)
def test_characters(tables, name):
    kind, severity, places = HAZARDS[name]
    text = made(places)
    found, why = run(text, tables)
    assert found == [(kind, line, column, offset, f"U+{ord(c):04X}", None, None) for line, column, offset, c in places] and why is None
    assert {f[1] for f in examine(text, "text", options(tables), tables)[0]} == {severity}


def test_mark_at_the_start_counts_but_is_not_found(tables):
    assert run("\ufeffconst x = 'ab\ufeffc'", tables)[0] == [("invisible", 1, 15, 16, "U+FEFF", None, None)]


def test_homoglyphs(tables):
    text = made([(2, 7, 69, "p\u0430y"), (3, 7, 108, "l\u03bfgin")], filler=" ", lead="plain letters so that few are foreign")
    assert run(text, tables) == ([
        ("mixed-script", 2, 7, 69, "U+0430", None, None), ("confusable", 2, 8, 70, "U+0430", "U+0061", None),
        ("mixed-script", 3, 7, 108, "U+03BF", None, None), ("confusable", 3, 8, 109, "U+03BF", "U+006F", None),
    ], None)


def test_full_width(tables):
    text = made([(2, 7, 77, "\uff26\uff29\uff2c\uff25"), (3, 14, 115, "\uff10\uff11"), (4, 7, 133, "\U0001d41adm")], filler=" ", lead="plain letters")
    want = [(2, 7, 77, "F"), (2, 8, 80, "I"), (2, 9, 83, "L"), (2, 10, 86, "E"), (3, 14, 115, "0"), (3, 15, 118, "1")]
    assert run(text, tables)[0] == [("confusable", *p[:3], f"U+{ord(p[3]) + 0xFEE0:04X}", f"U+{ord(p[3]):04X}", None) for p in want] + [("confusable", 4, 7, 133, "U+1D41A", "U+0061", None)]


def test_two_systems_in_a_word(tables):
    lead = "enough plain letters in a first line that is all latin text"
    text = made([(2, 1, 63, "PDF\u6587\u4ef6 = x\n" + "more plain letters, a tenth of these may be foreign. " * 4 + "\n\n"), (6, 1, 295, "\uff30\uff24\uff26\u6587\u4ef6")], filler=" ", lead=lead)
    assert run(text, tables) == ([
        ("mixed-script", 2, 1, 63, "U+6587 U+4EF6", None, None), ("confusable", 6, 1, 295, "U+FF30", "U+0050", None), ("mixed-script", 6, 1, 295, "U+FF30 U+FF24 U+FF26 U+6587 U+4EF6", None, None),
        ("confusable", 6, 2, 298, "U+FF24", "U+0044", None), ("confusable", 6, 3, 301, "U+FF26", "U+0046", None),
    ], None)


def test_decomposed(tables):
    assert run("cafe\u0301 re\u0301e\ncomposed: \u00e9\n", tables)[0] == [("non-nfc", 1, 4, 3, "U+0065 U+0301", None, None)]


TREES = {
    "json": ('{"metrics": {\n "headline": {\n  "other": 1,\n  "eyebrow": \n    "      %s"}}, "greeting": "Hello\\n\u041f\u0440\u0438\u0432\u0435\u0442"}', "\u202e", "bidi-control", "metrics.headline.eyebrow", True),
    "yaml": ('service:\n  display:\n    label: "%s"\n  retries: 3\n', "\u202e", "bidi-control", "service.display.label", False),
    "toml": ('[server.limits]\nnote = "a price:%s10"\n', "\u00a0", "unusual-whitespace", "server.limits.note", False),
    "ini": ("[database]\nhost = local%shost\n", "\u200b", "invisible", "database.host", False),
    "csv": ("id,name\n1,%sile\n", "\uff26", "confusable", "name", False),
    "tsv": ("id\tname\n1\t%sile\n", "\uff26", "confusable", "name", False),
}
AT = {"yaml": (3, 13, 32), "toml": (2, 17, 32), "ini": (2, 13, 23), "csv": (2, 3, 10), "tsv": (2, 3, 10)}


@pytest.mark.parametrize("format", TREES)
def test_keys(tables, format):
    text, char, kind, key, refused = TREES[format]
    found, why = run(text % char, tables, format)
    assert [(f[0], f[4], f[6]) for f in found] == [(kind, f"U+{ord(char):04X}", key)] and (why is not None) == refused
    if format in AT:
        assert found[0][1:4] == AT[format]


def test_keys_of_an_environment(tables):
    text = "A_KEY=123456\nAPI_HOST=example\u0430.com and some plain letters here\n"
    text = text.replace("example", "server")
    assert run(text, tables, "env")[0] == [("mixed-script", 2, 10, 22, "U+0430", None, "API_HOST"), ("confusable", 2, 16, 28, "U+0430", "U+0061", "API_HOST")]


CLEAN = {"Han": "\u4f60\u597d\uff0c\u4e16\u754c", "Cyrillic": "\u041f\u0440\u0438\u0432\u0435\u0442 \u043c\u0438\u0440", "Hiragana,Katakana,Han": "\u3053\u3093\u306b\u3061\u306f\u4e16\u754c\u30ab\u30ca"}


@pytest.mark.parametrize("scripts", CLEAN)
def test_catalogues_stay_clean(tables, scripts):
    text = '{"greeting": "%s", "title": "%s"}' % (CLEAN[scripts], CLEAN[scripts])
    found, why = run(text, tables, "json")
    assert found == [] and "letters are" in why
    assert run(text, tables, "json", scripts.split(",")) == ([], None)
    assert run("const caf\u00e9 = 'na\u00efve'", tables) == ([], None)


def test_bytes_that_are_no_text(spark, tmp_path):
    cases = {"utf16le.txt": (b"\xff\xfeh\0i\0", "encoding_unknown"), "binary.dat": (b"\x7fELF\0\0\x01", "binary_or_undecodable"), "latin1.txt": (b"caf\xe9 cr\xe8me", "binary_or_undecodable")}
    for name, (content, _) in cases.items():
        (tmp_path / name).write_bytes(content)
    got = {r.file.rpartition("/")[2]: (r.text, r.reason) for r in read_files(spark, [str(tmp_path / n) for n in cases]).collect()}
    assert got == {n: (None, reason) for n, (_, reason) in cases.items()}
    rows = spark.createDataFrame([(n, bytearray(c)) for n, (c, _) in cases.items()], "file string, content binary")
    assert {r.file: r.reason for r in decoded(rows).collect()} == {n: r for n, (_, r) in cases.items()}


def test_the_same_through_spark(spark, tables):
    """Documents of several formats in one table, by file name."""
    rows = [(f"d/{f}.{f}", t % c) for f, (t, c, *_) in TREES.items()] + [("x.txt", made(HAZARDS["reordering"][2])), ("y.txt", None), ("z.txt", "plain")]
    frame = spark.createDataFrame(rows, "file string, text string")
    got = {r.file: r for r in file_reports(frame, "file", "text", filename=F.col("file")).collect()}
    for name, text in rows:
        want = examine(text or "", name.rpartition(".")[2].replace("txt", "text"), options(tables), tables)
        assert [tuple(f) for f in got[name].findings] == want[0] and len(got[name].refusals) == (want[1] is not None)
