import random
import time

import pyarrow as pa
import pytest

from veilcheck.functions.options import max_results, options, parse_kind, resolve_format, typed
from veilcheck.operators import kernel
from veilcheck.operators.kernel import Text, examine, examine_texts, is_single_script, slices
from veilcheck.operators.keypaths import json_escapes, key_at, key_spans


def found(text, tables, format="text", kinds=(), scripts=()):
    return examine(text, format, options(tables, kinds, scripts), tables)


def brief(text, tables, **how):
    return [(f[0], f[2], f[3], f[4], " ".join(f[6])) for f in found(text, tables, **how)[0]]


def test_single_characters(tables):
    assert brief("a\u202eb\n\u200b \u00a0\ue000\u0378", tables) == [
        ("bidi-control", 1, 2, 1, "U+202E"), ("invisible", 2, 1, 6, "U+200B"), ("unusual-whitespace", 2, 3, 10, "U+00A0"),
        ("unassigned-or-private-use", 2, 4, 12, "U+E000"), ("unassigned-or-private-use", 2, 5, 15, "U+0378"),
    ]
    assert brief("x\u200e\u200f\u0085\u2028\u2029y", tables) == []


def test_leading_mark_is_no_finding_but_counts(tables):
    assert brief("\ufeffa\ufeff", tables) == [("invisible", 1, 3, 4, "U+FEFF")]


def test_columns_are_utf16_and_offsets_bytes(tables):
    assert brief("\U0001f600\u202e", tables) == [("bidi-control", 1, 3, 4, "U+202E")]


def test_mixed_words_and_homoglyphs(tables):
    rest = " plain words so that the share stays low enough to judge"
    got = found("p\u0430y_1" + rest, tables)[0]
    assert [(f[0], f[4], f[6], f[7], f[8]) for f in got] == [("mixed-script", 0, ["U+0430"], ["Cyrillic", "Latin"], []), ("confusable", 1, ["U+0430"], ["Cyrillic"], ["U+0061"])]
    assert found("p\u0430y" + rest, tables, scripts=["Cyrl"])[0] == []
    assert found("\u0430-b" + rest, tables)[0] == []


def test_compatibility_forms_ignore_declared_scripts(tables):
    for scripts in ((), ("Han",)):
        assert [(f[0], f[8]) for f in found("\uff26x \U0001d41a ok and more", tables, scripts=scripts)[0]] == [("confusable", ["U+0046"]), ("confusable", ["U+0061"])]
    assert found("x\u00b2 y\u2074", tables)[0] == []


def test_scripts_that_belong_together(tables):
    points = lambda s: Text(s, tables).points
    assert is_single_script(points("\u65e5\u672c\u3054\u30ab1_"), tables)
    assert is_single_script(points("\u6587\u3105"), tables) and is_single_script(points("\ud55c\u6587"), tables)
    assert not is_single_script(points("a\u6587"), tables) and not is_single_script(points("\u3105\u30ab"), tables)


@pytest.mark.parametrize("foreign,refused", [(9, False), (10, True), (11, True)])
def test_a_tenth_of_the_letters_is_too_much(tables, foreign, refused):
    text = "\u0436" * foreign + " " + "a" * (100 - foreign)
    findings, why = found(text, tables)
    assert (why is not None) == refused
    if refused:
        assert why.startswith(f"{foreign}% ") and found(text, tables, scripts=["Cyrillic"])[1] is None
        assert found(text, tables, kinds=["bidi"])[1] is None
    assert findings == []


def test_refused_texts_still_get_other_checks(tables):
    assert [f[0] for f in found("\u0436\u0436\u0436\u202e\uff26", tables)[0]] == ["bidi-control"]


def test_non_nfc(tables):
    assert [(f[2], f[3], f[4], f[6]) for f in found("ok\ncafe\u0301 e\u0301\n\u00e9", tables)[0]] == [(2, 4, 6, ["U+0065", "U+0301"])]
    assert "neither" in found("\u00e9e\u0301", tables)[0][0][9] and "NFD" in found("e\u0301", tables)[0][0][9]


def test_order_at_one_place(tables):
    got = found("\uff30\uff24\u6587 and enough letters in this line to keep the share below a tenth of all", tables)[0]
    assert [f[0] for f in got][:2] == ["confusable", "mixed-script"] and got[0][4] == got[1][4] == 0


def test_format_changes_no_finding_but_words_at_escapes(tables):
    text = '{"k\u200b": "\\n\u0430 \u202e", "p": [1, "p\u0430y"]}' + " x" * 60
    plain = [f[:5] + f[6:] for f in found(text, tables)[0]]
    for format in ("yaml", "toml", "ini", "env", "csv", "tsv"):
        assert [f[:5] + f[6:] for f in found(text, tables, format=format)[0]] == plain
    assert len(found(text, tables, format="json")[0]) == len(plain) - 2
    assert [f[5] for f in found(text, tables, format="json")[0]] == [None, "k\u200b", "p.[1]", "p.[1]"]


def test_declaring_adds_nothing_and_prefixes_agree(tables):
    rng = random.Random(5)
    pool = ["a", "b", "\u0430", "\u03bf", "\u6587", "\u202e", "\n", " ", "\u0301", "\U0001d41a", "_", "1", "\uff26", "\u200d"]
    for _ in range(150):
        text = "".join(rng.choice(pool) for _ in range(60)) + "plain text " * 30
        base = found(text, tables)
        more = found(text, tables, scripts=["Cyrillic", "Greek", "Han"])
        if base[1] is None:
            assert set(map(str, more[0])) <= set(map(str, base[0]))
        for f in base[0]:
            head = text.encode()[: f[4]].decode()
            assert f[2] == head.count("\n") + 1 and f[3] == len(head.rpartition("\n")[2].encode("utf-16-le")) // 2 + 1
            assert all(ord(c) < 128 for c in str(f[6:]))


SPANS = [
    ("json", '{"a": {"b": [1, "x"]}, "c": "y" /* "z" */, // 5\n}', ["a.b.[0]=1", "a.b.[1]=x", "c=y"]),
    ("json", '[{"k": "a\\"b"}, tru', ["[0].k=a\\\"b", "[1]=tru"]),
    ("json", '"open', ["=open"]),
    ("yaml", "a: 1\nitems:\n  - id: A\n    name: B\n  - C\n# no: 1\n---\nurl: http://x\n\"q\": 'z'\n", ["a=1", "items.[0].id=A", "items.[0].name=B", "items.[1]=C", "url=http://x", "q='z'"]),
    ("toml", 'a = 1\n[t]\n"k" = 2\n[[ u ]]\nx=y\n', ["a= 1", "t.k= 2", "u.x=y"]),
    ("ini", "; c\nurl = http://x\n[s]\nk: v\n=no\n", ["url= http://x", "s.k= v"]),
    ("env", "export A=1 # c\nB='x # y'\n#C=1\n =2\n", ["A=1", "B='x # y'"]),
    ("csv", 'id,,"n"\n1,"a,b",c,d\n\n', ["id=1", '[1]="a,b"', "n=c", "[3]=d"]),
    ("tsv", "id\tn\r\n1\tb\r\n", ["id=1", "n=b"]),
    ("text", "a=1", []),
]


@pytest.mark.parametrize("format,text,want", SPANS)
def test_key_spans(format, text, want):
    for wide in (text, text.replace("a", "\u00e9")):
        spans = key_spans(wide, format)
        assert [f"{p}={wide.encode()[a:b].decode()}" for a, b, p in spans] == [w.replace("a", "\u00e9") if wide != text else w for w in want]
        assert all(s[1] <= t[0] for s, t in zip(spans, spans[1:]))


def test_key_at_and_escapes():
    spans = [(2, 4, "a"), (6, 9, ""), (9, 12, "b")]
    assert [key_at(spans, i) for i in (0, 2, 3, 4, 6, 9, 12)] == [None, "a", "a", None, None, "b", None]
    assert json_escapes('"a\\n\\u0041" \\n "\\\u00e9"') == [(2, 4), (4, 10), (16, 19)]


def test_options(tables):
    assert parse_kind("mixed") == "mixed-script" and options(tables, scripts=["latn", "old-persian"]).scripts == ("Latin", "Old_Persian")
    for bad in ("Common", "zyyy", "Klingon"):
        with pytest.raises(ValueError):
            options(tables, scripts=[bad])
    assert [max_results(x) for x in (None, 1, 9999, 3.0)] == [500, 1, 5000, 3]
    for bad in (0, 1.5, "3", True, float("nan")):
        with pytest.raises(ValueError):
            max_results(bad)
    names = [(None, "src/a.JSON", "json"), (None, ".env", "env"), (None, "prod.env", "env"), (None, "x.json/notes", "text"), ("txt", "a.toml", "toml"), (" .YML ", "a.csv", "yaml"), (None, None, "text")]
    assert all(resolve_format(f, n) == want for f, n, want in names)
    assert typed("x", 5) == 5 and typed(1, 5, 3) == 3 and typed(["a"], []) == ["a"] and typed([1], ["b"]) == ["b"] and typed(True, False) is True


def test_time_is_linear_in_one_line(tables):
    def took(n):
        text = '{"' + "".join(f'k{i}": "\u200b", "' for i in range(n)) + '"}'
        best = 9
        for _ in range(3):
            t = time.perf_counter()
            examine(text, "json", options(tables), tables)
            best = min(best, time.perf_counter() - t)
        return best

    assert took(8000) <= 8 * max(took(2000), 0.01)


def test_slices_give_what_texts_give_alone(tables, monkeypatch):
    """Texts of all kinds and formats end to end, cut at several places, nulls and empty texts among them."""
    rng = random.Random(8)
    pool = ["a", "b c", "\u0430", "\u03bf", "\u6587", "\u202e", "\n", " ", "e\u0301", "\U0001d41a", "_", "1", "\uff26", "\u200d", "\ufeff", "\u0378", '{"k\u00e9": ["', '"]}', "\\n", "a=", "\r\n", "- x: ", "[s]"]
    formats = ["text", "json", "yaml", "env", "ini", "toml", "csv", "tsv"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) + " plain" * rng.randint(0, 40) for _ in range(300)] + [None, "", "\ufeff", "\ufeff\ufeffx", "\u0301"]
    named = [rng.choice(formats) for _ in texts]
    for kinds, scripts, size in (((), (), 1 << 20), ((), ("Cyrillic", "Han"), 700), (("bidi", "nfc"), (), 50), (("mixed", "confusable"), ("Greek",), 3000)):
        monkeypatch.setattr(kernel, "SLICE_BYTES", size)
        asked, got = options(tables, kinds, scripts), []
        column = pa.array(["out of sight", *texts])[1:]
        for lo, hi, held in slices(column, tables):
            bounds, columns, refused = examine_texts(held, named[lo:hi], asked)
            rows = list(zip(*(c.to_pylist() for c in columns), strict=True))
            got += [(rows[a:b], refused.get(d)) for d, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))]
        assert got == [examine(t or "", f, asked, tables) for t, f in zip(texts, named, strict=True)]


def test_bytes_that_are_not_utf8_are_replaced(tables):
    column = pa.array([b"a\xff\xe2\x80\xaeb", "\u202ex".encode()]).view(pa.string())
    (_, _, held), = slices(column, tables)
    bounds, columns, _ = examine_texts(held, ["text", "text"], options(tables, ["bidi"]))
    assert bounds.tolist() == [0, 1, 2] and columns[4].to_pylist() == [4, 0]
