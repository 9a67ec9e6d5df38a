"""The registered queries in DuckDB's SQL, worked out by other means: a row for each character, and windows over them."""

from __future__ import annotations

from .planted import REQUESTS, planted_sql

# The planted characters of each kind, and what the planted look-alikes imitate.
KIND = """CASE WHEN cp IN (1564, 8234, 8235, 8236, 8237, 8238, 8294, 8295, 8296, 8297) THEN 'bidi-control'
 WHEN cp IN (173, 6158, 8203, 8204, 8205, 8288, 65279) THEN 'invisible'
 WHEN cp IN (160, 5760, 8239, 8287, 12288) OR cp BETWEEN 8192 AND 8202 THEN 'unusual-whitespace'
 WHEN cp BETWEEN 57344 AND 63743 {unassigned} THEN 'unassigned-or-private-use' END"""
SEVERITY = "CASE kind WHEN 'bidi-control' THEN 'high' WHEN 'unusual-whitespace' THEN 'low' ELSE 'medium' END"
MAP = "(1072, 97), (1077, 101), (1086, 111), (1091, 121)"


def chars(id_col: str = "doc_id", table: str = "documents", text: str = "text", more: tuple[str, ...] = ("lang", "source"), rows: str | None = None, unassigned: bool = False) -> str:
    """WITH ... haz (id, ch, cp, pos, kind, severity) of every character of texts that are not ASCII alone."""
    kind = KIND.format(unassigned="OR cp = 888" if unassigned else "")
    own = ", ".join((id_col, *more))
    return f"""WITH p AS ({rows or planted_sql(table, id_col, text, more)}),
l AS (SELECT {own}, string_split(text, '') AS cs, row_number() OVER () AS r FROM p WHERE regexp_matches(text, '[^\\x00-\\x7F]')),
c AS (SELECT {own}, r, unnest(cs) AS ch, generate_subscripts(cs, 1) AS pos FROM l),
k AS (SELECT *, unicode(ch) AS cp FROM c),
t AS (SELECT *, {kind} AS kind FROM k),
haz AS (SELECT *, {SEVERITY} AS severity, printf('U+%04X', cp) AS codepoint FROM t WHERE kind IS NOT NULL AND NOT (pos = 1 AND cp = 65279))"""


def places(**how) -> str:
    """chars() with spot: offset, line and UTF-16 column of every character."""
    key = how.get("id_col", "doc_id")
    return (
        chars(**how)
        + f""",
w AS (SELECT *, CASE WHEN cp > 65535 THEN 2 ELSE 1 END AS u, printf('U+%04X', cp) AS codepoint FROM t),
x AS (SELECT *, coalesce(sum(strlen(ch)) OVER prev, 0) AS byte_at, coalesce(sum(u) OVER prev, 0) AS unit_at, 1 + coalesce(sum(CASE WHEN cp = 10 THEN 1 ELSE 0 END) OVER prev, 0) AS ln
  FROM w WINDOW prev AS (PARTITION BY {key}, r ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
spot AS (SELECT *, CAST(byte_at AS BIGINT) AS "offset", CAST(ln AS BIGINT) AS line, CAST(unit_at - min(unit_at) OVER (PARTITION BY {key}, r, ln) + 1 AS BIGINT) AS "column", {SEVERITY} AS severity FROM x),
found AS (SELECT * FROM spot WHERE kind IS NOT NULL AND NOT (pos = 1 AND cp = 65279))"""
    )


SHARE = """,
letters AS (SELECT doc_id, CAST(len(regexp_extract_all(text, '\\p{L}')) AS BIGINT) AS letters, CAST(len(regexp_extract_all(text, '\\p{Cyrillic}')) AS BIGINT) AS n FROM p),
shares AS (SELECT *, n * 100 // greatest(letters, 1) AS share FROM letters WHERE n > 0),
refused AS (SELECT * FROM shares WHERE share >= 10)"""

WORDS = (
    SHARE
    + """,
marked AS (SELECT *, regexp_matches(ch, '[\\p{L}\\p{N}_]') OR cp IN (769, 770, 8204, 8205) AS inside FROM spot WHERE doc_id NOT IN (SELECT doc_id FROM refused)),
islands AS (SELECT *, sum(CASE WHEN inside THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island FROM marked),
judged AS (SELECT *, bool_or(regexp_matches(ch, '\\p{Cyrillic}')) OVER (PARTITION BY doc_id, island) AND bool_or(regexp_matches(ch, '\\p{Latin}')) OVER (PARTITION BY doc_id, island) AS mixed FROM islands WHERE inside),
odd AS (SELECT doc_id, island, cp, min(pos) AS first FROM judged WHERE mixed AND cp > 127 GROUP BY ALL),
mixed AS (SELECT doc_id, min(line) AS line, min("offset") AS "offset", arg_min("column", pos) AS "column", island FROM judged WHERE mixed GROUP BY doc_id, island),
mixed_words AS (SELECT m.doc_id, m.line, m."column", m."offset", (SELECT string_agg(printf('U+%04X', o.cp), ' ' ORDER BY o.first) FROM odd o WHERE o.doc_id = m.doc_id AND o.island = m.island) AS codepoint FROM mixed m),
alike AS (SELECT j.doc_id, j.line, j."column", j."offset", j.codepoint, printf('U+%04X', v.plain) AS resembles, 'Cyrillic' AS scripts FROM judged j JOIN (VALUES """
    + MAP
    + """) v(cp, plain) ON j.cp = v.cp WHERE j.mixed
 UNION ALL SELECT doc_id, line, "column", "offset", codepoint, 'U+0066', 'Latin' FROM judged WHERE cp = 65350
 UNION ALL SELECT doc_id, line, "column", "offset", codepoint, 'U+0061', 'Common' FROM judged WHERE cp = 119834)"""
)

LINES = """,
pairs AS (SELECT *, lead(cp) OVER (PARTITION BY doc_id ORDER BY pos) AS after,
  bool_or(regexp_matches(ch, '[\\x{C0}-\\x{C5}\\x{C7}-\\x{CF}\\x{D1}-\\x{D6}\\x{D9}-\\x{DD}\\x{E0}-\\x{E5}\\x{E7}-\\x{EF}\\x{F1}-\\x{F6}\\x{F9}-\\x{FD}\\x{FF}]')) OVER (PARTITION BY doc_id, line) AS composed FROM spot),
split AS (SELECT * FROM pairs WHERE after IN (769, 770)),
lines AS (SELECT doc_id, line, min("offset") AS "offset", arg_min("column", pos) AS "column", CASE WHEN bool_or(composed) THEN 'neither NFC nor NFD' ELSE 'NFD' END AS form, arg_min(codepoint || ' ' || printf('U+%04X', after), pos) AS codepoints FROM split GROUP BY doc_id, line)"""

ALL = (
    places(unassigned=True)
    + WORDS
    + LINES
    + """,
every AS (SELECT doc_id, kind, severity FROM found UNION ALL SELECT doc_id, 'mixed-script', 'high' FROM mixed_words UNION ALL SELECT doc_id, 'confusable', 'high' FROM alike UNION ALL SELECT doc_id, 'non-nfc', 'low' FROM lines),
per AS (SELECT doc_id, count(*) AS n, count(*) FILTER (kind = 'bidi-control') AS bidi FROM every GROUP BY doc_id),
files AS (SELECT p.doc_id, coalesce(n, 0) AS n_findings, coalesce(bidi, 0) AS n_bidi, CASE WHEN p.doc_id IN (SELECT doc_id FROM refused) THEN 1 ELSE 0 END::BIGINT AS n_refusals, false AS unexamined FROM p LEFT JOIN per ON p.doc_id = per.doc_id),
run AS (SELECT 1::INTEGER AS schema, count(*) AS files, sum(n_findings)::BIGINT AS findings, sum(n_bidi)::BIGINT AS bidi, sum(n_refusals)::BIGINT AS refusals, 0::BIGINT AS unexamined FROM files)"""
)


# what a planted character's finding says, and its rank among those of one place
DETAIL = """CASE cp WHEN 8238 THEN 'right-to-left override' WHEN 8294 THEN 'left-to-right isolate' WHEN 8203 THEN 'zero width space' WHEN 65279 THEN 'zero width no-break space' WHEN 173 THEN 'soft hyphen'
 WHEN 160 THEN 'no-break space' WHEN 12288 THEN 'ideographic space' WHEN 888 THEN 'unassigned' ELSE 'private use' END || CASE kind WHEN 'bidi-control' THEN ': reorders how the line is shown, so what is read is not what is there'
 WHEN 'invisible' THEN ': has no width, so texts that differ look the same' WHEN 'unusual-whitespace' THEN ': looks like a space and is not U+0020' ELSE CASE cp WHEN 888 THEN ': no character has this code point' ELSE ': what it means is agreed nowhere' END END"""
RANK = "CASE kind WHEN 'bidi-control' THEN 0 WHEN 'invisible' THEN 1 WHEN 'unusual-whitespace' THEN 5 ELSE 6 END"
WHOLE = (
    ALL
    + f""",
said AS (SELECT doc_id, "offset", line, "column", {RANK} AS rank, kind, severity, codepoint, CASE kind WHEN 'unassigned-or-private-use' THEN 'Unknown' ELSE 'Common' END AS scripts, '' AS resembles, {DETAIL} AS detail FROM found
 UNION ALL SELECT doc_id, "offset", line, "column", 3, 'mixed-script', 'high', codepoint, 'Cyrillic Latin', '', 'one word in Cyrillic and Latin: no single script accounts for it' FROM mixed_words
 UNION ALL SELECT doc_id, "offset", line, "column", 2, 'confusable', 'high', codepoint, scripts, resembles, CASE scripts WHEN 'Cyrillic' THEN 'a Cyrillic character in a word that is not Cyrillic, and it looks like the code point under resembles'
  ELSE 'a compatibility form of an ASCII character: it reads as the code point under resembles and does not equal it' END FROM alike
 UNION ALL SELECT doc_id, "offset", line, "column", 4, 'non-nfc', 'low', codepoints, '', '', 'the line is in ' || form || ', not NFC: it compares unequal to the same text in NFC' FROM lines),
numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY "offset", rank) - 1 AS INTEGER) AS seq FROM said),
why AS (SELECT doc_id, 'intentional_script_context' AS reason, share || '% of the letters are Cyrillic, and no script was declared: the confusable and mixed-script checks did not run; every other check did' AS detail FROM refused)"""
)


def _list(column: str) -> str:
    return f"""'["' || replace({column}, ' ', '","') || '"]'"""


def _some(name: str) -> str:
    return f"""CASE {name} WHEN '' THEN '' ELSE '"{name}":' || {_list(name)} || ',' END"""


JSON = f"""'{{"kind":"' || kind || '","severity":"' || severity || '","line":' || line || ',"column":' || "column" || ',"offset":' || "offset" || ',"codepoints":' || {_list("codepoint")} || ',' || {_some("scripts")} || {_some("resembles")} || '"detail":"' || detail || '"}}'"""
SORTED = f"""'{{"codepoints":' || {_list("codepoint")} || ',"column":' || "column" || ',"detail":"' || detail || '","kind":"' || kind || '","line":' || line || ',"offset":' || "offset" || ',' || {_some("resembles")} || {_some("scripts")} || '"severity":"' || severity || '"}}'"""
ITEM = """'- **' || severity || '** ' || kind || ' ' || codepoint || ' at ' || line || ':' || "column" || ': ' || detail"""


def _per_file(item: str, between: str, most: int = 1 << 30) -> str:
    """WITH ... each (doc_id, items, n_findings, n_bidi, n_refusals, reason, detail) of every document."""
    return WHOLE + f""",
items AS (SELECT doc_id, string_agg({item}, '{between}' ORDER BY seq) AS items FROM numbered WHERE seq < {most} GROUP BY doc_id),
each AS (SELECT f.*, coalesce(items, '') AS items, reason, detail FROM files f LEFT JOIN items USING (doc_id) LEFT JOIN why USING (doc_id))"""


def _kind(kind: str) -> str:
    return places() + f"""\nSELECT doc_id, line, "column", "offset", codepoint FROM found WHERE kind = '{kind}'"""


def _other(table: str, id_col: str, text: str) -> str:
    return chars(id_col, table, text, (), unassigned=True) + f"\nSELECT {id_col}, kind, count(*) AS n FROM haz GROUP BY ALL"


def _values(rows, *columns: str) -> str:
    shown = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(shown, r)) + ")" for r in rows) + f") v({', '.join(columns)})"


OPTIONS = [("kind", repr(n), full) for full, short in (("bidi-control", "bidi"), ("invisible", "invisible"), ("confusable", "confusable"), ("mixed-script", "mixed"), ("non-nfc", "nfc"), ("unusual-whitespace", "whitespace"), ("unassigned-or-private-use", "unassigned")) for n in (full, short)]
OPTIONS += [("kind", "'homoglyph'", "refused"), ("script", "'cyrl'", "Cyrillic"), ("script", "'Han'", "Han"), ("script", "'old-persian'", "Old_Persian"), ("script", "'Zyyy'", "refused"), ("script", "'Klingon'", "refused"), ("script", "' GREEK '", "Greek")]
OPTIONS += [("results", "None", "500"), ("results", "1", "1"), ("results", "9999", "5000"), ("results", "3.0", "3"), ("results", "0", "refused"), ("results", "2.5", "refused"), ("results", "'7'", "refused"), ("results", "True", "refused")]
OPTIONS += [("gate", "('any', ())", "any"), ("gate", "('bidi', ('bidi-control',))", "bidi"), ("gate", "('bidi', ('invisible',))", "refused"), ("gate", "('all', ())", "refused")]
OPTIONS += [("setting", "(5, 1, 10)", "10"), ("setting", "('x', 7)", "7"), ("setting", "(True, 1)", "1"), ("setting", "([1], ['a'])", "['a']"), ("setting", "(['b'], [])", "['b']")]
OPTIONS += [("format", "('jsonc', 'a.txt')", "json"), ("format", "('plaintext', '.env')", "env"), ("format", "(None, 'b.yml')", "yaml"), ("format", "('latex', 'c')", "text")]
_SAID = [(None, "-32700", None, None)] * 3 + [("2", "-32601", None, None), ("3", None, None, None), (None,) * 4, (None,) * 4, ("4", "-32602", None, None)]
_SAID += [("5", None, "true", "content"), ("6", None, "true", "maxResults"), ("7", None, "true", "unknown kind"), ("8", None, "true", "content"), ("9", None, "false", "")]

# sixteen customers a document: where each item begins
_TREE = """WITH items AS (SELECT c_custkey // 16 AS doc_id, c_custkey AS k, length(CAST(c_custkey AS VARCHAR)) AS i, length(c_name) AS x, length(c_mktsegment) AS m FROM customer),
placed AS (SELECT *, row_number() OVER w - 1 AS nth, coalesce(sum({size}) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + {base} AS a FROM items WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
spans AS ({spans}) SELECT doc_id, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end", path FROM spans"""
_GROUP = "length(CAST(doc_id AS VARCHAR))"
_JSON_TREE = _TREE.format(size="7 + i + 12 + x + 4 + m + 3 + 2", base=f"12 + {_GROUP} + 17", spans=f"""SELECT DISTINCT doc_id, 11 AS start, 12 + {_GROUP} AS "end", 'group' AS path FROM placed
 UNION ALL SELECT doc_id, a + 7, a + 7 + i, 'customers.[' || nth || '].id' FROM placed
 UNION ALL SELECT doc_id, a + 19 + i, a + 19 + i + x, 'customers.[' || nth || '].tags.[0]' FROM placed
 UNION ALL SELECT doc_id, a + 23 + i + x, a + 23 + i + x + m, 'customers.[' || nth || '].tags.[1]' FROM placed""")
_TABLE = _TREE.format(size="i + 1 + x + 5 + 1 + m + 1", base="8", spans="""SELECT doc_id, a AS start, a + i AS "end", 'id' AS path FROM placed
 UNION ALL SELECT doc_id, a + i + 1, a + i + 6 + x, 'name' FROM placed UNION ALL SELECT doc_id, a + i + x + 7, a + i + x + 7 + m, '[2]' FROM placed""")
_OUT = "(lower(p_type) = 'promo' OR p_size % 3 = 0 OR (p_size % 3 = 1 AND starts_with(p_name, 'large ')) OR (p_size % 5 = 0 AND p_partkey % 10 <> 9))"
_STATES = """WITH c AS (SELECT doc_id, strlen(text) AS n, doc_id % 6 AS k FROM documents), sized AS (SELECT *, n + CASE k WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 1 WHEN 3 THEN 5 WHEN 4 THEN 4 ELSE 0 END AS bytes FROM c),
states AS (SELECT CAST(doc_id AS VARCHAR) AS file, CASE WHEN bytes > 2000 THEN 'too-large' WHEN k IN (1, 5) THEN 'read' ELSE 'not-text' END AS state, CASE WHEN bytes <= 2000 AND k IN (1, 5) THEN bytes END AS text_bytes FROM sized)"""


_X, _M = "length(c_name)", "length(c_mktsegment)"


def _spans(*rows: tuple[str, str, str]) -> str:
    return "\nUNION ALL ".join(f"""SELECT c_custkey AS doc_id, CAST({a} AS BIGINT) AS start, CAST({b} AS BIGINT) AS "end", '{path}' AS path FROM customer""" for a, b, path in rows)


def _tree(path: str) -> str:
    n = "length(event_type)"
    rows = (("9", "bidi-control", "a.[0]"), (f"17 + {n}", "invisible", "a.[1]"), (f"36 + {n}", "unusual-whitespace", "b.c"))
    return "\nUNION ALL ".join(f"""SELECT event_id, CAST({at} AS BIGINT) AS "offset", '{kind}' AS kind, '{key}' AS {path} FROM events""" for at, kind, key in rows)


ESCAPED = """array_to_string(list_transform(string_split(text, ''), lambda c: CASE WHEN unicode(c) < 128 THEN c WHEN unicode(c) < 65536 THEN printf('\\u%04X', unicode(c))
 ELSE printf('\\u%04X\\u%04X', 55296 + ((unicode(c) - 65536) >> 10), 56320 + ((unicode(c) - 65536) & 1023)) END), '')"""

ORACLE_SQL: dict[str, str] = {
    "hazard_kind_counts": chars(unassigned=True) + "\nSELECT kind, severity, count(*) AS n FROM haz GROUP BY ALL",
    "hazard_by_codepoint": chars(unassigned=True) + "\nSELECT codepoint, kind, count(*) AS n, count(DISTINCT doc_id) AS docs FROM haz GROUP BY ALL",
    "hazard_severity_by_source": chars(unassigned=True) + "\nSELECT source, severity, count(*) AS n FROM haz GROUP BY ALL",
    "hazard_by_lang_rollup": chars(unassigned=True) + "\nSELECT lang, kind, count(*) AS n FROM haz GROUP BY ROLLUP (lang, kind)",
    "hazard_labels_join": chars(unassigned=True) + "\nSELECT quality, toxic, count(*) AS docs, CAST(sum(n) AS BIGINT) AS hazards FROM (SELECT doc_id, count(*) AS n FROM haz GROUP BY doc_id) JOIN labels USING (doc_id) GROUP BY ALL",
    "bidi_findings": _kind("bidi-control"),
    "invisible_findings": _kind("invisible"),
    "whitespace_findings": _kind("unusual-whitespace"),
    "private_use_findings": _kind("unassigned-or-private-use"),
    "finding_positions": places(unassigned=True) + '\nSELECT doc_id, line, "column", "offset", codepoint, kind, severity FROM found',
    "unassigned_findings": places(unassigned=True) + """\nSELECT doc_id, line, "column", "offset", codepoint, kind, severity, 'Unknown' AS scripts FROM found WHERE kind = 'unassigned-or-private-use'""",
    "kind_filter": chars() + "\nSELECT kind, severity, count(*) AS n FROM haz WHERE kind IN ('bidi-control', 'unusual-whitespace') GROUP BY ALL",
    "all_kinds": ALL + "\nSELECT kind, severity, count(*) AS n FROM every GROUP BY ALL",
    "letter_survey": chars() + SHARE + "\nSELECT doc_id, letters, 'Cyrillic' AS script, n FROM shares",
    "foreign_share": chars() + SHARE + "\nSELECT doc_id, letters, n AS undeclared, 'Cyrillic' AS scripts, share, share >= 10 AS refused FROM shares",
    "scripts_except": chars() + SHARE + "\nSELECT doc_id, 'Cyrillic' AS scripts, share FROM shares",
    "script_context_refusals": chars() + SHARE + "\nSELECT doc_id, 'intentional_script_context' AS reason, share FROM refused",
    "refusals_with_declared": chars() + SHARE + "\nSELECT 'Greek' AS declared, 'intentional_script_context' AS reason, count(*) AS n FROM refused",
    "mixed_script_words": places() + WORDS + """\nSELECT doc_id, line, "column", "offset", codepoint, 'mixed-script' AS kind, 'high' AS severity, 'Cyrillic Latin' AS scripts FROM mixed_words""",
    "mixed_script_declared": places() + "\nSELECT 'confusable' AS kind, codepoint, count(*) AS n FROM spot WHERE cp IN (65350, 119834) GROUP BY ALL",
    "confusables": places() + WORDS + "\nSELECT * FROM alike",
    "non_nfc_lines": places() + LINES + '\nSELECT doc_id, line, "offset", form, codepoints FROM lines',
    "resolve_format": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'json' ELSE CASE doc_id % 10 WHEN 0 THEN 'json' WHEN 1 THEN 'env' WHEN 2 THEN 'yaml' WHEN 3 THEN 'ini' WHEN 5 THEN 'env' WHEN 6 THEN 'tsv' WHEN 8 THEN 'ini' ELSE 'text' END END AS reader FROM documents",
    "dotenv_keys": _spans(("20", f"21 + {_X}", "NAME"), (f"33 + {_X}", f"40 + {_X} + {_M}", "SEG")),
    "ini_keys": _spans(("20", f"21 + {_X}", "buyer.name"), (f"26 + {_X}", f"27 + {_X} + {_M}", "buyer.url")),
    "toml_keys": _spans(("5", "7", "top"), ("28", f"29 + {_X}", "buyer.name")),
    "csv_keys": _spans(("13", f"13 + {_X}", "name"), (f"14 + {_X}", f"19 + {_X}", "[1]"), (f"20 + {_X}", f"20 + {_X} + {_M}", "seg")),
    "yaml_keys": _spans(("15", f"15 + {_X}", "items.[0].id"), (f"25 + {_X}", f"33 + {_X}", "items.[0].url"), (f"38 + {_X}", f"38 + {_X} + {_M}", "items.[1]")),
    "json_keys": """SELECT event_id, CAST(6 AS BIGINT) AS start, CAST(length(props) - 1 AS BIGINT) AS "end", 'k' AS path FROM events""",
    "key_at_offset": _tree("key"),
    "key_join": _tree("path"),
    "file_summary": ALL + "\nSELECT * FROM files",
    "run_summary": ALL + "\nSELECT * FROM run",
    "gate_exit_codes": ALL + "\nSELECT (findings > 0)::INTEGER AS any_lenient, CASE WHEN refusals > 0 THEN 2 ELSE (findings > 0)::INTEGER END AS any_strict, (bidi > 0)::INTEGER AS bidi_lenient, CASE WHEN refusals > 0 THEN 2 ELSE (bidi > 0)::INTEGER END AS bidi_strict FROM run",
    "summary_line": ALL + "\nSELECT findings || ' findings in ' || files || ' files' || CASE WHEN refusals = 0 THEN '' ELSE ', ' || refusals || ' refused (0 not read at all)' END AS line FROM run",
    "top_findings_capped": places(unassigned=True) + '\nSELECT doc_id, "offset", kind, n_found, n_found > 5 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "offset") AS nth, count(*) OVER (PARTITION BY doc_id) AS n_found FROM found) WHERE nth <= 5',
    "results_cap_across_files": places(unassigned=True) + '\nSELECT doc_id, "offset", kind, place FROM (SELECT *, row_number() OVER (ORDER BY doc_id, "offset") AS place FROM found) WHERE place <= 1000',
    "ascii_escape": f"SELECT doc_id, {ESCAPED} AS escaped FROM ({planted_sql()})",
    "human_lines": places() + """\nSELECT doc_id, 'd\\u00E9/' || doc_id || ':' || line || ':' || "column" || '  [high] bidi-control ' || codepoint || '  ' || """ + DETAIL + """ AS line FROM found WHERE kind = 'bidi-control'""",
    "problem_markers": places() + """\nSELECT doc_id, line - 1 AS line, "column" - 1 AS start, "column" AS "end", 'warning' AS level FROM found WHERE kind IN ('bidi-control', 'unusual-whitespace')""",
    "decode_or_refuse": """SELECT doc_id, CASE WHEN doc_id % 6 IN (0, 4) THEN 'encoding_unknown' WHEN doc_id % 6 IN (2, 3) THEN 'binary_or_undecodable' END AS reason,
 CASE doc_id % 6 WHEN 0 THEN 'starts with a byte order mark of UTF-16LE' WHEN 2 THEN 'not UTF-8' WHEN 3 THEN 'a NUL at byte 4' WHEN 4 THEN 'starts with a byte order mark of UTF-32BE' END AS refusal,
 CASE doc_id % 6 WHEN 1 THEN strlen(text) + 3 WHEN 5 THEN strlen(text) END AS text_bytes FROM documents""",
    "first_invalid_bytes": 'SELECT doc_id, strlen(text) AS "at" FROM documents',
    "pages_hazards": _other("pages", "page_id", "html"),
    "conversations_hazards": _other("conversations", "conv_id", "text"),
    "benchmark_hazards": _other("benchmark", "item_id", "text"),
    "findings_in_order": WHOLE + '\nSELECT doc_id, seq, kind, "offset", codepoint, scripts, resembles, detail FROM numbered',
    "json_report": _per_file(JSON, ",") + """\nSELECT doc_id, '{"file":"' || doc_id || '","findings":[' || items || '],"refusals":[' || CASE WHEN reason IS NULL THEN '' ELSE '{"reason":"' || reason || '","detail":"' || detail || '"}' END || '],"summary":{"findings":' || n_findings || ',"bidi":' || n_bidi || ',"refusals":' || n_refusals || '}}' AS json FROM each""",
    "markdown_report": _per_file(ITEM, "\n") + """\nSELECT doc_id, '## `' || doc_id || '`\n' || CASE items WHEN '' THEN '' ELSE '\n' || items END || CASE WHEN reason IS NULL THEN '' ELSE '\n- refused: ' || reason || ': ' || detail END AS section FROM each WHERE n_findings > 0 OR n_refusals > 0""",
    "reply_envelopes": _per_file(SORTED, ",", 500) + """\nSELECT doc_id, '{"data":{"findings":[' || items || '],"refusals":[' || CASE WHEN reason IS NULL THEN '' ELSE '{"detail":"' || detail || '","reason":"' || reason || '"}' END || ']},"diagnostics":[' || CASE WHEN reason IS NULL THEN '' ELSE '{"code":"' || reason || '","message":"' || detail || '","severity":"warning"}' END || '],"meta":{"count":' || least(n_findings, 500) || ',"tool":"screen","truncated":' || (n_findings > 500) || '},"ok":true}' AS reply FROM each""",
    "refusal_lines": WHOLE + "\nSELECT doc_id, 'd/' || doc_id || ': ' || detail AS line FROM why",
    "header_totals": ALL + "\nSELECT CAST(sum(n_findings) AS BIGINT) AS findings, count(*) AS files, count(*) FILTER (n_refusals > 0) AS refused FROM files",
    "report_header": ALL + """\nSELECT '# Screening report\n\n' || CAST(sum(n_findings) AS BIGINT) || ' findings in ' || count(*) || ' files; ' || count(*) FILTER (n_refusals > 0) || ' files not judged in full.\n\n> Characters are written as code points and never as themselves.'
 || CASE WHEN sum(n_findings) = 0 AND count(*) FILTER (n_refusals > 0) = 0 THEN '\n\nNothing was found. That clears no text of what the tables do not know.' ELSE '' END AS header FROM files""",
    "json_tree_keys": _JSON_TREE,
    "csv_table_keys": _TABLE,
    "tsv_table_keys": _TABLE,
    "crlf_keys": _spans(("2", f"2 + {_X}", "A"), (f"7 + {_X}", f"8 + {_X} + {_M}", "B")),
    "escaped_words": "SELECT kind, count(*) AS n, 'text' AS format FROM customer, (VALUES ('mixed-script'), ('confusable')) v(kind) GROUP BY kind",
    "ignored_paths": f"SELECT p_partkey, {_OUT} AS ignored FROM part",
    "editor_listing": f"""SELECT p_partkey, CASE WHEN lower(p_type) = 'promo' AND p_size % 3 = 2 AND starts_with(p_name, 'cold ') AND p_size % 5 IN (3, 4) THEN 'listed'
 WHEN p_size % 3 = 0 OR p_size % 5 IN (1, 2) OR starts_with(p_name, 'small ') THEN 'left-out' WHEN {_OUT} THEN 'ignored' ELSE 'listed' END AS state FROM part""",
    "editor_states": _STATES + " SELECT * FROM states",
    "scan_counters": _STATES + " SELECT count(*) FILTER (state = 'read') AS read, count(*) FILTER (state = 'too-large') AS too_large, count(*) FILTER (state = 'not-text') AS not_text, 0::BIGINT AS unreadable, 3::BIGINT AS ignored, false AS limit_reached FROM states",
    "option_values": _values(OPTIONS, "what", "given", "result"),
    "request_errors": _values([(v, *said) for v, said in zip(REQUESTS, _SAID, strict=True)], "value", "id", "code", "failed", "about"),
    "request_replies": places(unassigned=True)
    + """,
nth AS (SELECT doc_id, "offset", row_number() OVER (PARTITION BY doc_id ORDER BY "offset") AS nth FROM found WHERE kind IN ('bidi-control', 'unusual-whitespace')),
few AS (SELECT doc_id, count(*) AS n, max("offset") FILTER (nth = 3) AS third FROM nth GROUP BY doc_id)
SELECT p.doc_id, 'false' AS failed, 'true' AS ok, least(coalesce(n, 0), 3) AS count, CASE WHEN n > 3 THEN 'true' ELSE 'false' END AS truncated, third, false AS raw FROM p LEFT JOIN few USING (doc_id)""",
    "sanitised_errors": "SELECT c_custkey, 'at /home/***/x (token=*** of C:\\Users\\*** api-key: ***' AS message FROM customer",
    "sql_escapes": "SELECT c_custkey AS doc_id, 7::BIGINT AS start, 9::BIGINT AS \"end\" FROM customer",
    "sql_scalars": "SELECT doc_id, printf('U+%04X', doc_id + 65) AS rendered, '\\u00E9' || doc_id AS escaped, CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS single, reader FROM ({resolve}) r",
}
for _name, _same in (("stream_findings", "finding_positions"), ("sql_findings", "finding_positions"), ("sql_keys", "json_keys")):
    ORACLE_SQL[_name] = ORACLE_SQL[_same]
ORACLE_SQL["sql_scalars"] = ORACLE_SQL["sql_scalars"].format(resolve=ORACLE_SQL["resolve_format"])
