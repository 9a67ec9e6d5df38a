"""The examination of texts, on arrays of code points.

Texts are taken by slices: their code points end to end. What is asked of every
code point is asked of a whole slice at once; Python goes over words that hold
foreign letters, lines that may not be in NFC and structured texts alone.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa

from ..functions.options import FOREIGN_PERCENT, Options
from ..functions.ucd import ALPHABETIC, COMBINING, COMMON, HAZARDS, INHERITED, LATIN, RANK, RESHAPED, SEVERITY, UNKNOWN, WORD, Tables
from .keypaths import escape_spans, keys_of

SLICE_BYTES = 1 << 20
FIELDS = ("kind", "severity", "line", "column", "offset", "key", "codepoints", "scripts", "resembles", "detail")


def render(cp: int) -> str:
    return f"U+{cp:04X}"


def named(names: list[str]) -> str:
    """A; A and B; A, B and C."""
    return names[0] if len(names) == 1 else f"{', '.join(names[:-1])} and {names[-1]}"


_WHY = {
    "bidi-control": "reorders how the line is shown, so what is read is not what is there",
    "invisible": "has no width, so texts that differ look the same",
    "unusual-whitespace": "looks like a space and is not U+0020",
}


def hazard_detail(kind: str, cp: int) -> str:
    if kind in _WHY:
        return f"{unicodedata.name(chr(cp), render(cp)).lower()}: {_WHY[kind]}"
    return "private use: what it means is agreed nowhere" if 0xE000 <= cp <= 0xF8FF or cp >= 0xF0000 else "unassigned: no character has this code point"


class Texts:
    """Some texts' code points end to end, where each begins, and what follows from them; everything else is asked for when needed."""

    def __init__(self, points: np.ndarray, firsts: np.ndarray, text: Callable[[int], str], tables: Tables):
        self.points, self.firsts, self.text, self.t = points, firsts, text, tables
        self.script = tables.script[points]
        self.flags = tables.flags[points]
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        self.bytes = np.concatenate([[0], np.cumsum(width)])

    def __len__(self) -> int:
        return len(self.firsts) - 1

    def owner(self, at: np.ndarray) -> np.ndarray:
        """The text of each code point."""
        return np.searchsorted(self.firsts, at, "right") - 1

    def offsets(self, at: np.ndarray) -> np.ndarray:
        """Byte offsets within a text."""
        return self.bytes[at] - self.bytes[self.firsts[self.owner(at)]]

    def positions(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Line and UTF-16 column of code points; only a line feed ends a line."""
        feeds = np.flatnonzero(self.points == 10)
        units = np.concatenate([[0], np.cumsum(1 + (self.points >= 0x10000).astype(np.int64))])
        start = self.firsts[self.owner(at)]
        before, whole = np.searchsorted(feeds, start), np.searchsorted(feeds, at)
        begin = np.where(whole > before, np.concatenate([[-1], feeds])[whole] + 1, start)
        return whole - before + 1, units[at] - units[begin] + 1


class Text(Texts):
    """One text."""

    def __init__(self, text: str, tables: Tables):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        super().__init__(points, np.array([0, len(points)]), lambda _: text, tables)


def slices(column: pa.Array, tables: Tables) -> Iterator[tuple[int, int, Texts]]:
    """(first row, end row, texts) of about SLICE_BYTES of a string column, or one text if that is longer; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = memoryview(data) if data is not None else memoryview(b"")
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + SLICE_BYTES, "right")) - 1)
        own, edges = bytes(raw[offs[row] : offs[end]]), offs[row : end + 1] - offs[row]
        try:
            points = np.frombuffer(own.decode().encode("utf-32-le"), np.uint32)
            firsts = np.concatenate([[0], np.cumsum((np.frombuffer(own, np.uint8) & 0xC0) != 0x80)])[edges]
            text = lambda d, own=own, edges=edges: own[edges[d] : edges[d + 1]].decode()
        except UnicodeDecodeError:  # what is not UTF-8 becomes U+FFFD
            each = [own[a:b].decode(errors="replace") for a, b in zip(edges[:-1], edges[1:], strict=True)]
            points = np.frombuffer("".join(each).encode("utf-32-le"), np.uint32)
            firsts, text = np.cumsum([0, *map(len, each)]), each.__getitem__
        yield row, end, Texts(points, firsts, text, tables)
        row = end


def surveys(x: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(letters of each text; text, script and number of letters of each script in it but Latin and the values that are no scripts)."""
    letter = (x.flags & ALPHABETIC) > 0
    total = np.concatenate([[0], np.cumsum(letter)])
    at = np.flatnonzero(letter & (x.script > LATIN))
    both, n = np.unique(x.owner(at) * 256 + x.script[at], return_counts=True)
    return np.diff(total[x.firsts]), both // 256, both % 256, n


def survey(x: Text) -> tuple[int, dict[str, int]]:
    """Letters of one text, and those of each script."""
    letters, _, script, n = surveys(x)
    return int(letters[0]), {x.t.scripts[s]: k for s, k in zip(script.tolist(), n.tolist(), strict=True)}


def contexts(x: Texts, declared: tuple[str, ...]) -> dict[int, str]:
    """Why the script checks can't be made, of texts where undeclared scripts hold a tenth of the letters."""
    letters, own, script, n = surveys(x)
    open_ = np.array([s not in declared for s in x.t.scripts])[script]
    own, script, n = own[open_], script[open_], n[open_]
    found = np.zeros(len(x), np.int64)
    np.add.at(found, own, n)
    share = found * 100 // np.maximum(letters, 1)
    said = "none of those was declared" if declared else "no script was declared"
    out = {}
    for d in np.flatnonzero((found > 0) & (share >= FOREIGN_PERCENT)).tolist():
        names = sorted(x.t.scripts[s] for s in script[own == d].tolist())
        out[d] = f"{share[d]}% of the letters are {named(names)}, and {said}: the confusable and mixed-script checks did not run; every other check did"
    return out


def is_single_script(points: np.ndarray, t: Tables) -> bool:
    return reduce(int.__and__, (t.sets[i] for i in np.unique(t.extension[points])), -1) != 0


class Drafts:
    """Findings before they are in order: where, and which of the things said. What is said of many is made once."""

    def __init__(self):
        self.said: list[tuple] = []  # kind, codepoints, scripts, resembles, detail
        self.codes: dict[tuple, int] = {}
        self.at: list[np.ndarray] = []
        self.what: list[np.ndarray] = []

    def code(self, kind: str, codepoints: tuple, scripts: tuple, resembles: tuple, detail: str) -> int:
        key = kind, codepoints, scripts, resembles, detail
        if key not in self.codes:
            self.codes[key] = len(self.said)
            self.said.append(key)
        return self.codes[key]

    def add(self, at, what) -> None:
        if len(at):
            self.at.append(np.asarray(at, np.int64))
            self.what.append(np.asarray(what, np.int64))


def characters(x: Texts, asked: Options, out: Drafts) -> None:
    """A finding for each hazardous character."""
    kinds = x.t.hazard[x.points]
    at = np.flatnonzero(kinds)
    if asked.kinds:
        at = at[np.array([asked.wants(k) for k in HAZARDS])[kinds[at]]]
    if not len(at):
        return
    begins = np.zeros(len(x.points) + 1, bool)
    begins[x.firsts[:-1]] = True
    at = at[~(begins[at] & (x.points[at] == 0xFEFF))]
    points, inverse = np.unique(x.points[at], return_inverse=True)
    codes = [out.code(k := HAZARDS[x.t.hazard[p]], (render(p),), (x.t.scripts[x.t.script[p]],), (), hazard_detail(k, p)) for p in points.tolist()]
    out.add(at, np.array(codes, np.int64)[inverse])


def normal(x: Texts, out: Drafts) -> None:
    """A finding for each line that is not in NFC, at the first code point that differs."""
    may = np.unique(x.owner(np.flatnonzero(x.flags & RESHAPED)))
    for d in may.tolist():
        text = x.text(d)
        if unicodedata.is_normalized("NFC", text):
            continue
        at, found, what = int(x.firsts[d]), [], []
        for line in text.split("\n"):
            if not line.isascii() and not unicodedata.is_normalized("NFC", line):
                form = unicodedata.normalize("NFC", line)
                i = next((i for i, (a, b) in enumerate(zip(line, form)) if a != b), min(len(line), len(form)))  # noqa: B905
                j = i + 1
                while j < len(line) and x.flags[at + j] & COMBINING:
                    j += 1
                which = "NFD" if unicodedata.is_normalized("NFD", line) else "neither NFC nor NFD"
                found.append(at + i)
                what.append(out.code("non-nfc", tuple(render(ord(c)) for c in line[i:j]), (), (), f"the line is in {which}, not NFC: it compares unequal to the same text in NFC"))
            at += len(line) + 1
        out.add(found, what)


def words(x: Texts, escapes: dict[int, list[tuple[int, int]]]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in code points, of runs of letters, digits, underscores and marks outside escapes, given by text in bytes."""
    inside = (x.flags & WORD) > 0
    if escapes:
        edge = np.zeros(len(inside) + 1, np.int64)
        for d, spans in escapes.items():
            at = np.searchsorted(x.bytes, np.array(spans) + x.bytes[x.firsts[d]])
            np.add.at(edge, at[:, 0], 1)
            np.add.at(edge, at[:, 1], -1)
        inside &= np.cumsum(edge[:-1]) == 0
    begins = np.zeros(len(inside) + 1, bool)
    begins[x.firsts] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | begins[1:-1]
    last[:-1] &= ~inside[1:] | begins[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def scripted(x: Texts, declared: tuple[str, ...], formats: list[str], refused, out: Drafts) -> None:
    """Mixed words, homoglyphs in them, and compatibility forms of ASCII, of texts that are not refused."""
    t = x.t
    forms = t.imitates[x.points] & ((x.script == LATIN) | (x.script == COMMON))
    asked = np.flatnonzero((x.script > LATIN) | forms)
    own = x.owner(asked)
    if refused:
        free = np.ones(len(x), bool)
        free[list(refused)] = False
        asked, own = asked[free[own]], own[free[own]]
    if not len(asked):
        return
    escapes = {d: e for d in np.unique(own).tolist() if formats[d] == "json" and (e := escape_spans(x.text(d), "json"))}
    starts, ends = words(x, escapes)
    if not len(starts):
        return
    at = np.searchsorted(starts, asked, "right") - 1
    held = np.unique(at[(at >= 0) & (asked < ends[np.maximum(at, 0)])])
    known: dict[bytes, list[tuple[int, int]]] = {}
    found, what = [], []
    for a, b in zip(starts[held].tolist(), ends[held].tolist(), strict=True):
        word = x.points[a:b]
        key = word.tobytes()
        if key not in known:
            known[key] = list(in_word(word, t, declared, out))
        for i, code in known[key]:
            found.append(a + i)
            what.append(code)
    out.add(found, what)


def in_word(word: np.ndarray, t: Tables, declared: tuple[str, ...], out: Drafts) -> Iterator[tuple[int, int]]:
    """(place, what is said) of a word's findings."""
    own = t.script[word]
    scripts = sorted({t.scripts[s] for s in np.unique(own).tolist() if s not in (COMMON, INHERITED, UNKNOWN)})
    undeclared = {s for s in scripts if s != "Latin" and s not in declared}
    points = word.tolist()
    if undeclared and not is_single_script(word, t):
        odd = dict.fromkeys(p for p in points if p > 127)
        yield 0, out.code("mixed-script", tuple(map(render, odd)), tuple(scripts), (), f"one word in {named(scripts)}: no single script accounts for it")
        for i, p in enumerate(points):
            name = t.scripts[own[i]]
            if name in undeclared and p in t.homoglyph:
                yield i, out.code("confusable", (render(p),), (name,), tuple(map(render, t.homoglyph[p])), f"a {name} character in a word that is not {name}, and it looks like the code point under resembles")
    for i in np.flatnonzero(t.imitates[word] & ((own == LATIN) | (own == COMMON))).tolist():
        yield i, out.code("confusable", (render(points[i]),), (t.scripts[own[i]],), (render(t.lookalike[points[i]]),), "a compatibility form of an ASCII character: it reads as the code point under resembles and does not equal it")


_WORDS = pa.list_(pa.string())


def examine_texts(x: Texts, formats: list[str], asked: Options) -> tuple[np.ndarray, list[pa.Array], dict[int, str]]:
    """(where each text's findings begin, columns of FIELDS in order of texts and places, why script checks were refused by text)."""
    out, refused = Drafts(), {}
    if asked.wants(*(k for k in HAZARDS if k)):
        characters(x, asked, out)
    if asked.wants("non-nfc"):
        normal(x, out)
    if asked.wants("confusable", "mixed-script"):
        refused = contexts(x, asked.scripts)
        scripted(x, asked.scripts, formats, refused, out)
    at = np.concatenate(out.at) if out.at else np.zeros(0, np.int64)
    what = np.concatenate(out.what) if out.what else at
    if asked.kinds:
        some = np.array([asked.wants(s[0]) for s in out.said], bool)[what]
        at, what = at[some], what[some]
    order = np.lexsort((np.array([RANK[s[0]] for s in out.said], np.int64)[what], at))
    at, what = at[order], what[order]
    bounds = np.searchsorted(at, x.firsts)
    line, column = x.positions(at)
    offsets = x.offsets(at)
    keys: list[str | None] = [None] * len(at)
    for d in np.flatnonzero(np.diff(bounds)).tolist():
        if formats[d] != "text":
            lo, hi = int(bounds[d]), int(bounds[d + 1])
            keys[lo:hi] = keys_of(x.text(d), formats[d], offsets[lo:hi].tolist())
    said, take = out.said, pa.array(what)
    kinds = [s[0] for s in said]
    columns = [
        pa.array(kinds, pa.string()).take(take), pa.array([SEVERITY[k] for k in kinds], pa.string()).take(take), pa.array(line), pa.array(column), pa.array(offsets), pa.array(keys, pa.string()),
        *(pa.array([list(s[i]) for s in said], _WORDS).take(take) for i in (1, 2, 3)), pa.array([s[4] for s in said], pa.string()).take(take),
    ]
    return bounds, columns, refused


def examine(text: str, format: str, asked: Options, tables: Tables) -> tuple[list[tuple], str | None]:
    """Findings (kind, severity, line, column, offset, key, codepoints, scripts, resembles, detail) of one text in order, and why script checks were refused. Texts of ASCII alone end at the first test."""
    if text.isascii():
        return [], None
    _, columns, refused = examine_texts(Text(text, tables), [format], asked)
    return list(zip(*(c.to_pylist() for c in columns), strict=True)), refused.get(0)
