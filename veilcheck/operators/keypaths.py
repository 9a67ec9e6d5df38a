"""Key paths: where in a structured text a finding lies.

A reader gives spans (start, end, path) in bytes, in order and apart. Readers
scan; they judge no document and change no finding. `join` drops the empty
segments of a root.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterable, Iterator

import numpy as np

Span = tuple[int, int, str]

_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def join(segments: Iterable[str]) -> str:
    return ".".join(s for s in segments if s)


def width(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode())


def lines(text: str) -> Iterator[tuple[int, str]]:
    """(byte offset, line without its line ending)."""
    at = 0
    for line in text.split("\n"):
        yield at, line.rstrip("\r")
        at += width(line) + 1


def span(offset: int, line: str, start: int, end: int, path: str) -> Span:
    """A span from places in a line."""
    a = offset + width(line[:start])
    return a, a + width(line[start:end]), path


def env_spans(text: str) -> Iterator[Span]:
    for offset, line in lines(text):
        if not line.lstrip(_SPACE) or line.lstrip(_SPACE)[0] == "#" or "=" not in line:
            continue
        at = line.index("=")
        key = line[:at].strip(_SPACE)
        key = key.removeprefix("export ").strip(_SPACE)
        if not key:
            continue
        value = line[at + 1 :]
        body = value.lstrip(_SPACE)
        size = len(value)
        if body[:1] not in ('"', "'") and " #" in body:
            size = len(value) - len(body) + body.index(" #")
        yield span(offset, line, at + 1, at + 1 + size, key)


def sectioned(text: str, comments: str, header, separator: re.Pattern, strip: str) -> Iterator[Span]:
    section = ""
    for offset, line in lines(text):
        short = line.strip(_SPACE)
        if not short or short[0] in comments:
            continue
        name = header(short)
        if name is not None:
            section = name
            continue
        found = separator.search(line)
        if found:
            key = line[: found.start()].strip(_SPACE)
            key = key.strip(strip) if strip else key
            if key:
                yield span(offset, line, found.end(), len(line), join([section, key]))


def _toml_header(line: str) -> str | None:
    if not (len(line) > 1 and line[0] == "[" and line[-1] == "]"):
        return None
    inner = line[1:-1]
    if len(inner) > 1 and inner[0] == "[" and inner[-1] == "]":
        inner = inner[1:-1]
    return inner.strip(_SPACE)


def _ini_header(line: str) -> str | None:
    return line[1:-1].strip(_SPACE) if len(line) > 1 and line[0] == "[" and line[-1] == "]" else None


_EQUALS = re.compile("=")


def toml_spans(text: str) -> Iterator[Span]:
    return sectioned(text, "#", _toml_header, _EQUALS, '"')


def ini_spans(text: str) -> Iterator[Span]:
    section = ""
    for offset, line in lines(text):
        short = line.strip(_SPACE)
        if not short or short[0] in ";#":
            continue
        name = _ini_header(short)
        if name is not None:
            section = name
            continue
        at = line.find("=") if "=" in line else line.find(":")
        key = line[:at].strip(_SPACE) if at >= 0 else ""
        if key:
            yield span(offset, line, at + 1, len(line), join([section, key]))


def fields(line: str, delimiter: str) -> list[tuple[int, int]]:
    """The places of a row's fields; a quote switches between inside and outside."""
    out, start, quoted = [], 0, False
    for i, c in enumerate(line):
        if c == '"':
            quoted = not quoted
        elif c == delimiter and not quoted:
            out.append((start, i))
            start = i + 1
    return [*out, (start, len(line))]


def table_spans(text: str, delimiter: str) -> Iterator[Span]:
    names: list[str] | None = None
    for offset, line in lines(text):
        if not line.strip(_SPACE):
            continue
        found = fields(line, delimiter)
        if names is None:
            names = [line[a:b].strip(_SPACE).strip('"') for a, b in found]
            continue
        for i, (a, b) in enumerate(found):
            yield span(offset, line, a, b, names[i] if i < len(names) and names[i] else f"[{i}]")


_JSON = re.compile(rb'[{\[}\],:]|"[^"\\]*(?:\\.[^"\\]*)*(?:"|\\?\Z)|//[^\n]*|/\*.*?(?:\*/|\Z)|[0-9A-Za-z+._-]+', re.DOTALL)


def json_spans(text: str, wanted: list[int] | None = None) -> Iterator[Span]:
    """Strings that are values and bare tokens. A string renames the innermost segment while an object waits for a key.

    With wanted, offsets in order, only spans that hold one of them, and no
    further than the last.
    """
    raw = text.encode()
    n = len(raw)
    # of each open container its segment, a list's index or where an object's key lies, and whether it waits for a key
    stack: list[list] = []

    def path() -> str:
        return join(f"[{s}]" if type(s) is int else raw[s[0] : s[1]].decode(errors="replace") if s else "" for s, _ in stack)

    ahead = None if wanted is None else iter(wanted)
    sought = -1 if ahead is None else next(ahead, n)
    for token in _JSON.finditer(raw):
        a, b = token.span()
        first = raw[a]
        if first == 34:
            closed = b - a > 1 and raw[b - 1] == 34 and (b < n or _closed(raw, a, b))
            a, b = a + 1, b - 1 if closed else b
            if stack and stack[-1][1]:
                stack[-1][0] = a, b
                continue
        elif first == 44:
            if stack:
                top = stack[-1]
                if type(top[0]) is int:
                    top[0] += 1
                else:
                    top[1] = True
            continue
        elif first == 58:
            if stack:
                stack[-1][1] = False
            continue
        elif first == 123:
            stack.append([None, True])
            continue
        elif first == 91:
            stack.append([0, False])
            continue
        elif first == 125 or first == 93:
            if stack:
                stack.pop()
            continue
        elif first == 47:
            continue
        if ahead is None:
            yield a, b, path()
            continue
        while sought < a:
            sought = next(ahead, n)
        if sought < b:
            yield a, b, path()
        elif sought >= n:
            return


def _closed(raw: bytes, a: int, b: int) -> bool:
    """Whether the last quote of a string token is not escaped."""
    slashes = 0
    while b - 2 - slashes > a and raw[b - 2 - slashes] == 92:
        slashes += 1
    return slashes % 2 == 0


_MARK = re.compile(rb'["\\]')


def json_escapes(text: str) -> list[tuple[int, int]]:
    """Byte ranges of the escapes in strings: six bytes for \\u, else two, up to a character's end."""
    out: list[tuple[int, int]] = []
    if "\\" not in text:
        return out
    raw, inside, at = text.encode(), False, 0
    while found := _MARK.search(raw, at):
        at = found.start()
        if raw[at] == 34:
            inside, at = not inside, at + 1
        elif inside:
            end = min(len(raw), at + (6 if raw[at + 1 : at + 2] == b"u" else 2))
            while end < len(raw) and raw[end] & 0xC0 == 0x80:
                end += 1
            out.append((at, end))
            at = end
        else:
            at += 1
    return out


def _yaml_key(body: str) -> tuple[str, int] | None:
    """(key, place of the value) at the first colon that a space or the end follows."""
    found = re.search(r":(?: |\Z)", body)
    if not found:
        return None
    key = body[: found.start()].strip(_SPACE).strip("\"'")
    return (key, found.start() + 1) if key else None


def yaml_spans(text: str) -> Iterator[Span]:
    """Block style by indentation: a key stands at the column of its own text, an item's marker at its line's."""
    open_: list[tuple[int, str]] = []
    counts: dict[int, int] = {}
    for offset, line in lines(text):
        body = line.lstrip(_SPACE)
        if not body or body.startswith(("#", "---")):
            continue
        place = len(line) - len(body)
        column = width(line[:place])
        open_ = [x for x in open_ if x[0] < column]
        counts = {c: n for c, n in counts.items() if c <= column}
        if body[0] == "-":
            counts[column] = counts.get(column, -1) + 1
            open_.append((column, f"[{counts[column]}]"))
            step = 2 if body[1:2] == " " else 1
            place, column, body = place + step, column + step, body[step:]
        found = _yaml_key(body)
        if not found:
            if body:
                yield span(offset, line, place, len(line), join(s for _, s in open_))
            continue
        open_.append((column, found[0]))
        value = body[found[1] :]
        if value.strip(_SPACE):
            lead = len(value) - len(value.lstrip(_SPACE))
            yield span(offset, line, place + found[1] + lead, len(line), join(s for _, s in open_))


READERS = {
    "json": json_spans,
    "yaml": yaml_spans,
    "toml": toml_spans,
    "ini": ini_spans,
    "env": env_spans,
    "csv": lambda text: table_spans(text, ","),
    "tsv": lambda text: table_spans(text, "\t"),
}


def key_spans(text: str, format: str) -> list[Span]:
    reader = READERS.get(format)
    return list(reader(text)) if reader else []


def keys_of(text: str, format: str, offsets: list[int]) -> list[str | None]:
    """key_at() of each offset, in order, of a text."""
    return keys_at(list(json_spans(text, offsets)) if format == "json" else key_spans(text, format), offsets)


def escape_spans(text: str, format: str) -> list[tuple[int, int]]:
    return json_escapes(text) if format == "json" else []


def key_at(spans: list[Span], offset: int) -> str | None:
    """The path of the span that holds a byte; none outside and at a root."""
    i = bisect.bisect_right(spans, offset, key=lambda s: s[0]) - 1
    return (spans[i][2] or None) if i >= 0 and offset < spans[i][1] else None


def keys_at(spans: list[Span], offsets: list[int]) -> list[str | None]:
    """key_at() of each offset."""
    if not spans:
        return [None] * len(offsets)
    places = np.searchsorted(np.array([s[0] for s in spans]), np.array(offsets), "right") - 1
    return [(spans[i][2] or None) if i >= 0 and off < spans[i][1] else None for i, off in zip(places.tolist(), offsets, strict=True)]
