"""What a screening may be asked: kinds, scripts, format, caps; checked before any plan is built."""

from __future__ import annotations

import math
from dataclasses import dataclass

from .ucd import KINDS, Tables

FORMATS = ("json", "yaml", "csv", "tsv", "toml", "ini", "env", "text")
# Names of formats, extensions and editors' language names.
ALIASES = {
    "json": "json", "jsonc": "json", "yaml": "yaml", "yml": "yaml", "csv": "csv", "tsv": "tsv", "toml": "toml",
    "ini": "ini", "cfg": "ini", "conf": "ini", "properties": "ini", "env": "env", "dotenv": "env", "text": "text", "txt": "text",
}
DEFAULT_RESULTS, MOST_RESULTS = 500, 5000
FOREIGN_PERCENT = 10


@dataclass(frozen=True)
class Options:
    kinds: tuple[str, ...] = ()
    scripts: tuple[str, ...] = ()
    format: str | None = None

    def wants(self, *kinds: str) -> bool:
        return not self.kinds or any(k in self.kinds for k in kinds)


def parse_kind(name: str) -> str:
    """A kind by its full or short name."""
    for full, _, short in KINDS:
        if name in (full, short):
            return full
    raise ValueError(f"unknown kind {name!a}; one of {', '.join(k[2] for k in KINDS)}")


def parse_script(name: str, tables: Tables) -> str:
    """A script by its name or ISO 15924 tag, whatever its case; the values that are no scripts are refused."""
    found = tables.tags.get(name.strip().lower().replace("-", "_").replace(" ", "_"))
    if found is None or found in ("Common", "Inherited", "Unknown"):
        raise ValueError(f"unknown script {name!a}")
    return found


def options(tables: Tables, kinds=(), scripts=(), format: str | None = None) -> Options:
    return Options(tuple(dict.fromkeys(map(parse_kind, kinds))), tuple(dict.fromkeys(parse_script(s, tables) for s in scripts)), format)


def max_results(value) -> int:
    """A cap on results: a whole number of 1 or more; more than MOST_RESULTS counts as that."""
    if value is None:
        return DEFAULT_RESULTS
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value) or value != int(value) or value < 1:
        raise ValueError("maxResults is a whole number of 1 or more")
    return min(int(value), MOST_RESULTS)


def check_gate(fail_on: str, kinds: tuple[str, ...]) -> str:
    """`any` or `bidi`; a gate on a kind that the filter leaves out is an error."""
    if fail_on not in ("any", "bidi"):
        raise ValueError(f"fail-on is any or bidi, not {fail_on!a}")
    if fail_on == "bidi" and kinds and "bidi-control" not in kinds:
        raise ValueError("fail-on bidi with kinds that leave bidi out could never fail")
    return fail_on


def typed(value, default, least=None):
    """A setting, or its default if it has another type; numbers no smaller than `least`."""
    if isinstance(default, bool) or isinstance(value, bool):
        return value if isinstance(value, bool) and isinstance(default, bool) else default
    if isinstance(default, (int, float)):
        if not isinstance(value, (int, float)) or not math.isfinite(value):
            return default
        return value if least is None else max(least, value)
    if isinstance(default, (list, tuple)):
        return list(value) if isinstance(value, (list, tuple)) and all(isinstance(x, str) for x in value) else list(default)
    return value if isinstance(value, type(default)) else default


def resolve_format(format: str | None = None, filename: str | None = None) -> str:
    """An explicit name, else the file's whole name, else its extension, else text."""

    def known(name: str) -> str:
        return ALIASES.get(name.strip().lower().lstrip("."), "text")

    base = filename.replace("\\", "/").rsplit("/", 1)[-1] if filename is not None else ""
    names = [format or "", base, base.rpartition(".")[2] if "." in base else ""]
    return next((f for f in map(known, names) if f != "text"), "text")


def language_format(language: str | None, filename: str | None = None) -> str:
    """An editor's hint: the document's language mode if it names a format, else its file's name."""
    return resolve_format(language, filename)
