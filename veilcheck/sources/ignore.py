"""gitignore rules: a pattern to a regular expression, and the last rule that fits."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stores import Local, Store


@dataclass(frozen=True)
class Rule:
    pattern: re.Pattern
    negated: bool
    folders_only: bool


def to_regex(glob: str) -> str:
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("/**", i) and i + 3 == len(glob):
            out, i = out + "/.+", i + 3
        elif c == "*":
            while i + 1 < len(glob) and glob[i + 1] == "*":
                i += 1
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            inner = glob[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", end + 1
        elif c == "\\" and i + 1 < len(glob):
            out, i = out + re.escape(glob[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return out


def parse_line(line: str) -> Rule | None:
    line = line.rstrip("\r\n")
    if not line.endswith("\\ "):
        line = line.rstrip(" ")
    if not line or line[0] == "#":
        return None
    negated = line[0] == "!"
    line = line[1:] if negated else line.removeprefix("\\") if line[:2] in ("\\#", "\\!") else line
    folders = line.endswith("/")
    line = line.rstrip("/")
    anchored = "/" in line
    line = line.lstrip("/")
    if not line:
        return None
    return Rule(re.compile(("" if anchored else "(?:.*/)?") + to_regex(line)), negated, folders)


def parse(text: str) -> list[Rule]:
    return [r for r in map(parse_line, text.split("\n")) if r]


def verdict(rules: list[Rule], path: str, folder: bool) -> bool | None:
    """Ignored or not by the last rule that fits; None if none does."""
    for rule in reversed(rules):
        if (folder or not rule.folders_only) and rule.pattern.fullmatch(path):
            return not rule.negated
    return None


def ignored_column(path: Column, rules: str) -> Column:
    """Whether the rules of a root leave out a path below it: the last rule that fits decides, and a folder that is out takes all in it along."""
    parsed = parse(rules)

    def last(p: Column, folder: bool) -> Column:
        out = F.lit(False)
        for rule in parsed:
            if folder or not rule.folders_only:
                out = F.when(p.rlike(f"\\A(?:{rule.pattern.pattern})\\z"), F.lit(not rule.negated)).otherwise(out)
        return out

    names = F.split(path, "/")
    folders = F.transform(F.sequence(F.lit(1), F.greatest(F.size(names) - 1, F.lit(1))), lambda n: F.array_join(F.slice(names, 1, n), "/"))
    return F.when(F.size(names) > 1, F.exists(folders, lambda p: last(p, True))).otherwise(F.lit(False)) | last(path, False)


class Ignore:
    """The rules of a tree, folder by folder; an ignored folder is final.

    In each folder `.ignore` goes before `.gitignore`, and the deepest folder
    with an opinion wins; then the repository's exclude file, then the user's.
    """

    def __init__(self, root: str, names=(".ignore", ".gitignore"), fallback=(".git/info/exclude",), user: str | None = None, store: Store | None = None):
        self.store = store or Local()
        self.root, self.names = self.store.whole(root), names
        self.inside = self._is_repository()
        extra = [f"{self.root}/{f}" for f in fallback if self.inside] + ([user] if user and self.inside else [])
        self.extra = [self._load(p) for p in extra]
        self.rules: dict[str, list[list[Rule]]] = {}
        self.known: dict[str, bool] = {"": False}

    def _is_repository(self) -> bool:
        at = self.root
        while at:
            if self.store.exists(f"{at}/.git"):
                return True
            above = at.rpartition("/")[0]
            at = "" if above.endswith(("/", ":")) else above
        return False

    def _load(self, path: str) -> list[Rule]:
        return parse(self.store.text(path) or "")

    def _of(self, folder: str) -> list[list[Rule]]:
        if folder not in self.rules:
            names = [n for n in self.names if n != ".gitignore" or self.inside]
            self.rules[folder] = [self._load("/".join(x for x in (self.root, folder, n) if x)) for n in names]
        return self.rules[folder]

    def ignored(self, path: str, folder: bool = False) -> bool:
        """path is relative to the root, with slashes."""
        if path in self.known:
            return self.known[path]
        parent = path.rpartition("/")[0]
        if parent and self.ignored(parent, True):
            return True
        out, at = None, parent
        while out is None:
            below = path[len(at) + 1 :] if at else path
            for rules in self._of(at):
                if (out := verdict(rules, below, folder)) is not None:
                    break
            if not at:
                break
            at = at.rpartition("/")[0]
        for rules in self.extra if out is None else ():
            if (out := verdict(rules, path, folder)) is not None:
                break
        if folder:
            self.known[path] = bool(out)
        return bool(out)
