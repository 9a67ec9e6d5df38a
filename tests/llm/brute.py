"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def substrings(rows, width):
    docs = [(i, words(t)) for i, t in rows]
    seen = collections.Counter(tuple(w[j : j + width]) for _, w in docs for j in range(len(w) - width + 1))
    out = []
    for i, w in docs:
        gone = [False] * len(w)
        for j in range(len(w) - width + 1):
            if seen[tuple(w[j : j + width])] > 1:
                gone[j : j + width] = [True] * width
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def suffixes(rows, width):
    docs = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(b[j : j + width] for _, b in docs for j in range(len(b) - width + 1))
    out = []
    for i, b in docs:
        gone = bytearray(len(b))
        for j in range(len(b) - width + 1):
            if seen[b[j : j + width]] > 1:
                gone[j : j + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def jaccard(rows, size, percent):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for i, t in rows:
        w = words((t or "").translate(low))
        sets.append((i, {tuple(w[j : j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    places = collections.defaultdict(list)
    for q, (_, s) in enumerate(sets):
        for p, k in collections.Counter(p for g in s for p in places[g]).items():
            if 100 * k >= percent * (len(s) + len(sets[p][1]) - k):
                parent[find(p)] = find(q)
        for g in s:
            places[g].append(q)
    least = {}
    for q, (i, _) in enumerate(sets):
        ids = [x for x in (least.get(find(q)), i) if x is not None]
        least[find(q)] = min(ids) if ids else None
    return sorted(((i, len(s), least[find(q)] if s else i) for q, (i, s) in enumerate(sets)), key=str)


def signals(text):
    text = text or ""
    w, seen, repeats = words(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeats += line in seen
            seen.add(line)
    n = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = [0] * len(w)
    for i in range(len(w) - 2):
        if n[tuple(w[i : i + 3])] > 1:
            inside[i : i + 3] = [1, 1, 1]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), repeats, sum(inside)
