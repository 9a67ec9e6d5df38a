"""Unicode properties as flat tables, one entry for each code point.

Built once for each session from the ICU that Spark brings (Unicode 16), by
rule: nothing is kept in files. The tables have a fixed size, some 7 MB, and
go to executors as a broadcast.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field

import numpy as np
from pyspark import Broadcast
from pyspark.sql import SparkSession

SIZE = 0x110000

# Code points of the single-character kinds.
BIDI = (0x061C, 0x202A, 0x202B, 0x202C, 0x202D, 0x202E, 0x2066, 0x2067, 0x2068, 0x2069)
INVISIBLE = (0x00AD, 0x180E, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)
SPACES = (0x00A0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)
PRIVATE = ((0xE000, 0xF8FF), (0xF0000, 0xFFFFD), (0x100000, 0x10FFFD))
# Superscripts, subscripts and ordinals, which fold to ASCII but imitate nothing.
NOT_IMPERSONATING = ((0x00AA, 0x00AA), (0x00B2, 0x00B3), (0x00B9, 0x00BA), (0x2070, 0x209F))

#: Kinds in order of rank, with their severity and short name. Fixed values.
KINDS = (
    ("bidi-control", "high", "bidi"),
    ("invisible", "medium", "invisible"),
    ("confusable", "high", "confusable"),
    ("mixed-script", "high", "mixed"),
    ("non-nfc", "low", "nfc"),
    ("unusual-whitespace", "low", "whitespace"),
    ("unassigned-or-private-use", "medium", "unassigned"),
)
RANK = {k[0]: i for i, k in enumerate(KINDS)}
SEVERITY = {k[0]: k[1] for k in KINDS}
HAZARDS = ("", "bidi-control", "invisible", "unusual-whitespace", "unassigned-or-private-use")

COMMON, INHERITED, UNKNOWN, LATIN = 0, 1, 2, 3
ALPHABETIC, NUMERIC, WHITE, COMBINING, WORD = 1, 2, 4, 8, 16
#: What NFC may change, alone or beside others.
RESHAPED = 32


@dataclass
class Tables:
    scripts: list[str]  # names; the first four are Common, Inherited, Unknown, Latin
    tags: dict[str, str]  # lower-case name or ISO 15924 tag -> name
    script: np.ndarray  # index into scripts
    flags: np.ndarray
    hazard: np.ndarray  # index into HAZARDS
    extension: np.ndarray  # index into sets
    sets: list[int]  # bitmaps of augmented script extensions
    homoglyph: dict[int, tuple[int, ...]] = field(default_factory=dict)
    lookalike: dict[int, int] = field(default_factory=dict)
    imitates: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))  # keys of lookalike


def ranges(chosen) -> list[tuple[int, int]]:
    return [(chosen.getRangeStart(i), chosen.getRangeEnd(i)) for i in range(chosen.getRangeCount())]


def build(spark: SparkSession) -> Tables:
    icu = spark._jvm.com.ibm.icu

    def of(pattern: str) -> list[tuple[int, int]]:
        return ranges(icu.text.UnicodeSet(pattern))

    values = icu.lang.UProperty.SCRIPT
    names, tags = ["Common", "Inherited", "Unknown", "Latin"], {}
    codes = {}
    for value in range(icu.lang.UCharacter.getIntPropertyMaxValue(values) + 1):
        name, tag = icu.lang.UScript.getName(value), icu.lang.UScript.getShortName(value)
        if name not in names:
            names.append(name)
        codes[name] = tag
    script = np.full(SIZE, UNKNOWN, np.uint8)
    used = [n for n in names if n in ("Common", "Inherited", "Unknown", "Latin")]
    holds: dict[str, list[tuple[int, int]]] = {}
    for name in names:
        if name == "Unknown":
            continue
        found = of(f"[:sc={codes[name]}:]")
        if not found and name not in used:
            continue
        if name not in used:
            used.append(name)
        at = used.index(name)
        for a, b in found:
            script[a : b + 1] = at
        holds[name] = of(f"[:scx={codes[name]}:]")
        for spelt in (name, codes[name]):
            tags[spelt.lower().replace("-", "_")] = name
    flags = np.zeros(SIZE, np.uint8)
    for pattern, flag in (("[:Alphabetic:]", ALPHABETIC), ("[[:Nd:][:Nl:][:No:]]", NUMERIC), ("[:White_Space:]", WHITE), ("[:^ccc=0:]", COMBINING), ("[[:^ccc=0:][:NFC_QC=No:][:NFC_QC=Maybe:]]", RESHAPED)):
        for a, b in of(pattern):
            flags[a : b + 1] |= flag
    flags[(flags & (ALPHABETIC | NUMERIC)) > 0] |= WORD
    flags[script == INHERITED] |= WORD
    flags[ord("_")] |= WORD
    hazard = np.zeros(SIZE, np.uint8)
    hazard[script == UNKNOWN] = 4
    hazard[0xD800:0xE000] = 0
    for kind, points in ((1, BIDI), (2, INVISIBLE), (3, SPACES)):
        hazard[list(points)] = kind
    # augmented extensions: three virtual scripts stand for the Han mixtures; Common and Inherited fit all
    virtual = {"hanb": len(used), "jpan": len(used) + 1, "kore": len(used) + 2}
    joins = {"Han": ("hanb", "jpan", "kore"), "Bopomofo": ("hanb",), "Hiragana": ("jpan",), "Katakana": ("jpan",), "Hangul": ("kore",)}
    everything = (1 << (len(used) + 3)) - 1
    bits: dict[int, int] = {}
    extension = np.zeros(SIZE, np.uint16)
    masks: list[np.ndarray] = []
    signature = np.zeros(SIZE, np.uint64)
    rng = np.random.default_rng(1)
    members: list[tuple[int, np.ndarray]] = []
    for name, found in holds.items():
        mask = everything if name in ("Common", "Inherited") else (1 << used.index(name)) | sum(1 << virtual[v] for v in joins.get(name, ()))
        at = np.concatenate([np.arange(a, b + 1) for a, b in found]) if found else np.zeros(0, np.int64)
        signature[at] += rng.integers(1, 1 << 62, dtype=np.uint64)
        members.append((mask, at))
    distinct, inverse = np.unique(signature, return_inverse=True)
    extension[:] = inverse
    sets = [0] * len(distinct)
    for mask, at in members:
        for i in np.unique(extension[at]):
            sets[i] |= mask
    del bits, masks
    out = Tables(used, tags, script, flags, hazard, extension, sets)
    # characters that NFKC folds to one ASCII letter or digit
    for cp in np.flatnonzero((flags & (ALPHABETIC | NUMERIC)) > 0).tolist():
        if cp < 128 or any(a <= cp <= b for a, b in NOT_IMPERSONATING):
            continue
        plain = unicodedata.normalize("NFKC", chr(cp))
        if len(plain) == 1 and plain.isascii() and plain.isalnum():
            out.lookalike[cp] = ord(plain)
    out.imitates = np.zeros(SIZE, bool)
    out.imitates[list(out.lookalike)] = True
    out.homoglyph = homoglyphs(icu, script)
    return out


def homoglyphs(icu, script: np.ndarray) -> dict[int, tuple[int, ...]]:
    """Identifier characters that share a skeleton with one of another script: the skeleton of each, where it is not itself."""
    allowed = [chr(c) for a, b in ranges(icu.text.UnicodeSet("[[:Identifier_Status=Allowed:]-[:sc=Hangul:]]")) for c in range(a, b + 1)]
    checker = getattr(icu.text, "SpoofChecker$Builder")().build()
    skeletons = checker.getSkeleton("\n".join(allowed)).split("\n")
    by: dict[str, set[int]] = {}
    for c, s in zip(allowed, skeletons, strict=True):
        by.setdefault(s, set()).add(int(script[ord(c)]))
    return {ord(c): tuple(map(ord, s)) for c, s in zip(allowed, skeletons, strict=True) if ord(c) > 127 and s != c and len(by[s] | {int(script[ord(x)]) for x in s if len(s) == 1}) > 1 and len(by[s]) > 1}


_shared: dict[str, tuple[Tables, Broadcast]] = {}


def tables(spark: SparkSession) -> Tables:
    return shared(spark)[0]


def shared(spark: SparkSession) -> tuple[Tables, Broadcast]:
    """The session's tables and their broadcast."""
    key = spark.sparkContext.applicationId
    if key not in _shared:
        made = build(spark)
        _shared.clear()
        _shared[key] = made, spark.sparkContext.broadcast(made)
    return _shared[key]


def unknown(spark: SparkSession) -> list[tuple[int, int]]:
    """Ranges of the code points of script Unknown but the surrogates: unassigned, private use and noncharacters, as in the tables."""
    return ranges(spark._jvm.com.ibm.icu.text.UnicodeSet("[[:sc=Zzzz:]-[:Cs:]]"))


def range_class(spans) -> str:
    """The inside of a regular expression's class of sorted ranges, in blocks, so that a character is held against one block's ranges and not against all."""
    blocks = [spans[i : i + 24] for i in range(0, len(spans), 24)]
    return "".join(f"[\\x{{{b[0][0]:X}}}-\\x{{{b[-1][1]:X}}}&&[{''.join(f'\\x{{{a:X}}}-\\x{{{z:X}}}' for a, z in b)}]]" for b in blocks)


def hazard_class(*kinds: str, spans=PRIVATE) -> str:
    """A regular expression's class of the single-character hazards; spans are the ranges of the last kind, unknown() for all of it."""
    points = {"bidi-control": BIDI, "invisible": INVISIBLE, "unusual-whitespace": SPACES}
    out = "".join(f"\\x{{{p:X}}}" for k in kinds for p in points.get(k, ()))
    if "unassigned-or-private-use" in kinds:
        out += range_class(spans)
    # U+10FFFF as it is, not escaped: only that makes Java look behind by code points
    return f"[\\x{{80}}-\U0010ffff&&[{out}]]"
