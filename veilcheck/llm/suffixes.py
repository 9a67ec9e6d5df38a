"""Repeated byte strings by a logarithmic family of suffix indexes.

Suffixes are cut to `width` bytes, as only equality over that length is asked.
A batch of suffixes gets a suffix array of its own, in the order of their text,
is merge-scanned against the levels there are, and becomes a level; two levels
of about equal size merge into one, so n batches leave log(n) levels. Suffixes
are equal if all their bytes are: no hash decides a removal. Equal ones are
held once, so a crowd of copies costs its levels one suffix.

One index over a corpus would be one task. So suffixes are dealt by content:
the least of the hashes of the `KMER`-byte strings within a suffix, the
*anchor*, is the same in equal suffixes and shared by runs of neighbours. A
first round finds anchors that occur once; their suffixes cannot repeat. In
the second the text around every other anchor goes to the anchor's part, whose
task feeds it to its own family of levels, batch by batch.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import kernels as K
from .common import keyed, lean, settled, type_of
from .substrings import Notes, note_repeats, send_hashes

KMER = 32
#: Bits of a place in a slice: a text in Spark has less than 2^31 bytes, and a longer slice is one text.
_PLACE_BITS = 31
#: Suffixes in a batch.
BATCH = 1 << 19
#: Words of eight bytes that are compared at once.
_BLOCK = 8
#: Suffixes that are sought, or whose marks are read, at once: each takes a few hundred bytes meanwhile.
_CHUNK = 1 << 16


def narrow(places: np.ndarray, most: int) -> np.ndarray:
    """Places below `most` in four bytes each where that holds them."""
    return places.astype(np.int32 if most < 1 << 31 else np.int64, copy=False)


def kmer_for(width: int) -> int:
    return max(1, min(KMER, width // 4))


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of `width` values, by doubling."""
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def runs(data: np.ndarray, offs: np.ndarray, width: int):
    """(document, first suffix, last suffix + 1, anchor's hash) of each run of suffixes that share an anchor."""
    none = np.zeros(0, np.int64)
    kmer = kmer_for(width)
    sizes = np.diff(offs)
    fits = np.maximum(sizes - width + 1, 0)
    if not fits.sum():
        return none, none, none, np.zeros(0, K.U)
    sums = K.prefix(data)
    n = len(data) - kmer + 1
    hashes = K.mix((sums[kmer:] - sums[:n]) * K.powers(len(sums))[1][:n])
    places = K.U((1 << _PLACE_BITS) - 1)
    best = least((hashes & ~places) | np.arange(n, dtype=K.U), width - kmer + 1)
    doc = np.repeat(np.arange(len(sizes)), fits)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(fits) - fits, fits) + offs[doc]
    at = (best[start] & places).astype(np.int64)
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])])
    last = np.r_[first[1:], len(doc)] - 1
    return doc[first], start[first], start[last] + 1, hashes[at[first]]


class Texts:
    """Bytes whose suffixes, cut to `width`, are read as big-endian words, so that words sort as their bytes do."""

    def __init__(self, data: np.ndarray, width: int):
        self.width, self.data = width, np.concatenate([data, np.zeros(8 * _BLOCK, np.uint8)])
        self.words = np.ndarray((len(self.data) - 8 * _BLOCK + 1, _BLOCK), ">u8", self.data, strides=(1, 8))
        self.steps = -(-width // 8)
        kept = np.full(self.steps + _BLOCK, (1 << 64) - 1, K.U)
        kept[self.steps :] = 0
        if width % 8:
            kept[self.steps - 1] -= K.U((1 << 8 * (8 - width % 8)) - 1)
        self.kept = np.lib.stride_tricks.sliding_window_view(kept, _BLOCK)

    def block(self, at: np.ndarray, step: np.ndarray) -> np.ndarray:
        """_BLOCK words of each suffix from its step-th on; what lies beyond `width` is zero."""
        out = self.words[np.minimum(at + 8 * step, len(self.words) - 1)].byteswap(inplace=True).view(K.U)
        edge = np.flatnonzero(step + _BLOCK >= self.steps)
        out[edge] &= self.kept[step[edge]]
        return out

    def heads(self, at: np.ndarray) -> np.ndarray:
        return self.words[at, 0].astype(K.U) & self.kept[0, 0]


def suffix_array(texts: Texts, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes at `starts` by their text, and which are not equal to the one before.

    Suffixes of one head are a group. A group whose members differ in the words
    that are looked at next is sorted by the first that differs, and so falls
    into smaller ones; a group without a difference up to the width is one of
    equal suffixes.
    """
    head = texts.heads(starts)
    order = np.argsort(head, kind="stable")
    head = head[order]
    new = np.ones(len(order), bool)
    new[1:] = head[1:] != head[:-1]
    step = np.ones(len(order), np.int64)  # of each place: words that its group is known to share
    at = np.arange(len(order))
    while len(at):
        # places whose group has others and is not known to the end
        first = np.flatnonzero(new[at])
        size = np.diff(np.append(first, len(at)))
        first, size = (x[(size > 1) & (step[at[first]] < texts.steps)] for x in (first, size))
        own = np.repeat(np.arange(len(first)), size)
        begin = np.cumsum(size) - size
        at = at[np.arange(len(own)) - begin[own] + first[own]]
        if not len(at):
            break
        rows = texts.block(starts[order[at]], step[at])
        differs, heads = np.empty(rows.shape, bool), rows[begin]
        for i in range(_BLOCK):  # a word at a time: a second table of the rows' size is never made
            np.not_equal(rows[:, i], heads[:, i][own], out=differs[:, i])
        column = np.where(differs.any(axis=1), differs.argmax(axis=1), _BLOCK)
        least_ = np.minimum.reduceat(column, begin)
        step[at] += np.minimum(least_ + 1, _BLOCK)[own]
        split = np.flatnonzero((least_ < _BLOCK)[own])
        if len(split):
            key = rows[split, least_[own[split]]]
            by = np.lexsort((key, own[split]))
            places = at[split]
            order[places] = order[places[by]]
            key, group = key[by], own[split]
            new[places[1:]] |= (key[1:] != key[:-1]) & (group[1:] == group[:-1])
    return order, new


class Level:
    """Suffixes that differ from each other, in order of their text; refs tell which suffixes they are."""

    def __init__(self, texts: Texts, starts: np.ndarray, refs: np.ndarray):
        self.texts, self.starts, self.refs = texts, narrow(starts, len(texts.data)), refs
        self.heads = texts.heads(starts)

    def seek(self, other: Level) -> tuple[np.ndarray, np.ndarray]:
        """For each suffix of another level its place in this one, and whether an equal one is there: a binary search among those of one head, _CHUNK suffixes at a time."""
        places, equal = np.empty(len(other.starts), np.int64), np.zeros(len(other.starts), bool)
        for i in range(0, len(places), _CHUNK):
            heads, starts, found = (x[i : i + _CHUNK] for x in (other.heads, other.starts, equal))
            lo, hi = (np.searchsorted(self.heads, heads, side) for side in ("left", "right"))
            open_ = np.flatnonzero(lo < hi)
            while len(open_):
                middle = (lo[open_] + hi[open_]) // 2
                sign = compare(self.texts, self.starts[middle], other.texts, starts[open_])
                found[open_[sign == 0]] = True
                lo[open_] = np.where(sign < 0, middle + 1, np.where(sign == 0, middle, lo[open_]))
                hi[open_] = np.where(sign < 0, hi[open_], middle)
                open_ = open_[(lo[open_] < hi[open_]) & (sign != 0)]
            places[i : i + _CHUNK] = lo
        return places, equal

    def merged(self, other: Level, place: np.ndarray, equal: np.ndarray) -> Level:
        """Both levels as one; of equal suffixes this one's stay."""
        n, new = len(self.starts), ~equal
        shift = len(self.texts.data) - 8 * _BLOCK
        texts = Texts(np.concatenate([self.texts.data[:shift], other.texts.data[: len(other.texts.data) - 8 * _BLOCK]]), self.texts.width)
        at = place[new] + np.arange(int(new.sum()))
        mine = np.ones(n + len(at), bool)
        mine[at] = False
        starts, refs = narrow(np.zeros(len(mine), np.int8), len(texts.data)), np.zeros(len(mine), np.promote_types(self.refs.dtype, other.refs.dtype))
        starts[mine], starts[at] = self.starts, other.starts[new].astype(np.int64) + shift
        refs[mine], refs[at] = self.refs, other.refs[new]
        return Level(texts, starts, refs)


def compare(one: Texts, a: np.ndarray, two: Texts, b: np.ndarray) -> np.ndarray:
    """-1, 0 or 1 for each pair of suffixes."""
    out, left, step = np.zeros(len(a), np.int8), np.arange(len(a)), 0
    while len(left) and step < one.steps:
        at = np.full(len(left), step)
        x, y = one.block(a[left], at), two.block(b[left], at)
        differs = x != y
        column = differs.argmax(axis=1)
        row = np.arange(len(left))
        some = differs[row, column]
        out[left[some]] = np.where(x[row, column] < y[row, column], -1, 1)[some]
        left, step = left[~some], step + _BLOCK
    return out


class Levels:
    """The family: levels of suffix arrays, each more than twice as large as the next."""

    def __init__(self, width: int):
        self.width = width
        self.levels: list[Level] = []
        self.again: list[np.ndarray] = []
        self.size = 0

    def add(self, data: np.ndarray, starts: np.ndarray) -> None:
        """A batch: a text and where its suffixes start. marks() tells of each suffix so far whether an equal one came before or after."""
        texts = Texts(data, self.width)
        order, new = suffix_array(texts, starts)
        marks = np.zeros(len(starts), bool)
        same = np.flatnonzero(~new)
        marks[order[same]] = marks[order[same - 1]] = True
        # the first of a run of equal suffixes stands for the others, which mark each other here
        run = np.cumsum(new) - 1
        batch = Level(texts, starts[order[new]], narrow(order[new] + self.size, self.size + len(starts)))
        self.again.append(marks)
        self.size += len(starts)
        bounds = np.cumsum([0, *map(len, self.again)])
        for level in self.levels:
            place, equal = level.seek(batch)
            marks[order[equal[run]]] = True
            refs = level.refs[place[equal]]
            which = np.searchsorted(bounds, refs, "right") - 1
            for w in np.unique(which):
                self.again[w][refs[which == w] - bounds[w]] = True
        self.levels.append(batch)
        while len(self.levels) > 1 and len(self.levels[-2].starts) < 2 * len(self.levels[-1].starts):
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append(a.merged(b, *a.seek(b)))

    def marks(self) -> np.ndarray:
        return np.concatenate(self.again) if self.again else np.zeros(0, bool)


def send_text(parts: int, width: int):
    """A mapInArrow function over (k, body, notes): the text of each run whose anchor is noted, packed by the anchor's part."""

    def run(batches):
        held, size = [], 0

        def send():
            anchor, key, key2, low, count = (np.concatenate(x) for x in zip(*(h[:5] for h in held), strict=True))
            texts = [t for h in held for t in h[5]]
            part = X.to_part(anchor, parts)
            order = np.argsort(part, kind="stable")
            bounds = np.searchsorted(part[order], np.arange(parts + 1))
            pressed = zstandard.ZstdCompressor(level=3)
            for p in np.flatnonzero(np.diff(bounds)):
                at = order[bounds[p] : bounds[p + 1]]
                at = at[np.argsort(anchor[at], kind="stable")]
                text = np.frombuffer(pressed.compress(b"".join(texts[i] for i in at)), np.uint8)
                yield X.packed_row(p, [key[at], key2[at], low[at], count[at], text])

        for batch in batches:
            keys, notes = batch.column(0).to_numpy(), batch.column(2)
            for lo, hi, data, offs in K.slices(batch.column(1).cast(pa.large_binary()).cast(pa.large_string())):
                doc, low, high, anchor = runs(data, offs, width)
                bounds = np.searchsorted(doc, np.arange(hi - lo + 1))
                hits = [np.flatnonzero(np.isin(anchor[a:b], X.unpack(notes[lo + d].as_py())[0])) + a for d, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))]
                hit = np.concatenate(hits)
                if not len(hit):
                    continue
                second = np.array([own_key(data[offs[d] : offs[d + 1]]) for d in range(hi - lo)], np.int64)
                d = doc[hit]
                texts = [data[a : b + width - 1].tobytes() for a, b in zip(low[hit], high[hit], strict=True)]
                held.append((anchor[hit], keys[lo:hi][d], second[d], (low[hit] - offs[d]).astype(np.int64), (high - low)[hit].astype(np.uint32), texts))
                size += int((high - low)[hit].sum()) + len(hit) * width
                if size > X.FLUSH_BYTES:
                    yield from send()
                    held, size = [], 0
        if held:
            yield from send()

    return run


def own_key(data: np.ndarray) -> int:
    return np.uint64(xxhash.xxh3_64_intdigest(data.tobytes())).astype(np.int64)


def batches_of(text: np.ndarray, counts: np.ndarray, width: int):
    """(bytes, starts) of the first counts[i] suffixes of each piece of text, in order, about BATCH at a time."""
    sizes = counts.astype(np.int64) + width - 1
    ends = np.cumsum(sizes)
    before = np.cumsum(counts.astype(np.int64)) - counts
    i = 0
    while i < len(counts):
        j = max(i + 1, int(np.searchsorted(before, before[i] + BATCH, "right")) - 1)
        base = ends[i] - sizes[i]
        own = np.repeat(np.arange(i, j), counts[i:j])
        yield text[base : ends[j - 1]], np.arange(len(own)) - (before[own] - before[i]) + ends[own] - sizes[own] - base
        i = j


class Pieces:
    """The distinct pieces of text of a part, fed to the family in batches; equal ones stand for each other.

    A passage that documents share is cut into the same pieces wherever it is,
    so its copies cost a look-up each and its suffixes are indexed once.
    """

    def __init__(self, width: int):
        self.width, self.index = width, Levels(width)
        self.codes: dict[bytes, int] = {}
        self.counts: list[int] = []
        self.new: list[bytes] = []
        self.waiting = 0

    def add(self, text: bytes, counts: np.ndarray) -> np.ndarray:
        """The code of each piece; the i-th holds counts[i] suffixes."""
        out, at = np.empty(len(counts), np.int64), 0
        for i, n in enumerate(counts.tolist()):
            piece = text[at : at + n + self.width - 1]
            at += len(piece)
            code = self.codes.setdefault(piece, len(self.codes))
            if code == len(self.counts):
                self.counts.append(n)
                self.new.append(piece)
                self.waiting += n
            out[i] = code
        if self.waiting >= BATCH:
            self.feed()
        return out

    def feed(self) -> None:
        if self.new:
            counts = np.array(self.counts[-len(self.new) :], np.int64)
            for data, starts in batches_of(np.frombuffer(b"".join(self.new), np.uint8), counts, self.width):
                self.index.add(data, starts)
        self.new, self.waiting = [], 0

    def marks(self, codes: np.ndarray) -> np.ndarray:
        """Whether each suffix of the pieces of these codes, all that were added, occurs twice or more."""
        self.feed()
        again, counts = self.index.marks(), np.array(self.counts, np.int64)
        first = np.cumsum(counts) - counts
        size = counts[codes]
        twice = np.bincount(codes, minlength=len(counts)) > 1
        ends = np.cumsum(size)
        out, i = np.empty(int(size.sum()), bool), 0
        while i < len(codes):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] - size[i] + _CHUNK, "right")))
            mine, n, begin = codes[i:j], size[i:j], ends[i:j] - size[i:j]
            at = np.repeat(first[mine] - begin, n) + np.arange(begin[0], ends[j - 1])
            out[begin[0] : ends[j - 1]] = again[at] | np.repeat(twice[mine], n)
            i = j
        return out


def note_suffixes(parts: int, width: int):
    """A mapInArrow function over dealt text: for each document the spans of suffixes that occur twice or more."""

    def run(batches):
        out = X.Sender(parts)
        for blobs in X.by_part(batches):
            pieces, found, codes = Pieces(width), [], []
            for blob in blobs:
                key, key2, low, count, text = X.unpack(blob)
                found.append((key, key2, low, count))
                codes.append(pieces.add(zstandard.ZstdDecompressor().decompress(text.tobytes()), count))
            again = pieces.marks(np.concatenate(codes))
            key, key2, low, count = (np.concatenate(x) for x in zip(*found, strict=True))
            begin = np.cumsum(count.astype(np.int64)) - count
            edge = np.zeros(len(again) + 1, bool)
            edge[begin] = True
            edge[-1] = True
            before = np.r_[False, again[:-1]]
            after = np.r_[again[1:], False]
            first = np.flatnonzero(again & (edge[:-1] | ~before))
            last = np.flatnonzero(again & (edge[1:] | ~after))
            own = np.searchsorted(begin, first, "right") - 1
            spans = (first - begin[own] + low[own], last + 1 - begin[own] + low[own])
            if len(own) and out.add(key, own, X.key_part(key, parts)[own], *spans, key2[own]):
                yield from out.send()
        yield from out.send()

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 200, keep_text: bool = False) -> DataFrame:
    """Bytes that lie in a string of `width` bytes that also starts anywhere else.

    Returns (id, n_bytes, n_removed, n_spans, kept_sha256[, kept binary]).
    Texts are taken as UTF-8; matches stay within a document and are judged on
    the input, and overlapping ones count, so a long run of one letter goes.
    Null and empty texts are empty: nothing to remove, the digest of nothing.
    Equal rows are two documents, and null ids are ids like any other. Other
    columns are ignored; an empty table gives an empty one. What is left need
    not be valid UTF-8, as a match may begin or end within a character.
    """
    spark = docs.sparkSession
    parts, kind = X.parts_of(spark), type_of(docs, id_col)
    rows = keyed(docs, id_col, text_col)

    def pick(batch, lo, hi, data, offs):
        doc, _, _, anchor = runs(data, offs, width)
        return doc, anchor

    notes = X.deal(rows.select("k", "body").mapInArrow(lean(send_hashes(parts, pick)), X.PACKED), parts).mapInArrow(lean(note_repeats(parts)), X.PACKED)
    schema = f"id {kind}, n_bytes long, kept_sha256 string, k long, body binary, noted binary"

    def suspect(batches):
        book = Notes()
        for payloads, keys, ids, bodies in X.read_with_notes(batches):
            book.load(payloads)
            texts, sizes, shas, noted = [], [], [], []
            for key, body in zip(keys, bodies, strict=True):
                raw = body.as_py()
                mine = book.get(key)
                sizes.append(len(raw))
                shas.append(None if len(mine) else hashlib.sha256(raw).hexdigest())
                texts.append(raw if len(mine) else None)
                noted.append(X.pack([np.unique(mine)]) if len(mine) else None)
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(shas, pa.string()), pa.array(keys), pa.array(texts, pa.binary()), pa.array(noted, pa.binary())], names=["id", "n_bytes", "kept_sha256", "k", "body", "noted"])

    tried = settled(X.with_notes(notes, rows, parts).mapInArrow(lean(suspect), schema), "suffixes")
    suspects = tried.where(F.col("noted").isNotNull())
    spans = X.deal(suspects.select("k", "body", "noted").mapInArrow(lean(send_text(parts, width)), X.PACKED), parts).mapInArrow(lean(note_suffixes(parts, width)), X.PACKED)
    final = f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"

    def cut_out(batches):
        of, size, key, low, high, key2 = None, -1, None, None, None, None
        for payloads, keys, ids, bodies in X.read_with_notes(batches):
            if of is not payloads or size != len(payloads):
                of, size = payloads, len(payloads)
                found = [X.unpack(b) for b in payloads] or [[np.zeros(0, np.int64)] * 5]
                key = np.concatenate([np.repeat(x[0], x[1]) for x in found])
                low, high, key2 = (np.concatenate([x[i] for x in found]) for i in (2, 3, 4))
                order = np.argsort(key, kind="stable")
                key, low, high, key2 = key[order], low[order], high[order], key2[order]
            sizes, removed, n_spans, shas, kept = [], [], [], [], []
            for k, body in zip(keys, bodies, strict=True):
                raw = np.frombuffer(body.as_py(), np.uint8)
                mine = slice(np.searchsorted(key, k), np.searchsorted(key, k, "right"))
                good = key2[mine] == own_key(raw)
                edge = np.zeros(len(raw) + 1, np.int64)
                np.add.at(edge, low[mine][good], 1)
                np.add.at(edge, high[mine][good] + width - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                left = raw[~gone].tobytes()
                sizes.append(len(raw))
                removed.append(int(gone.sum()))
                n_spans.append(int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(gone) and bool(gone[0]))))
                shas.append(hashlib.sha256(left).hexdigest())
                kept.append(left if keep_text else None)
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in (sizes, removed, n_spans)), pa.array(shas, pa.string()), pa.array(kept, pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    done = X.with_notes(spans, suspects.select("k", "id", "body"), parts).mapInArrow(lean(cut_out), final)
    zero = F.lit(0).cast("long")
    clean = tried.where(F.col("noted").isNull()).select("id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), "kept_sha256", F.lit(None).cast("binary").alias("kept"))
    out = clean.unionByName(done)
    return (out if keep_text else out.drop("kept")).withColumnRenamed("id", id_col)
