"""Substring dedup by difference-cover anchors.

A set D of residues is a difference cover of a period v if for any two
positions i, j there is a shift d < v with (i + d) mod v and (j + d) mod v
both in D. So any two equal windows of `width` words, wherever they start,
share a run of width - v + 1 words that starts at a covered position of both:
an *anchor*. Hashing anchors only, a quarter of the positions, finds every
document that can hold a repeated window; each anchor that occurs again is
then extended to the windows around it, whose own hashes decide.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import kernels as K
from .common import keyed, lean, settled, type_of

#: Perfect difference covers: each nonzero residue is one difference. Fixed values.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}


def period_for(width: int) -> int:
    """The longest period that leaves an anchor two fifths of the window."""
    return max((v for v in COVERS if width - v + 1 >= 0.4 * width), default=1)


def anchors(hashes: np.ndarray, firsts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, documents and hashes of the covered runs of each document that has a window."""
    v = period_for(width)
    length = width - v + 1
    doc = K.owners(firsts)
    n = np.diff(firsts)[doc]
    place = np.arange(len(hashes)) - firsts[doc]
    covered = np.zeros(v, bool)
    covered[list(COVERS.get(v, (0,)))] = True
    at = np.flatnonzero(covered[place % v] & (place + length <= n) & (n >= width))
    return at, doc[at], K.windows(hashes, length)[at] if len(at) else np.zeros(0, K.U)


def at_most_two(doc: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Indices that keep no more than two entries of a hash in a document: two show that it repeats."""
    if len(hashes) < 3:
        return np.arange(len(hashes))
    own = hashes ^ K.mix(doc.astype(K.U) + K.U(1))
    order = np.argsort(own, kind="stable")
    ordered = own[order]
    keep = np.ones(len(own), bool)
    keep[order[2:][ordered[2:] == ordered[:-2]]] = False
    return np.flatnonzero(keep)


def send_hashes(parts: int, pick):
    """A mapInArrow function over (k, body, ...): pick(batch, lo, hi, data, offs) gives (doc, hashes) of a slice."""

    def run(batches):
        out = X.Sender(parts)
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for lo, hi, data, offs in K.slices(batch.column(1).cast(pa.large_binary()).cast(pa.large_string())):
                doc, hashes = pick(batch, lo, hi, data, offs)
                keep = at_most_two(doc, hashes)
                doc, hashes = doc[keep], hashes[keep]
                if out.add(keys[lo:hi], doc, X.to_part(hashes, parts), hashes):
                    yield from out.send()
        yield from out.send()

    return run


def note_repeats(parts: int):
    """A mapInArrow function over dealt hashes: for each document those that occur twice or more, packed by its key's part."""

    def run(batches):
        out = X.Sender(parts)
        for blobs in X.by_part(batches):
            found = [X.unpack(b) for b in blobs]
            again = K.repeated(np.concatenate([x[2] for x in found]))
            at = 0
            for keys, counts, hashes in found:
                hit = np.flatnonzero(again[at : at + len(hashes)])
                at += len(hashes)
                doc = np.repeat(np.arange(len(keys)), counts)[hit]
                if out.add(keys, doc, X.key_part(keys, parts)[doc], hashes[hit]):
                    yield from out.send()
        yield from out.send()

    return run


def noted(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted (key, hash) of a part's notes."""
    if not payloads:
        return np.zeros(0, np.int64), np.zeros(0, K.U)
    found = [X.unpack(b) for b in payloads]
    keys = np.concatenate([np.repeat(x[0], x[1]) for x in found])
    hashes = np.concatenate([x[2] for x in found])
    order = np.argsort(keys, kind="stable")
    return keys[order], hashes[order]


class Notes:
    """The noted hashes of a part's documents, looked up by key."""

    def __init__(self):
        self.of, self.size, self.keys, self.hashes = None, -1, None, None

    def load(self, payloads: list[bytes]):
        if self.of is not payloads or self.size != len(payloads):
            self.of, self.size = payloads, len(payloads)
            self.keys, self.hashes = noted(payloads)
        return self

    def get(self, key: int) -> np.ndarray:
        lo, hi = np.searchsorted(self.keys, key), np.searchsorted(self.keys, key, "right")
        return self.hashes[lo:hi]


def stretches(text: bytes, starts: np.ndarray, ends: np.ndarray, stay: np.ndarray):
    """The pieces of a text that hold runs of words that stay; the whole text if all do."""
    if stay.all():
        return [text]
    first = np.flatnonzero(stay & ~np.r_[False, stay[:-1]])
    last = np.flatnonzero(stay & ~np.r_[stay[1:], False])
    return [text[starts[i] : ends[j]] for i, j in zip(first, last, strict=True)]


def digest(parts) -> str:
    return hashlib.sha256(b" ".join(parts)).hexdigest()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 35, keep_text: bool = False) -> DataFrame:
    """Words that lie in a window of `width` words whose sequence also starts anywhere else.

    Returns (id, n_words, n_removed, kept_sha256[, kept]): kept is what is left
    of the text, each cut closed by a line feed, and the text itself where
    nothing was removed; the digest is of the words left, joined by one space.
    Windows are judged
    on the input. Null and empty texts have no word, remove nothing and give
    the digest of nothing. Equal rows are two
    documents: each repeats the other. A null id is an id like any other. Other
    columns are ignored; an empty table gives an empty one.

    Two rounds: anchors that occur twice are noted to their documents, whose
    windows around them then go by their own hash; windows that occur twice
    are noted again. A document is read with its notes; no group of equal
    windows or pairs of documents is ever gathered.
    """
    spark = docs.sparkSession
    parts, kind = X.parts_of(spark), type_of(docs, id_col)
    rows = keyed(docs, id_col, text_col)
    period = period_for(width)

    def pick_anchors(batch, lo, hi, data, offs):
        _, _, firsts, hashes = K.word_hashes(data, offs)
        return anchors(hashes, firsts, width)[1:]

    notes = X.deal(rows.select("k", "body").mapInArrow(lean(send_hashes(parts, pick_anchors)), X.PACKED), parts).mapInArrow(lean(note_repeats(parts)), X.PACKED)

    first_schema = f"id {kind}, n_words long, n_removed long, kept_sha256 string, k long, body binary, spans binary"

    def extend(batches):
        book = Notes()
        for payloads, keys, ids, bodies in X.read_with_notes(batches):
            book.load(payloads)
            for lo, hi, data, offs in K.slices(bodies.cast(pa.large_string()), 1 << 30):
                starts, ends, firsts, hashes = K.word_hashes(data, offs)
                at, doc, runs = anchors(hashes, firsts, width)
                bounds = np.searchsorted(doc, np.arange(hi - lo + 1))
                n_words, shas, texts, spans = np.diff(firsts), [], [], []
                for d in range(hi - lo):
                    mine = book.get(keys[lo + d])
                    hit = at[bounds[d] : bounds[d + 1]][np.isin(runs[bounds[d] : bounds[d + 1]], mine)] - firsts[d] if len(mine) else at[:0]
                    if not len(hit):
                        raw = data[offs[d] : offs[d + 1]].tobytes()
                        shas.append(digest(raw.split()))
                        texts.append(raw if keep_text else None)
                        spans.append(None)
                        continue
                    n = n_words[d]
                    low = np.maximum(hit - period + 1, 0)
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, low, 1)
                    np.add.at(edge, hit + 1, -1)
                    may = np.flatnonzero(np.cumsum(edge)[: n - width + 1] > 0)
                    cut = np.flatnonzero(np.diff(may) != 1)
                    shas.append(None)
                    texts.append(data[offs[d] : offs[d + 1]].tobytes())
                    spans.append(X.pack([may[np.r_[0, cut + 1]].astype(np.int32), may[np.r_[cut, len(may) - 1]].astype(np.int32) + 1]))
                yield pa.RecordBatch.from_arrays([ids[lo:hi], pa.array(n_words, pa.int64()), pa.array(np.zeros(hi - lo, np.int64)), pa.array(shas, pa.string()), pa.array(keys[lo:hi]), pa.array(texts, pa.binary()), pa.array(spans, pa.binary())], names=["id", "n_words", "n_removed", "kept_sha256", "k", "body", "spans"])

    tried = settled(X.with_notes(notes, rows, parts).mapInArrow(lean(extend), first_schema), "substrings")
    suspects = tried.where(F.col("spans").isNotNull())

    def inside(spans: bytes) -> np.ndarray:
        low, high = X.unpack(spans)
        return np.concatenate([np.arange(a, b) for a, b in zip(low, high, strict=True)])

    def pick_windows(batch, lo, hi, data, offs):
        _, _, firsts, hashes = K.word_hashes(data, offs)
        long = K.windows(hashes, width)
        places = [inside(batch.column(2)[lo + d].as_py()) for d in range(hi - lo)]
        doc = np.repeat(np.arange(hi - lo), [len(x) for x in places])
        return doc, long[np.concatenate(places) + firsts[doc]]

    notes2 = X.deal(suspects.select("k", "body", "spans").mapInArrow(lean(send_hashes(parts, pick_windows)), X.PACKED), parts).mapInArrow(lean(note_repeats(parts)), X.PACKED)
    final_schema = f"id {kind}, n_words long, n_removed long, kept_sha256 string, kept binary"

    def cut_out(batches):
        book = Notes()
        for payloads, keys, ids, bodies in X.read_with_notes(batches):
            book.load(payloads)
            for lo, hi, data, offs in K.slices(bodies.cast(pa.large_string()), 1 << 30):
                starts, ends, firsts, hashes = K.word_hashes(data, offs)
                long = K.windows(hashes, width)
                removed, shas, kept = [], [], []
                for d in range(hi - lo):
                    a, b = firsts[d], firsts[d + 1]
                    gone = K.cover(np.flatnonzero(np.isin(long[a : max(a, b - width + 1)], book.get(keys[lo + d]))), width, b - a)
                    removed.append(int(gone.sum()))
                    raw = data[offs[d] : offs[d + 1]].tobytes()
                    left = raw.split()
                    if removed[-1]:
                        left = [left[i] for i in np.flatnonzero(~gone)]
                    shas.append(digest(left))
                    kept.append(b"\n".join(stretches(raw, starts[a:b] - offs[d], ends[a:b] - offs[d], ~gone)) if keep_text else None)
                yield pa.RecordBatch.from_arrays([ids[lo:hi], pa.array(np.diff(firsts), pa.int64()), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(kept, pa.binary())], names=["id", "n_words", "n_removed", "kept_sha256", "kept"])

    done = X.with_notes(notes2, suspects.select("k", "id", "body"), parts).mapInArrow(lean(cut_out), final_schema)
    clean = tried.where(F.col("spans").isNull()).select("id", "n_words", "n_removed", "kept_sha256", F.col("body").alias("kept"))
    out = clean.unionByName(done)
    columns = [F.col("id").alias(id_col), "n_words", "n_removed", "kept_sha256"]
    return out.select(*columns, F.col("kept").cast("string").alias("kept")) if keep_text else out.select(*columns)
