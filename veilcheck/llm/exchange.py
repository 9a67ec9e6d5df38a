"""Packed exchanges: hashes grouped by a key, with a few rows for each pair of tasks.

A map task holds entries (hash, document, ...) in numpy arrays and sends one
binary row to each part of the hash space; a reduce task decodes the rows of
its part and sorts them. That moves about 8 + 16 bytes an entry where a row
would take 40 to 60 in memory, and the JVM handles thousands of rows instead
of hundreds of millions.

Parts follow spark.sql.shuffle.partitions, which a session sets by its data,
times PARTS_EACH, so a reduce task's memory follows the data of one part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .common import lean

PARTS_EACH = 1
#: Entries that a map task holds before it sends them.
FLUSH_BYTES = 24 << 20


def parts_of(spark: SparkSession) -> int:
    return max(8, int(ship(spark).conf.get("spark.sql.shuffle.partitions"))) * PARTS_EACH


def to_part(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The part of each hash: its high bits, so that the low ones stay free."""
    return ((hashes >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)


def pack(arrays: list[np.ndarray]) -> bytes:
    head = np.array([len(arrays), *(len(a) for a in arrays), *(ord(a.dtype.char) for a in arrays)], np.int64)
    return b"".join([head.tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])


def unpack(blob: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    head = np.frombuffer(blob, np.int64, 2 * n, 8)
    at, out = 8 * (2 * n + 1), []
    for count, code in zip(head[:n], head[n:], strict=True):
        kind = np.dtype(chr(int(code)))
        out.append(np.frombuffer(blob, kind, int(count), at))
        at += int(count) * kind.itemsize
    return out


PACKED = "part int, payload binary"
_SCHEMA = pa.schema([("part", pa.int32()), ("payload", pa.binary())])


def packed_row(part: int, arrays: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([pack(arrays)], pa.binary())], schema=_SCHEMA)


class Sender:
    """Gathers entries of documents; send() gives a row for each part.

    add() takes the documents' keys (one int64 a document), each entry's
    document and its part, and columns with a value for each entry. A payload
    is [keys, entries of each key, columns...], entries in the keys' order.
    """

    def __init__(self, parts: int):
        self.parts, self.size, self.known = parts, 0, 0
        self.keys: list[np.ndarray] = []
        self.entries: list[list[np.ndarray]] = []

    def add(self, keys: np.ndarray, doc: np.ndarray, part: np.ndarray, *columns: np.ndarray) -> bool:
        """True: send() is due."""
        if len(doc):
            self.keys.append(keys)
            self.entries.append([part.astype(np.int32), (doc + self.known).astype(np.int64), *columns])
            self.known += len(keys)
            self.size += sum(a.nbytes for a in self.entries[-1])
        return self.size >= FLUSH_BYTES

    def send(self):
        if not self.entries:
            return
        part, doc, *columns = [np.concatenate(x) for x in zip(*self.entries, strict=True)]
        keys = np.concatenate(self.keys)
        self.entries, self.keys, self.size, self.known = [], [], 0, 0
        order = np.lexsort((doc, part))
        bounds = np.searchsorted(part[order], np.arange(self.parts + 1))
        for p in np.flatnonzero(np.diff(bounds)):
            at = order[bounds[p] : bounds[p + 1]]
            used, counts = np.unique(doc[at], return_counts=True)
            yield packed_row(p, [keys[used], counts.astype(np.uint32), *(c[at] for c in columns)])


def key_part(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part that a document's key (an xxhash64) belongs to; key_part_sql is the same in Spark."""
    return to_part(keys.view(np.uint64), parts)


def key_part_sql(key, parts: int):
    return F.pmod(F.shiftrightunsigned(key, 40), F.lit(parts)).cast("int")


def with_notes(notes: DataFrame, docs: DataFrame, parts: int) -> DataFrame:
    """Packed notes and the documents they are about, by part, notes first: (part, kind 0 or 1, k, id, body).

    docs: (k, id, body binary). One shuffle brings both together; a reader
    holds the notes of one part and streams the documents. Bodies travel
    compressed, as they are most of what is shuffled.
    """

    def press(batches):
        pressed = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            bodies = pa.array([pressed.compress(x.as_py()) for x in batch.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), bodies], names=["k", "id", "body"])

    docs = docs.select("k", "id", "body").mapInArrow(lean(press), docs.select("k", "id", "body").schema)
    kind = docs.schema["id"].dataType
    left = notes.select("part", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("k"), F.lit(None).cast(kind).alias("id"), F.col("payload").alias("body"))
    right = docs.select(key_part_sql(F.col("k"), parts).alias("part"), F.lit(1).alias("kind"), "k", "id", "body")
    return left.unionByName(right).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "kind")


def read_with_notes(batches, most: int = 1 << 18):
    """(notes' payloads of the part, k, ids, bodies) for runs of documents of one part, about `most` bytes each."""
    part, notes, loose = None, [], zstandard.ZstdDecompressor()
    for batch in batches:
        parts, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        edges = np.flatnonzero((np.diff(parts) != 0) | (np.diff(kinds) != 0)) + 1
        for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(parts)], strict=True):
            if lo == hi:
                continue
            if parts[lo] != part:
                part, notes = parts[lo], []
            if kinds[lo] == 0:
                notes.extend(x.as_py() for x in batch.column(4)[lo:hi])
                continue
            at = lo
            while at < hi:
                bodies, size, end = [], 0, at
                while end < hi and (size < most or not bodies):
                    bodies.append(loose.decompress(batch.column(4)[end].as_py()))
                    size, end = size + len(bodies[-1]), end + 1
                yield notes, batch.column(2)[at:end].to_numpy(), batch.column(3)[at:end], pa.array(bodies, pa.large_binary())
                at = end


def deal(packed: DataFrame, parts: int) -> DataFrame:
    return packed.repartitionById(parts, F.col("part"))


def by_part(batches):
    """The payloads of this task, in lists by part."""
    found: dict[int, list[bytes]] = {}
    for batch in batches:
        for p, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found.setdefault(p, []).append(x.as_py())
    while found:
        yield found.popitem()[1]
