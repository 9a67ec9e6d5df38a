"""Tokenising documents and packing them into sequences by best-fit decreasing.

Pieces are dealt in turn into groups of about GROUP_PIECES, each task beginning
at another group, and each group is packed by one task: longest first, each
into the open sequence with the least room that holds it. Sequences of one
group differ from the best of all by less than one in tens of thousands, so
nothing is gained by packing all in one task.
"""

from __future__ import annotations

import json
import math
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from . import kernels as K
from .common import keyed, lean, settled, type_of

#: Pieces that one task packs, about.
GROUP_PIECES = 200_000
#: Pieces of text whose ids a worker remembers.
REMEMBERED = 500_000

# How the tokenizer that pieces() follows prepares and splits a text, from its file.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower case of a byte, and its kind: 0 white space, 1 letter, 2 digit, 3 other; bytes from 0x80 are the letters U+00C0 to U+00FF."""
    low, kind = np.arange(256, dtype=np.uint8), np.full(256, 3, np.uint8)
    low[65:91] += 32
    low[0x80:0x9F] += 32
    low[0x97] = 0x97
    kind[[32, *range(9, 14)]] = 0
    kind[97:123] = kind[65:91] = 1
    kind[0x80:0xC0] = 1
    kind[[0x97, 0xB7]] = 3
    kind[48:58] = 2
    return low, kind


def pieces(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, starts and ends of the pieces, simple documents) of a slice.

    The tokenizer's pattern is a contraction ('s 't 're 've 'm 'll 'd), a run of
    letters, one digit, or a run of anything else but white space. That is
    found here for ASCII and the letters U+00C0 to U+00FF, whose first byte is
    0xC3; a document with any other character is not simple.
    """
    low_of, kind_of = _tables()
    n = len(data)
    before = np.concatenate([data[:1] * 0, data[:-1]])
    lead = data == 0xC3
    second = (data >= 0x80) & (data < 0xC0)
    odd = np.concatenate([[0], np.cumsum((data >= 0x80) & ~lead & ~(second & (before == 0xC3)))])
    simple = odd[offs[1:]] == odd[offs[:-1]]
    low = np.where(second & (before == 0xC3), low_of[data], np.where(data < 0x80, low_of[data], data))
    kind = kind_of[low]
    at = np.flatnonzero(lead[:-1])
    kind[at] = kind[at + 1]
    first = np.ones(n, bool)
    first[1:] = (kind[1:] != kind[:-1]) | ((kind[1:] == 2))
    first[offs[:-1][offs[:-1] < n]] = True
    # contractions: an apostrophe that begins a run takes letters that follow
    quote = np.flatnonzero((data == 39) & first)
    if len(quote):
        end = offs[np.searchsorted(offs, quote, "right")]
        padded = np.concatenate([low, np.zeros(3, np.uint8)])
        one, two = padded[quote + 1], padded[quote + 2]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8)) & (quote + 1 < end)
        long = (((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)) & (quote + 2 < end)
        for which, size in ((short, 2), (long, 3)):
            q = quote[which]
            first[q + 1] = False
            after = q + size
            inside = after < end[which]
            first[after[inside]] |= kind[after[inside]] == 1
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], n)
    word = kind[starts] != 0
    return low, starts[word], ends[word], simple


class Ids:
    """Ids of texts by a tokenizer that splits a text into pieces and encodes each alone.

    Such a tokenizer gives a piece the same ids wherever it stands, so each
    distinct piece is encoded once. Documents that pieces() calls simple, and
    that hold none of the tokenizer's special strings, are put together from
    their pieces' ids; any other goes to the tokenizer as it is, and so does
    every document where the tokenizer's own settings are not those that
    pieces() follows.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        how = json.loads(self.tokenizer.to_str())
        first = ((how["pre_tokenizer"] or {}).get("pretokenizers") or [None])[0]
        self.by_piece = how["normalizer"] == _NORMALIZER and first == _SPLIT
        self.forget()

    def forget(self):
        self.keys, self.codes = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.sizes = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)

    def learn(self, texts: list[str]) -> None:
        """Ids of new pieces, for the next codes."""
        known = len(self.keys)
        for lo in range(0, len(texts), 2000):
            some = texts[lo : lo + 2000]
            got = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            counts = np.bincount(np.array(got.word_ids, np.int64), minlength=len(some))
            if len(counts) != len(some):
                raise ValueError("the tokenizer splits text in another way than expected")
            while known + len(some) > len(self.starts):
                self.starts, self.sizes = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.sizes, 2 * len(self.sizes))
            while self.used + len(got.ids) > len(self.ids):
                self.ids = np.resize(self.ids, 2 * len(self.ids))
            self.ids[self.used : self.used + len(got.ids)] = got.ids
            self.sizes[known : known + len(some)] = counts
            self.starts[known : known + len(some)] = self.used + np.cumsum(counts) - counts
            self.used += len(got.ids)
            known += len(some)

    def of(self, data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
        """The ids of each document of a slice."""
        n = len(offs) - 1
        whole = data.tobytes()
        simple = np.zeros(n, bool)
        if self.by_piece and n:
            low, starts, ends, simple = pieces(data, offs)
            if any(x in whole for x in self.special):
                simple &= np.array([not any(x in whole[offs[d] : offs[d + 1]] for x in self.special) for d in range(n)])
        out: list = [None] * n
        if simple.any():
            if len(self.keys) > REMEMBERED:
                self.forget()
            firsts = np.searchsorted(starts, offs)
            mine = np.repeat(simple, np.diff(firsts))
            hashes = K.ranges_hash(K.prefix(low), starts, ends)
            own, where, inverse = np.unique(hashes[mine], return_index=True, return_inverse=True)
            place = np.searchsorted(self.keys, own)
            old = np.zeros(len(own), bool)
            old[place < len(self.keys)] = self.keys[place[place < len(self.keys)]] == own[place < len(self.keys)]
            codes = np.zeros(len(own), np.int32)
            codes[old] = self.codes[place[old]]
            new = np.flatnonzero(~old)
            if len(new):
                at = np.flatnonzero(mine)[where[new]]
                text = low.tobytes()
                self.learn([text[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
                codes[new] = np.arange(len(self.keys), len(self.keys) + len(new))
                keys = np.concatenate([self.keys, own[new]])
                order = np.argsort(keys, kind="stable")
                self.keys, self.codes = keys[order], np.concatenate([self.codes, codes[new]])[order]
            code = codes[inverse]
            sizes = self.sizes[code].astype(np.int64)
            after = np.cumsum(sizes)
            ids = self.ids[np.repeat(self.starts[code] - after + sizes, sizes) + np.arange(after[-1] if len(after) else 0)]
            edges = np.concatenate([[0], after])[np.concatenate([[0], np.cumsum(np.where(simple, np.diff(firsts), 0))])]
            for d in np.flatnonzero(simple):
                out[d] = ids[edges[d] : edges[d + 1]]
        for d in np.flatnonzero(~simple):
            text = whole[offs[d] : offs[d + 1]].decode(errors="replace")
            out[d] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return out


_ids: dict[str, Ids] = {}


def tokenise(path: str, most: int):
    """A mapInArrow function over (id, body): a row for each piece, with the task and its turn among the task's pieces."""

    def run(batches):
        if path not in _ids:
            _ids[path] = Ids(path)
        ids, turn, task = _ids[path], 0, TaskContext.get().partitionId()
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []

            def emit():
                n = len(row)
                turns = [pa.array(np.full(n, task, np.int32)), pa.array(np.arange(turn, turn + n))]
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), *turns], names=["id", "piece", "start", "length", "ids_crc32", "task", "turn"])

            every = ((lo + d, x) for lo, _, data, offs in K.slices(batch.column(1).cast(pa.large_binary()).cast(pa.large_string())) for d, x in enumerate(ids.of(data, offs)))
            for i, found in every:
                own = np.append(found, np.uint32(0)).astype("<u4")
                for p, at in enumerate(range(0, len(own), most)):
                    part = own[at : at + most]
                    row.append(i)
                    piece.append(p)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                if len(row) > 100_000:
                    yield emit()
                    turn += len(row)
                    row, piece, start, length, crc = [], [], [], [], []
            yield emit()
            turn += len(row)

    return run


def group_of(task: Column, turn: Column, groups: int) -> Column:
    """The group of a task's turn: tasks begin at multiples of the golden ratio, which lie evenly around the groups however many there are."""
    begin = F.floor(F.pmod(task * F.lit((5**0.5 - 1) / 2), F.lit(1.0)) * groups)
    return F.pmod(begin + turn, F.lit(groups)).cast("int")


class Room:
    """Open sequences by the room left in them, under a segment tree that counts those of each range of rooms."""

    def __init__(self, most: int):
        self.half = 1 << math.ceil(math.log2(most + 1))
        self.count = [0] * (2 * self.half)
        self.open: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        node = room + self.half
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """(room, sequence) of the tightest that holds so much, no longer open; None if none does."""
        count, node = self.count, size + self.half
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.half:
                node *= 2
                if not count[node]:
                    node += 1
        room = node - self.half
        while node:
            count[node] -= 1
            node >>= 1
        return room, self.open[room].pop()


def best_fit(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece; taken longest first, in the order given among equals."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room, n = Room(most), 0
    sizes = lengths.tolist()
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = sizes[i]
        found = room.take(size)
        if found is None:
            found, n = (most, n), n + 1
        left, own = found
        sequence[i], offset[i] = own, most - left
        if left > size:
            room.add(left - size, own)
    return sequence, offset


def pack(most: int):
    """A mapInArrow function over pieces dealt by group: the same with sequence_id and offset."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        order = [("bin_group", "ascending"), ("length", "descending"), ("ids_crc32", "ascending"), ("start", "ascending")]
        table = table.take(pa.compute.sort_indices(table, order))
        groups = table.column("bin_group").to_numpy()
        lengths = table.column("length").to_numpy()
        sequence, offset = np.zeros(len(groups), np.int64), np.zeros(len(groups), np.int64)
        edges = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1], True])
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            own, at = best_fit(lengths[lo:hi], most)
            sequence[lo:hi], offset[lo:hi] = own + (int(groups[lo]) << 32), at
        out = table.drop_columns(["bin_group"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
        yield from out.to_batches(max_chunksize=1 << 16)

    return run


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 2048, tokenizer: str | None = None, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pieces of documents' ids and their places in sequences of at most `most` tokens.

    Returns a row for each piece: (id, piece, start, length, ids_crc32,
    sequence_id, offset). A document's ids end with id 0, so null and empty
    texts are one piece of length 1. Only documents of more than `most` ids are
    cut, into pieces that any group may hold. Equal rows are packed each for
    itself; null ids are kept; equal lengths are packed in order of their ids'
    crc32. A text of any length is taken whole. Other columns are ignored; an
    empty table gives an empty one. `tokenizer` is the path of a file for the
    tokenizers library that executors can read.
    """
    ship(docs.sparkSession)
    kind = type_of(docs, id_col)
    rows = keyed(docs, id_col, text_col).select("id", "body")
    columns = f"id {kind}, piece int, start long, length long, ids_crc32 long"
    # written, so that they are counted and dealt without encoding a text twice
    pieces = settled(rows.mapInArrow(lean(tokenise(tokenizer or default_tokenizer(), most)), f"{columns}, task int, turn long"), "pieces")
    groups = max(1, math.ceil(pieces.count() / group_pieces))
    dealt = pieces.withColumn("bin_group", group_of(F.col("task"), F.col("turn"), groups)).drop("task", "turn")
    packed = dealt.repartitionById(groups, F.col("bin_group")).mapInArrow(lean(pack(most)), f"{columns}, sequence_id long, offset long")
    return packed.withColumnRenamed("id", id_col)
