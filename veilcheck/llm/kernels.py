"""Vectorised byte and word kernels shared by the text operators.

Every kernel works on a *slice*: the UTF-8 bytes of some documents laid end to
end (`data`, uint8) and the offsets between them (`offs`, one more than there
are documents). Nothing crosses a document's end. Slices hold about
SLICE_BYTES, or one document if that is longer, so memory follows the longest
document and never the partition.

A word is `[^\\x20\\x09-\\x0D]+`. Hashes are 64-bit sums of random byte values
times powers of an odd base, finished by a mixing step; two different strings
of a run share one with a probability near 2**-60 for each pair compared.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18
U = np.uint64
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@functools.lru_cache(maxsize=4)
def byte_values(lower: bool = False) -> np.ndarray:
    """A random odd 64-bit value for each byte; with lower, A-Z share those of a-z."""
    values = mix(np.arange(1, 257, dtype=U) * U(_BASE)) | U(1)
    if lower:
        values[65:91] = values[97:123]
    return values


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, from 0 to n at least."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, SLICE_BYTES + (SLICE_BYTES >> 2))
        up, down = np.full(size, _BASE, U), np.full(size, pow(_BASE, -1, 1 << 64), U)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)]
    return _powers[0], _powers[1]


@functools.lru_cache(maxsize=1)
def white() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[32, *range(9, 14)]] = True
    return table


def slices(column: pa.Array, most: int = SLICE_BYTES):
    """(first row, end row, data, offs) of each slice of a string column; nulls are empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + most, "right")) - 1)
        yield row, end, data[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each document the index of its first word (one more than documents)."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    inside = ~white()[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offs[(offs > 0) & (offs < n)]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def prefix(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """Running sums of byte values times powers, from the slice's start."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, U)
    np.cumsum(byte_values(lower)[data] * up[: len(data)], out=out[1:])
    return out


def ranges_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each range of bytes, equal for equal bytes wherever they are."""
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts])


def word_hashes(data: np.ndarray, offs: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """starts, ends, first word of each document, hash of each word."""
    starts, ends, firsts = words(data, offs)
    return starts, ends, firsts, ranges_hash(prefix(data, lower), starts, ends)


def windows(values: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` values (len - width + 1 of them), by doubling."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    out, done, power, size = None, 0, values, 1
    while True:
        if width & size:
            part = power[done : done + n] if out is not None else power[:n]
            out = part.copy() if out is None else out * U(pow(_BASE, size, 1 << 64)) + part
            done += size
        if done == width:
            return mix(out)
        power = power[:-size] * U(pow(_BASE, size, 1 << 64)) + power[size:]
        size *= 2


def valid_windows(firsts: np.ndarray, width: int) -> np.ndarray:
    """Starts of the windows of `width` items that lie within one document."""
    n = int(firsts[-1])
    if not n:
        return np.zeros(0, np.int64)
    room = np.repeat(firsts[1:], np.diff(firsts)) - np.arange(n)
    return np.flatnonzero(room >= width)


def owners(firsts: np.ndarray) -> np.ndarray:
    """The document of each item."""
    return np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))


def cover(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n items lie in a window of `width` at one of the starts."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, n), -1)
    return np.cumsum(edge[:-1]) > 0


def sums_by(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Sum of the values of each document; firsts as from words()."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return total[firsts[1:]] - total[firsts[:-1]]


def repeated(values: np.ndarray) -> np.ndarray:
    """Which values occur twice or more."""
    if len(values) < 2:
        return np.zeros(len(values), bool)
    order = np.argsort(values)
    same = values[order][1:] == values[order][:-1]
    out = np.zeros(len(values), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out
