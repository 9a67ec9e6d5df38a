"""Hashed n-grams of documents and linear scores over them."""

from __future__ import annotations

import numpy as np

from . import kernels as K


def code_points(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of a slice and the offsets between its documents; what is not UTF-8 becomes U+FFFD."""
    try:
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        return points, lead[offs]
    except UnicodeDecodeError:
        texts = [data[a:b].tobytes().decode(errors="replace") for a, b in zip(offs[:-1], offs[1:], strict=True)]
        return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def hashed(values: np.ndarray, firsts: np.ndarray, size: int, bits: int) -> np.ndarray:
    """For each item the bucket of the run of `size` items that starts there; 1 << bits where a document ends before."""
    n = len(values)
    out = np.full(n, 1 << bits, np.int32)
    if n >= size:
        total = values[: n - size + 1].astype(K.U)
        for j in range(1, size):
            total = total * K.U(0x9E3779B97F4A7C15) + values[j : n - size + 1 + j].astype(K.U)
        total = (total ^ (total >> K.U(29))) * K.U(0xBF58476D1CE4E5B9)
        out[: n - size + 1] = (total >> K.U(64 - bits)).astype(np.int32)
    for j in range(1, size):
        ends = firsts[1:] - j
        out[ends[(ends >= firsts[:-1]) & (ends < n)]] = 1 << bits
    return out


def counts(buckets: np.ndarray, firsts: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket, share) of each document's n-grams."""
    out = []
    for a, b in zip(firsts[:-1], firsts[1:], strict=True):
        own, n = np.unique(buckets[a:b], return_counts=True)
        n = n[own < 1 << bits]
        own = own[own < 1 << bits]
        out.append((own, (n / max(1, n.sum())).astype(np.float32)))
    return out


def mean_weight(buckets: np.ndarray, firsts: np.ndarray, weights: np.ndarray, bits: int) -> np.ndarray:
    """For each document the mean of its n-grams' weights; weights has a row for each bucket and a last one of zeros."""
    sizes = np.diff(firsts)
    some = np.flatnonzero(sizes)
    out = np.zeros((len(sizes), weights.shape[1]))
    if len(some):
        for c in range(0, weights.shape[1], 8):
            got = np.take(weights[:, c : c + 8], buckets, axis=0)
            out[some, c : c + 8] = np.add.reduceat(got, firsts[:-1][some], axis=0, dtype=np.float64)
        valid = np.add.reduceat((buckets < 1 << bits).astype(np.int64), firsts[:-1][some])
        out[some] /= np.maximum(valid, 1)[:, None]
    return out
