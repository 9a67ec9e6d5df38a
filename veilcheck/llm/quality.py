"""Quality rules: counted signals, and a calibrated logistic regression on hashed n-grams.

The classifier sees the shares of hashed word 1- and 2-grams and character 2-
and 4-grams. It is fitted on a bounded, stratified sample of labelled texts;
a logistic curve fitted on texts that training leaves out, weighted back to the
labels' own shares, makes its scores probabilities. Texts are scored in Arrow
batches against fixed thresholds.
"""

from __future__ import annotations

import collections
import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from . import kernels as K
from .common import lean, type_of
from .ngrams import code_points, counts, hashed, mean_weight
from .sample import drawn

BITS = 15
#: (kind, n) of the n-gram groups.
GROUPS = (("word", 1), ("word", 2), ("char", 2), ("char", 4))
#: Labelled texts of each label that the model is fitted on at most: the bound of the sample.
ROWS_A_LABEL = 800
#: A text stays if its probability of being good is at least this: below it lay no good text of sf0.1 that its model had not learned from.
LEAST_GOOD = 0.4
_SCALE = 60.0


def groups(data: np.ndarray, offs: np.ndarray):
    """(buckets, offsets between documents) of each n-gram group."""
    _, _, firsts, words = K.word_hashes(data, offs, lower=True)
    points, places = code_points(data, offs)
    return [(hashed(words, firsts, n, BITS), firsts) if kind == "word" else (hashed(points, places, n, BITS), places) for kind, n in GROUPS]


def signals(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The counted signals of each document of a slice."""
    starts, ends, firsts = K.words(data, offs)
    sums = K.prefix(data)
    hashes = K.ranges_hash(sums, starts, ends)
    doc = K.owners(firsts)
    n = len(offs) - 1
    symbol = np.zeros(256, bool)
    symbol[list(b"#*$%&|<>")] = True
    lead = (data & 0xC0) != 0x80
    # lines: from a document's start or past a line feed, to a line feed or the document's end
    feeds = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate([offs[:-1], feeds + 1]))
    finish = np.sort(np.concatenate([feeds, offs[1:]]))
    # both come in order, a document's last line after its others
    home = np.repeat(np.arange(n), np.searchsorted(feeds, offs[1:]) - np.searchsorted(feeds, offs[:-1]) + 1)
    has_word = np.searchsorted(starts, finish) > np.searchsorted(starts, begin)
    begin, finish, home = begin[has_word], finish[has_word], home[has_word]
    keys = K.ranges_hash(sums, begin, finish) ^ K.mix(home.astype(K.U))
    first = np.zeros(len(keys), bool)
    first[np.unique(keys, return_index=True)[1]] = True
    at = K.valid_windows(firsts, 3)
    runs = K.windows(hashes, 3)[at] ^ K.mix(doc[at].astype(K.U) + K.U(1)) if len(at) else np.zeros(0, K.U)
    again = at[K.repeated(runs)]
    covered = np.zeros(len(starts), bool)
    for j in range(3):
        covered[again + j] = True
    return {
        "n_words": np.diff(firsts),
        "word_chars": K.sums_by(lead & ~K.white()[data], offs),
        "n_symbols": K.sums_by(symbol[data], offs),
        "n_dup_lines": np.bincount(home[~first], minlength=n),
        "n_repeat_words": K.sums_by(covered, firsts),
    }


def labelled(batches):
    """A mapInArrow function over (label, fold, text): label, fold, buckets and shares of each row."""
    for batch in batches:
        for lo, hi, data, offs in K.slices(batch.column(2)):
            each = [counts(b, firsts, BITS) for b, firsts in groups(data, offs)]
            at = [np.concatenate([each[g][d][0] + (g << BITS) for g in range(len(GROUPS))]).astype(np.int32) for d in range(hi - lo)]
            share = [np.concatenate([each[g][d][1] for g in range(len(GROUPS))]).astype(np.float32) for d in range(hi - lo)]
            yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], batch.column(1)[lo:hi], pa.array([x.tobytes() for x in at], pa.binary()), pa.array([x.tobytes() for x in share], pa.binary())], names=["label", "fold", "at", "share"])


def calibrate(score: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve that fits labels best, by damped Newton steps; targets are drawn in a little, as few rows can't prove certainty."""
    a, b = 1.0, 0.0
    if not len(score):
        return a, b
    n = np.array([(label == 0).sum(), (label == 1).sum()])
    target = np.where(label == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    x = np.stack([score, np.ones(len(score))])

    def loss(v):
        z = v @ x
        return float((weight * (np.logaddexp(0, z) - target * z)).sum())

    v = np.array([a, b])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(v @ x, -40, 40)))
        step = np.linalg.solve((x * (weight * p * (1 - p))) @ x.T + 1e-3 * np.eye(2), x @ (weight * (p - target)))
        size = 1.0
        while size > 1e-6 and loss(v - size * step) > loss(v):
            size /= 2
        v = v - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(v[0]), float(v[1])


def fit(rows: list, shares: dict[int, float], epochs: int = 12) -> np.ndarray:
    """Weights by bucket, a zero row after each group, and last the offset, as log odds of a good text. Fold 0 calibrates."""
    data = sorted(((int(r[0]), r[1], np.frombuffer(bytes(r[2]), np.int32), np.frombuffer(bytes(r[3]), np.float32)) for r in rows), key=lambda r: (r[0], r[1], len(r[2]), r[2].tobytes(), r[3].tobytes()))
    data = [data[i] for i in np.random.default_rng(11).permutation(len(data))]
    size = len(GROUPS) << BITS
    w, square, bias, bias_square = np.zeros(size), np.full(size, 1e-6), 0.0, 1e-6
    learn, held = [r for r in data if r[1]], [r for r in data if not r[1]]
    if len({r[0] for r in learn}) < 2 or not held:
        learn = data
    for _ in range(epochs):
        for label, _, at, share in learn:
            x = share * _SCALE
            p = 1 / (1 + np.exp(-np.clip(x @ w[at] + bias, -40, 40)))
            g = (p - label) * x + 1e-4 * w[at]
            square[at] += g * g
            w[at] -= 0.1 * g / np.sqrt(square[at])
            bias_square += (p - label) ** 2
            bias -= 0.1 * (p - label) / np.sqrt(bias_square)
    score = np.array([(share * _SCALE) @ w[at] + bias for _, _, at, share in held])
    label = np.array([r[0] for r in held], float)
    a, b = calibrate(score, label, np.array([1 / shares[r[0]] for r in held]))
    table = np.zeros((len(GROUPS), (1 << BITS) + 1), np.float32)
    table[:, :-1] = (a * _SCALE * w).reshape(len(GROUPS), -1)
    return np.append(table.reshape(-1), np.float32(a * bias + b))


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows_a_label: int = ROWS_A_LABEL):
    """fit() on rows_a_label texts of each label, 0 and 1, at most; None, with a warning, where there are no texts of both."""
    ship(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)").distinct()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    drawn_ = drawn(texts, rows_a_label, "quality", known)
    rows, sizes = [], {}
    if drawn_ is not None:
        picked, sizes = drawn_
        fold = F.pmod(F.xxhash64("draw", F.lit("fold")), F.lit(4)).cast("int")
        rows = picked.select("label", fold.alias("fold"), "text").mapInArrow(lean(labelled), "label int, fold int, at binary, share binary").collect()  # within drawn()'s bound
    found = collections.Counter(int(r[0]) for r in rows)
    if len(found) < 2:
        warnings.warn("no labelled texts of both labels: only the base rules judge", stacklevel=2)
        return None
    return fit(rows, {label: found[label] / sizes[label] for label in found})


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", least_good: float = LEAST_GOOD) -> DataFrame:
    """Signals and verdict of every whole text.

    Returns (id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, p_good). A text fails the base rules with fewer than 50
    words, or when more than half of its words lie in 3-word windows that it
    has twice or more; others stay if p_good is at least least_good. Null and
    empty texts have no word and fail. Labels other than 0 and 1, null ids and
    ids without a text are not learned from; an id with both labels counts for
    both, and repeated ids for all their texts. Without labelled texts of both
    labels every text that the base rules pass stays (p_good is null), with a
    warning. Equal rows get equal results; other columns are ignored; an empty
    table gives an empty one. A text of any length is taken whole.
    """
    spark = ship(docs.sparkSession)
    kind = type_of(docs, id_col)
    shared = spark.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def score(batches):
        model = shared.value
        step = (1 << BITS) + 1
        for batch in batches:
            for lo, hi, data, offs in K.slices(batch.column(1)):
                found = signals(data, offs)
                failed = (found["n_words"] < 50) | (100 * found["n_repeat_words"] > 50 * found["n_words"])
                if model is None:
                    p, kept = pa.nulls(hi - lo, pa.float64()), ~failed
                else:
                    total = model[-1] + sum(mean_weight(b, firsts, model[g * step : (g + 1) * step, None], BITS)[:, 0] for g, (b, firsts) in enumerate(groups(data, offs)))
                    good = 1 / (1 + np.exp(-np.clip(total, -40, 40)))
                    p, kept = pa.array(good), ~failed & (good >= least_good)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], *(pa.array(found[x].astype(np.int64)) for x in names), pa.array(failed), pa.array(kept), p], names=["id", *names, "base_failed", "kept", "p_good"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {kind}, {', '.join(f'{x} long' for x in names)}, base_failed boolean, kept boolean, p_good double"
    return rows.mapInArrow(lean(score), schema).withColumnRenamed("id", id_col)
