"""Language identification by a multinomial logistic regression on character n-grams.

Features are the shares of hashed 1- to 3-grams times their inverse document
frequency. The model is trained by follow-the-regularised-leader with an
elastic net, so that most weights are zero, on a bounded sample of labelled
texts, while document frequencies are those of all labelled rows; a temperature
fitted on a part of the sample that training leaves out makes its scores
probabilities.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from . import kernels as K
from .common import lean, type_of
from .ngrams import code_points, counts, hashed, mean_weight
from .sample import drawn

BITS = 14
ORDERS = (1, 2, 3)
#: Labelled texts of a language that a model is fitted on at most: the bound of the sample.
ROWS_A_LANGUAGE = 500
_SCALE = 50.0


def plain(points: np.ndarray) -> np.ndarray:
    """Lower-case Latin-1 letters; ASCII that is no letter becomes a space."""
    table = np.arange(256, dtype=np.uint32)
    table[:128] = 32
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    table[192:223] += 32
    table[215] = 215
    return np.where(points < 256, table[np.minimum(points, 255)], points)


def features(data: np.ndarray, offs: np.ndarray):
    """(buckets of each order, offsets between documents)."""
    points, firsts = code_points(data, offs)
    points = plain(points)
    return [hashed(points, firsts, n, BITS) for n in ORDERS], firsts


def labelled(batches):
    """A mapInArrow function over (label, fold, text): the label, fold, buckets and shares of each row."""
    for batch in batches:
        for lo, hi, data, offs in K.slices(batch.column(2)):
            buckets, firsts = features(data, offs)
            each = [counts(b, firsts, BITS) for b in buckets]
            at = [np.concatenate([each[o][d][0] + (o << BITS) for o in range(len(ORDERS))]).astype(np.int32) for d in range(hi - lo)]
            share = [np.concatenate([each[o][d][1] for o in range(len(ORDERS))]) for d in range(hi - lo)]
            yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], batch.column(1)[lo:hi], pa.array([x.tobytes() for x in at], pa.binary()), pa.array([x.tobytes() for x in share], pa.binary())], names=["label", "fold", "at", "share"])


def frequencies(batches):
    """A mapInArrow function over (text): of each bucket of every order, how many of the task's texts hold it."""
    found, last = np.zeros(len(ORDERS) << BITS, np.int64), np.zeros((1 << BITS) + 1, np.int64)
    for batch in batches:
        for _, _, data, offs in K.slices(batch.column(0)):
            buckets, firsts = features(data, offs)
            for o, each in enumerate(buckets):
                for a, b in zip(firsts[:-1], firsts[1:], strict=True):
                    own, at = each[a:b], np.arange(b - a)
                    last[own] = at
                    once = own[last[own] == at]  # the last place of each
                    found[once[once < 1 << BITS] + (o << BITS)] += 1
    at = np.flatnonzero(found)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(found[at])], names=["bucket", "n"])


class Leader:
    """Follow-the-regularised-leader with an elastic net, for any number of classes."""

    def __init__(self, size: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01):
        self.z, self.n = np.zeros((size, classes)), np.zeros((size, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def step(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = softmax(x @ w)
        p[label] -= 1
        g = x[:, None] * p
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] += g * g


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """What scores are best divided by: the least log loss over a fixed grid."""
    if not len(scores):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.25), np.log(20), 121))
    loss = [-np.log(np.maximum(softmax(scores / t)[np.arange(len(labels)), labels], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(rows: list, seen: np.ndarray, total: int, epochs: int = 4) -> tuple[list[str], np.ndarray]:
    """Languages and the weight of each bucket (the last row of each order is zero) from rows of labelled(); fold 0 calibrates. seen is in how many of `total` texts each bucket is."""
    languages = sorted({r[0] for r in rows})
    code = {x: i for i, x in enumerate(languages)}
    rows = sorted(((code[r[0]], r[1], np.frombuffer(bytes(r[2]), np.int32), np.frombuffer(bytes(r[3]), np.float32)) for r in rows), key=lambda r: (r[0], r[1], len(r[2]), r[2].tobytes(), r[3].tobytes()))
    rows = [rows[i] for i in np.random.default_rng(7).permutation(len(rows))]
    size = len(ORDERS) << BITS
    idf = np.log((1 + total) / (1 + seen)) + 0.1
    learn = [r for r in rows if r[1]] or rows
    held = [r for r in rows if not r[1]]
    model = Leader(size + 1, len(languages))
    for _ in range(epochs):
        for label, _, at, share in learn:
            model.step(np.append(at, size), np.append(share * idf[at] * _SCALE, 1.0), label)
    w = model.weights(slice(None))
    scores = np.array([(share * idf[at] * _SCALE) @ w[at] + w[size] for _, _, at, share in held])
    t = temperature(scores, np.array([r[0] for r in held], np.int64))
    table = np.zeros((len(ORDERS), (1 << BITS) + 1, len(languages)), np.float32)
    table[:, :-1] = (w[:size] * idf[:, None] * _SCALE / t).reshape(len(ORDERS), 1 << BITS, -1)
    # every order's means add up, so the bias may ride on the first
    return languages, np.concatenate([table.reshape(-1, len(languages)), (w[size:] / t).astype(np.float32)])


def train(docs: DataFrame, usable: Column, id_col: str, text_col: str, lang_col: str, rows_a_language: int = ROWS_A_LANGUAGE):
    """fit() on rows_a_language texts of each language of the usable rows at most; document frequencies are counted over all usable rows. None without such rows."""
    ship(docs.sparkSession)
    known = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("label"), usable.alias("use")).where("use and label is not null and text is not null")
    found = drawn(known.select("label", "text"), rows_a_language, "language")
    if found is None:
        return None
    picked, sizes = found
    fold = F.pmod(F.xxhash64("draw", F.lit("fold")), F.lit(5)).cast("int")
    rows = picked.select("label", fold.alias("fold"), "text").mapInArrow(lean(labelled), "label string, fold int, at binary, share binary").collect()  # within drawn()'s bound
    seen = np.zeros(len(ORDERS) << BITS)
    for bucket, n in known.select("text").mapInArrow(lean(frequencies), "bucket long, n long").groupBy("bucket").sum("n").collect():  # a row for each bucket
        seen[bucket] = n
    return fit(rows, seen, sum(sizes.values()))


def named(texts: pa.Array, model):
    """(first row, end row, languages, probabilities) of each slice of a column of texts."""
    languages, table = model
    bias, step = table[-1], (1 << BITS) + 1
    for lo, hi, data, offs in K.slices(texts):
        buckets, firsts = features(data, offs)
        total = bias + sum(mean_weight(b, firsts, table[o * step : (o + 1) * step], BITS) for o, b in enumerate(buckets))
        p = softmax(total)
        best = p.argmax(axis=1)
        low = data | 0x20
        letter = K.sums_by((low >= 97) & (low <= 122) & (data < 0x80), offs) > 0
        for d in np.flatnonzero(~letter):
            letter[d] = any(c.isalpha() for c in data[offs[d] : offs[d + 1]].tobytes().decode(errors="replace"))
        yield lo, hi, [languages[b] if ok else "und" for b, ok in zip(best, letter, strict=True)], np.where(letter, p[np.arange(hi - lo), best], 0.0)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", learn_from: Column | None = None) -> DataFrame:
    """The language of every whole text: (id, lang_pred, score).

    The model learns from rows with a text, a language and, if given,
    learn_from (a condition over docs' columns); a prediction sees the text
    only. score is the calibrated probability of lang_pred. A text that is null
    or has no letter is `und` with score 0, and so is every text when there is
    no row to learn from. Ties go to the language that sorts first. Ids may be
    null or repeated: they play no part. Other columns are ignored; an empty
    table gives an empty one. Equal rows get equal results. A text of any
    length is taken whole; the model has MOST_LABELS languages at most, and
    more are an error.
    """
    spark = ship(docs.sparkSession)
    kind = type_of(docs, id_col)
    model = train(docs, F.lit(True) if learn_from is None else F.coalesce(learn_from, F.lit(False)), id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if model is None:
        return rows.select(F.col("id").alias(id_col), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = spark.sparkContext.broadcast(model)

    def predict(batches):
        for batch in batches:
            for lo, hi, names, score in named(batch.column(1), shared.value):
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(names, pa.string()), pa.array(score)], names=["id", "lang_pred", "score"])

    return rows.mapInArrow(lean(predict), f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs whose text identify() names a language for with a probability of `least` or more; none without rows to learn from."""
    spark = ship(docs.sparkSession)
    shared = spark.sparkContext.broadcast(train(docs, F.lit(True), id_col, text_col, lang_col))
    place = docs.columns.index(text_col)

    def keep(batches):
        if shared.value is not None:
            for batch in batches:
                for lo, hi, names, score in named(batch.column(place), shared.value):
                    good = [n != "und" and s >= least for n, s in zip(names, score, strict=True)]
                    yield batch.slice(lo, hi - lo).filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(lean(keep), docs.schema)


def predict_held_out(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """identify() that learns from rows whose crc32 of the id as text is not 2 modulo 4; held_out tells the others. A null id is learned from by no model and held out by none."""
    out = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2
    named = identify(docs, id_col, text_col, lang_col, ~out)
    return named.select(id_col, F.coalesce(out, F.lit(False)).alias("held_out"), "lang_pred", "score")
