"""The two classifiers against plain versions, and the samples they learn from."""

import collections
import math
import random
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from veilcheck.llm import kernels, language, quality, sample

M = (1 << 64) - 1
C = 0x9E3779B97F4A7C15


def mixed(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M
    return x ^ x >> 31


def buckets(values, size, bits):
    out = []
    for i in range(len(values) - size + 1):
        total = values[i]
        for v in values[i + 1 : i + size]:
            total = (total * C + v) & M
        out.append((total ^ total >> 29) * 0xBF58476D1CE4E5B9 % (1 << 64) >> 64 - bits)
    return out


def mean(found, weights):
    return sum(weights[b] for b in found) / len(found) if found else 0 * weights[0]


def plain(text):
    out = []
    for c in map(ord, text):
        if c < 128:
            c = c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 else 32
        elif 192 <= c < 223 and c != 215:
            c += 32
        out.append(c)
    return out


def language_of(text, model):
    """(language, probability) by dictionaries and sums, of one text."""
    languages, table = model
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    step = (1 << language.BITS) + 1
    total = table[-1].astype(float)
    for o, n in enumerate(language.ORDERS):
        total = total + mean(buckets(plain(text), n, language.BITS), table[o * step : (o + 1) * step].astype(float))
    e = [math.exp(x - max(total)) for x in total]
    best = max(range(len(e)), key=lambda i: (e[i], -i))
    return languages[best], e[best] / sum(e)


TEXTS = [None, "", "  ", "12 !", "a", "ab", "É× é", "日本", "hij KLM", "x" * 700, "\U0001f600 abc"]


def rows_of(seed, n=300):
    rng = random.Random(seed)
    letters = {"aa": "abcdefg", "bb": "hijklmn", "cc": "opqéжstu"}
    return [(i, " ".join("".join(rng.choice(letters[lang]) for _ in range(5)) for _ in range(rng.randint(1, 40))), lang) for i in range(n) for lang in [rng.choice(list(letters))]]


def test_language_against_a_plain_version(spark):
    rows = [*rows_of(1), *((1000 + i, t, None) for i, t in enumerate(TEXTS)), (2000, "hij " * 300_000, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = language.train(frame, F.lit(True), "doc_id", "text", "lang")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(frame).collect()}
    for i, text, _ in rows[:-1]:
        name, score = language_of(text, model)
        assert got[i][0] == name and abs(got[i][1] - score) < 1e-4
    assert got[2000][0] == "bb"


def test_leader_against_a_plain_version():
    rng = random.Random(2)
    model, z, n = language.Leader(6, 3), collections.Counter(), collections.Counter()

    def weight(i, c):
        if abs(z[i, c]) <= model.l1:
            return 0.0
        return -(z[i, c] - math.copysign(model.l1, z[i, c])) / ((model.beta + math.sqrt(n[i, c])) / model.alpha + model.l2)

    for _ in range(200):
        at = sorted(rng.sample(range(6), 3))
        x, label = [rng.random() for _ in at], rng.randrange(3)
        model.step(np.array(at), np.array(x), label)
        w = {(i, c): weight(i, c) for i in at for c in range(3)}
        e = [math.exp(sum(v * w[i, c] for i, v in zip(at, x, strict=True))) for c in range(3)]
        for i, v in zip(at, x, strict=True):
            for c in range(3):
                g = v * (e[c] / sum(e) - (c == label))
                z[i, c] += g - (math.sqrt(n[i, c] + g * g) - math.sqrt(n[i, c])) / model.alpha * w[i, c]
                n[i, c] += g * g
    assert np.allclose(model.weights(slice(None)), [[weight(i, c) for c in range(3)] for i in range(6)])


def word_hash(word):
    values, total = kernels.byte_values(True), 0
    for i, b in enumerate(word.encode()):
        total = (total + int(values[b]) * pow(C | 1, i, 1 << 64)) & M
    return mixed(total)


def good_of(text, model):
    words, points = [word_hash(w) for w in brute.words(text)], list(map(ord, text))
    step = (1 << quality.BITS) + 1
    total = float(model[-1])
    for g, (kind, n) in enumerate(quality.GROUPS):
        total += mean(buckets(words if kind == "word" else points, n, quality.BITS), model[g * step : (g + 1) * step].astype(float))
    return 1 / (1 + math.exp(-max(-40, min(40, total))))


def quality_rows():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words) + ("##" if i % 3 == 0 else "") for _ in range(rng.randint(45, 90))), int(i % 3 > 0)) for i in range(240)]
    return rows + [(500, None, 1), (501, "", 0), (502, "x " * 400_000, None), (503, "É # " * 40, None)]


def test_kept_against_a_plain_version(spark):
    rows = quality_rows()
    frame = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(3)
    labels = frame.where("doc_id % 2 = 0").select("doc_id", "quality")
    model = quality.train(frame, labels, "doc_id", "text", "quality")
    seen = collections.Counter()
    for r in quality.judge(frame.drop("quality"), labels).collect():
        text = next(t for i, t, _ in rows if i == r.doc_id) or ""
        if r.doc_id == 502:
            assert r.base_failed and not r.kept and r.n_words == 400_000
            continue
        p = good_of(text, model)
        assert abs(r.p_good - p) < 1e-4
        n, *_, repeats = brute.signals(text)
        failed = n < 50 or 100 * repeats > 50 * n
        assert r.base_failed == failed and (abs(p - quality.LEAST_GOOD) < 1e-3 or r.kept == (not failed and p >= quality.LEAST_GOOD))
        seen[r.kept] += 1
    assert min(seen[True], seen[False]) > 20


def test_sample_is_bounded_whatever_the_ids(spark):
    same = [(1, f"text {i % 700}", "aa") for i in range(5000)] + [(1, f"other {i}", "bb") for i in range(300)] + [(1, "copy", "cc")] * 3000
    frame = spark.createDataFrame(same, "id long, text string, label string").repartition(4)
    picked, sizes = sample.drawn(frame.select("label", "text"), 100, "x")
    got = [(r.label, r.text) for r in picked.collect()]
    assert sizes == {"aa": 5000, "bb": 300, "cc": 3000} and len(set(got)) == len(got)
    assert collections.Counter(x for x, _ in got) == {"aa": 100, "bb": 100, "cc": 1}
    again, _ = sample.drawn(frame.repartition(7).select("label", "text"), 100, "x")
    assert sorted(got) == sorted((r.label, r.text) for r in again.collect())
    assert sample.drawn(frame.where("false").select("label", "text"), 100, "x") is None
    joined, sizes = sample.drawn(frame.select("id", "text"), 50, "x", spark.createDataFrame([(1, 0), (1, 1), (2, 1)], "id long, label int"))
    assert collections.Counter(r.label for r in joined.collect()) == {0: 50, 1: 50} and sizes == {0: 8300, 1: 8300}


def test_too_many_labels_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(sample, "MOST_LABELS", 2)
    with pytest.raises(ValueError):
        sample.drawn(spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "label string, text string"), 5, "x")


@pytest.mark.parametrize("ids", [1, None])
def test_language_of_one_repeated_id(spark, ids):
    rows = [(ids, t, lang) for _, t, lang in rows_of(4, 400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.identify(frame).join(frame.withColumnRenamed("doc_id", "other").limit(0), F.lit(False), "left").collect()
    assert len(got) == 400 and {r.lang_pred for r in got} == {"aa", "bb", "cc"}
    held = language.predict_held_out(frame).collect()
    assert len(held) == 400 and len({r.held_out for r in held}) == 1
    one = spark.createDataFrame([(1, "copy of one text", "aa")] * 50, "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in language.identify(one).collect()} == {("aa", 1.0)}


def test_quality_of_repeated_ids_and_missing_labels(spark):
    rows = [(q, t, q) for _, t, q in quality_rows()[:240]]
    frame = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    labels = frame.select("doc_id", "quality")
    got = quality.judge(frame.drop("quality"), labels).where("not base_failed").collect()
    assert np.mean([r.kept == bool(r.doc_id) for r in got]) > 0.95
    absent = spark.range(1000, 3000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    for some in (absent, labels.where("quality = 1"), labels.where("quality = 1").unionByName(absent)):
        with warnings.catch_warnings(record=True) as said:
            warnings.simplefilter("always")
            kept = quality.judge(frame.drop("quality"), some).collect()
        assert any("both labels" in str(w.message) for w in said) and all(r.kept == (not r.base_failed) and r.p_good is None for r in kept)
