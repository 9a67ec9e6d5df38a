import math
import random

import numpy as np
from pyspark.sql import functions as F

from veilcheck.llm import language
from veilcheck.llm.language import BITS, ORDERS


def buckets(text):
    data = np.frombuffer(text.encode(), np.uint8)
    each, _ = language.features(data, np.array([0, len(data)]))
    return {int(b) + (o << BITS) for o, found in enumerate(each) for b in found if b < 1 << BITS}


def test_frequencies_are_of_all_usable_rows(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("abcdé жh ") for _ in range(rng.randint(0, 60))), rng.choice(("aa", "bb"))) for i in range(400)]
    rows += [(900, None, "aa"), (901, "zzz", None), (902, "qqq", "bb")]
    got = {}
    monkeypatch.setattr(language, "fit", lambda rows, seen, total: got.update(rows=len(rows), seen=seen, total=total))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    language.train(frame, F.col("doc_id") != 902, "doc_id", "text", "lang", rows_a_language=20)
    want = np.zeros(len(ORDERS) << BITS)
    for _, text, _ in rows[:400]:
        want[list(buckets(text))] += 1
    assert got["total"] == 400 and got["rows"] < 100 and (got["seen"] == want).all()


def test_weights_take_the_frequencies_given():
    # two languages told apart by one bucket each; a bucket that more texts hold weighs less
    rows = [(label, fold, np.array([at], np.int32).tobytes(), np.ones(1, np.float32).tobytes()) for label, at in (("aa", 1), ("bb", 2)) for fold in (1, 2, 3, 4)]
    seen = np.zeros(len(ORDERS) << BITS)
    seen[[1, 2]] = 4
    few = language.fit(rows, seen, 8)[1]
    many = language.fit(rows, seen, 80_000)[1]
    assert few.shape == many.shape and not np.allclose(few[1], many[1]) and math.isfinite(many[1, 0])
