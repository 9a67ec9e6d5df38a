from pyspark.sql import functions as F

from veilcheck.operators import native
from veilcheck.operators.kernel import Text, survey
from veilcheck.operators.screen import refusals

LETTERS = {"Bengali": "ক", "Tamil": "க", "Telugu": "క", "Ethiopic": "ሀ", "Khmer": "ក", "Myanmar": "က", "Kawi": "\U00011f04", "Cyrillic": "ж"}


def test_every_script_is_surveyed(spark, tables):
    texts = [f"{c * 3} abc {c}" for c in LETTERS.values()] + ["কж" + "a" * 15, "".join(LETTERS.values()) + "ab", "plain", "café", "́�", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("more", F.array(F.lit("x")))
    got = {(r.doc_id, r.letters, r.script, r.n) for r in native.surveyed(docs, "doc_id", "more").collect()}
    assert {(i, 7, s, 4) for i, s in enumerate(LETTERS)} <= got and {(8, 17, "Bengali", 1), (8, 17, "Cyrillic", 1)} <= got
    want = {(i, survey(Text(t, tables))[0], s, n) for i, t in enumerate(texts) if t for s, n in survey(Text(t, tables))[1].items()}
    assert got == want
    assert {r.script for r in native.surveyed(docs, "doc_id", scripts=("Tamil",)).collect()} == {"Tamil"}


def test_share_refuses_what_the_kernel_refuses(spark, tables):
    # a letter of each script alone, beside Cyrillic and below a tenth
    alone = {}
    for p in range(0x250, 0x20000):
        if tables.flags[p] & 1 and tables.script[p] > 3:
            alone[tables.scripts[tables.script[p]]] = chr(p)
    assert len(alone) > 150
    texts = [t for s, c in sorted(alone.items()) for t in (c, "ж" + c + "a" * 17, c + "a" * 20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in native.shares(docs, "doc_id").collect()}
    assert set(got) == set(range(len(texts)))
    assert {i for i, r in got.items() if r.refused} == {r.doc_id for r in refusals(docs).collect()}
    assert [got[i].scripts for i in range(0, len(texts), 3)] == sorted(alone)
    some = native.shares(docs, "doc_id", declared=("Cyrillic", "Tamil")).collect()
    assert {r.doc_id for r in some if r.refused} == {r.doc_id for r in refusals(docs, scripts=("Cyrillic", "Tamil")).collect()}
