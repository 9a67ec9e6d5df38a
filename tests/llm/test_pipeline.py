import collections
import os

import pytest

import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.test_models import language_of
from veilcheck.llm import language, mixing, substrings
from veilcheck.llm.common import settled

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are not here")


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = settled(stage(spark, docs, DATA), name)
        seen[name] = (before, docs.collect())
        if name != "best_fit_packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    before, after = seen["language_id"]
    model = language.train(spark.createDataFrame(before, "doc_id long, text string, lang string, source string, n_chars long"), F.lit(True), "doc_id", "text", "lang")
    said = {r.doc_id: language_of(r.text, model) for r in before}
    kept = {i for i, (name, p) in said.items() if name != "und" and p >= 0.5}
    assert {r.doc_id for r in after} == kept and len(after) == len(kept) >= 0.95 * len(before) and set(after) <= set(before)
    before, after = seen["near_duplicates"]
    groups = brute.jaccard([(r.doc_id, r.text) for r in before], 5, 75)
    assert {r.doc_id for r in after} == {g[2] for g in groups} and len(after) == len({g[2] for g in groups})
    before, after = seen["substring_dedup"]
    want = {i: (n, gone) for i, n, gone, _ in brute.substrings([(r.doc_id, r.text) for r in before], 35)}
    texts = {r.doc_id: r.text for r in before}
    assert {r.doc_id for r in after} == {i for i, (n, gone) in want.items() if gone < n or not n}
    for r in after:
        n, gone = want[r.doc_id]
        assert len(brute.words(r.text)) == n - gone and (gone or r.text == texts[r.doc_id])
        assert not gone or r.n_chars == len(r.text)
    before, after = seen["mix_sources"]
    kept = {r.doc_id: r for r in before}
    times = collections.Counter(r.doc_id for r in after)
    assert set(times) <= set(kept) and max(times.values()) <= 3 and all(r == kept[r.doc_id] for r in after)
    plan = {r.doc_id: r for r in mixing.mixture(spark.createDataFrame(before, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert times == {i: r.times for i, r in plan.items() if r.times}
    words = collections.Counter()
    for r in after:
        words[r.source] += len(brute.words(r.text))
    targets, longest = {kept[i].source: r.target for i, r in plan.items()}, collections.Counter()
    for i, r in plan.items():
        longest[kept[i].source] = max(longest[kept[i].source], r.size)
    # a source of few documents misses its target by less than its longest
    assert set(words) <= set(targets) and all(abs(words[s] - t) <= longest[s] for s, t in targets.items())
    before, after = seen["best_fit_packing"]
    assert collections.Counter(r.doc_id for r in after if r.piece == 0) == collections.Counter(r.doc_id for r in before)


def test_run_is_the_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "substring_dedup", "mix_sources", "best_fit_packing"]
    assert corpus_pipeline.run(spark, DATA).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_registered_sql(spark):
    import duckdb

    from veilcheck.llm.queries import ORACLE_SQL, QUERIES

    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    duck = duckdb.connect()
    for f in os.listdir(DATA):
        duck.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    for name, sql in ORACLE_SQL.items():
        frame = QUERIES[name](spark, DATA)
        columns = sorted(frame.columns)
        result = duck.execute(sql)
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        key = lambda row: [(v is None, str(v)) for v in row]
        assert sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=key) == sorted((tuple(r[names.index(c)] for c in columns) for r in result.fetchall()), key=key)


def test_readers_hold_few_texts_at_once(spark, tmp_path):
    key, own, path = "spark.sql.parquet.columnarReaderBatchSize", spark.newSession(), str(tmp_path / "texts")
    own.conf.unset(key)
    own.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.lit("a few words").alias("text")).write.parquet(path)
    assert substrings.remove_repeats(own.read.parquet(path)).count() == 3000
    assert int(own.conf.get(key)) <= 256  # 4,096 texts before
    own.conf.set(key, "1000")  # what a session sets stays
    assert substrings.remove_repeats(own.read.parquet(path)).count() == 3000
    assert own.conf.get(key) == "1000"
