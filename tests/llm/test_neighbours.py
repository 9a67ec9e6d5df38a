import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilcheck.llm import neighbours, queries


def nearest(spark, ids, x, asked, **how):
    frame = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got: dict = {}
    for r in neighbours.search(frame, F.col("vec_id").isin(*asked), **how).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return got


def test_ties_at_the_edge_go_to_the_smaller_id(spark):
    gen = np.random.default_rng(5)
    # different vectors, all orthogonal to the query, and some that are nearer
    x = np.c_[np.zeros(1800), gen.integers(1, 1000, size=(1800, 7))]
    x[:6, 0] = [1, 1, 3, 2, 2, 2]
    ids = np.r_[7, gen.permutation(np.arange(100, 1899))]
    got = nearest(spark, ids, np.vstack([np.eye(8)[:1], x[1:]]), [7], share=1.0)[7]
    score = x[1:, 0]
    order = np.lexsort((ids[1:], -score))[:20]
    assert got == [(ids[1:][i], score[i]) for i in order]


def test_ties_of_binary_vectors(spark):
    gen = np.random.default_rng(6)
    x = gen.integers(0, 2, size=(1900, 24)).astype(float)
    x[:, 0] = 1
    ids = gen.permutation(1900)
    for q, found in nearest(spark, ids, x, range(0, 1900, 90), share=1.0).items():
        s = x @ x[ids == q][0]
        s[ids == q] = -1
        assert found == [(ids[i], s[i]) for i in np.lexsort((ids, -s))[:20]]


def test_a_repeated_query_leaves_its_equals(spark):
    same = np.ones((60, 4))
    ids = np.r_[np.zeros(25, int), np.arange(1, 36)]
    x = np.vstack([same, np.eye(4)])
    got = nearest(spark, np.r_[ids, 100, 101, 102, 103], x, [0, 3])
    assert [i for i, _ in got[3]] == [0] * 20
    # 25 query rows of id 0: each gets its answers
    assert sorted(got[0]) == [(i, 4.0) for i in range(1, 21) for _ in range(25)]


def test_recall_of_the_share_alone(spark):
    gen = np.random.default_rng(4)
    x = gen.normal(size=(3000, 16)).astype(np.float32).astype(float)
    asked = range(0, 3000, 20)
    found = {least: nearest(spark, range(3000), x, asked, least=least) for least in (0, None)}
    recall = dict.fromkeys(found, 0.0)
    for q in asked:
        s = x @ x[q]
        s[q] = -np.inf
        best = set(np.argsort(-s)[:20].tolist())
        for least, got in found.items():
            recall[least] += len(best & {i for i, _ in got[q]}) / 20 / len(asked)
    assert recall[0] >= 0.9


def test_chunks_of_cells():
    gen = np.random.default_rng(3)
    for sizes in ([1] * 3000, [5000, 1, 1, 600, 511, 1, 9000], gen.integers(1, 1500, 60).tolist(), [7], []):
        begin, n = np.cumsum([0, *sizes])[:-1], sum(sizes)
        got = neighbours.chunks(begin, n)
        assert [a for a, _ in got] + [n] * bool(got) == [0] * bool(got) + [b for _, b in got]
        ends = set(begin.tolist()) | {n}
        for a, b in got:
            inner = [x for x in begin.tolist() if a < x < b]
            assert b - a <= neighbours.MOST and (not inner or b - inner[-1] < neighbours.SOME) and (b in ends or b - a == neighbours.MOST)


DATA = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are not here")
def test_recall_over_all_queries(spark):
    """The registered query over the whole table of sf0.1 against brute force."""
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got: dict = {}
    for r in queries.op4_multi_index(spark, DATA).collect():
        got.setdefault(r.query_id, []).append(r)
    asked = ids[ids % 20 == 0]
    assert sorted(got) == sorted(asked.tolist())
    recall = 0.0
    for q in asked.tolist():
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        best = set(ids[np.lexsort((ids, -s))[:20]].tolist())
        found = sorted(got[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 21)) and [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        assert all(abs(r.score - s[ids == r.vec_id][0]) < 1e-9 for r in found)
        recall += len(best & {r.vec_id for r in found}) / 20 / len(asked)
    print("recall", recall)
    assert recall >= 0.9
