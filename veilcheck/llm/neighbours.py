"""Approximate nearest neighbours by an inverted multi-index.

Each half of the vectors is quantised by centroids of its own, so K centroids
a half make K * K cells. A query sorts both halves' centroids by distance (the
less the inner product, the farther) and walks the pairs in order of summed
distance with a heap, until the cells it has visited hold enough vectors;
those are then ranked by their exact inner products.

The index is dealt into shards by a hash of the vector, each with all cells,
so that a full cell is no task of its own; queries go to the shards in blocks.
"""

from __future__ import annotations

import heapq
import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .common import lean

#: Centroids of a half.
CENTROIDS = 64
#: Vectors that the centroids are fitted on, about: the bound of the sample.
SAMPLE = 4096
#: A query visits cells until they hold this share of all vectors, and this many times the neighbours that are asked for.
VISIT_SHARE, VISIT_TIMES = 0.5, 10
#: Queries in a block.
BLOCK = 64
#: Vectors that are multiplied at once: cells of fewer than SOME go together, one of more than MOST in pieces.
SOME, MOST = 512, 4096


def matrix(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, float64 rows) of a batch (id, vector) of vectors of dim components."""
    values = batch.column(1).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), values.reshape(-1, dim)


def halves(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = (rows.shape[1] + 1) // 2
    return rows[:, :cut], rows[:, cut:]


def nearest(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (rows @ centroids.T * 2 - (centroids**2).sum(1)).argmax(1)


def centroids(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's algorithm from distinct rows of the sample."""
    distinct = np.unique(rows, axis=0)
    out = distinct[np.random.default_rng(3).permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        own = nearest(rows, out)
        n = np.bincount(own, minlength=len(out))
        total = np.zeros_like(out)
        np.add.at(total, own, rows)
        out[n > 0] = total[n > 0] / n[n > 0, None]
    return out


def cells_of(rows: np.ndarray, index) -> np.ndarray:
    a, b = halves(rows)
    return nearest(a, index[0]) * len(index[1]) + (nearest(b, index[1]) if b.shape[1] else 0)


def walk(query: np.ndarray, index, sizes: np.ndarray, enough: float) -> np.ndarray:
    """The cells that a query visits: pairs of centroids in order of summed distance until their vectors are enough."""
    a, b = halves(query[None])
    da, db = -(a @ index[0].T)[0], -(b @ index[1].T)[0] if b.shape[1] else np.zeros(len(index[1]))
    oa, ob = np.argsort(da, kind="stable"), np.argsort(db, kind="stable")
    xa, xb, na, nb = da[oa].tolist(), db[ob].tolist(), len(oa), len(ob)
    heap, out, seen, done = [(xa[0] + xb[0], 0, 0)], [], 0, [0] * na
    size = sizes.reshape(na, nb)[np.ix_(oa, ob)].tolist()
    while heap and seen < enough:
        _, i, j = heapq.heappop(heap)
        out.append((i, j))
        seen += size[i][j]
        done[i] = j + 1  # of a row, pairs come one by one
        if j + 1 < nb and (i == 0 or done[i - 1] > j + 1):
            heapq.heappush(heap, (xa[i] + xb[j + 1], i, j + 1))
        if i + 1 < na and done[i + 1] == j:
            heapq.heappush(heap, (xa[i + 1] + xb[j], i + 1, j))
    pairs = np.array(out, np.int64)
    return oa[pairs[:, 0]] * nb + ob[pairs[:, 1]]


def chunks(begin: np.ndarray, n: int) -> list[tuple[int, int]]:
    """(first row, end row) of what is multiplied at once, of n rows in order of cells that begin at `begin`."""
    out, lo = [], 0
    for a, b in itertools.pairwise([*begin.tolist(), n]):
        if b - a >= SOME:
            if lo < a:
                out.append((lo, a))
            out += [(x, min(x + MOST, b)) for x in range(a, b, MOST)]
            lo = b
        elif b - lo >= SOME:
            out.append((lo, b))
            lo = b
    return out + [(lo, n)] * (lo < n)


def few_ids(ids: np.ndarray, rows: np.ndarray, most: int) -> np.ndarray:
    """Indices of up to `most` rows of each of the `most` smallest ids of each distinct row: ties go to the smaller id, so no other can be among the nearest, whichever one id a query leaves out."""
    key = np.array([xxhash.xxh3_64_intdigest(r.tobytes()) for r in rows], np.uint64)
    order = np.lexsort((ids, key))
    at, key, own = np.arange(len(order)), key[order], ids[order]
    new = np.r_[True, key[1:] != key[:-1]][: len(at)]
    new_id = new | np.r_[True, own[1:] != own[:-1]][: len(at)]
    nth = np.cumsum(new_id)
    rank = nth - nth[np.maximum.accumulate(np.where(new, at, 0))]
    copy = at - np.maximum.accumulate(np.where(new_id, at, 0))
    return order[(rank < most) & (copy < most)]


def exactly(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products that do not depend on which rows are taken together, as those of BLAS do."""
    return np.add.reduce(rows * query, axis=1)


def cut(score: np.ndarray, at: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, slack: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(score, at) in 2 * top columns that hold the `top` nearest of each query: where more are within rounding (slack) of the last, exact products and then ids decide."""
    last = np.partition(score, -top, axis=1)[:, -top]
    near = (score > -np.inf) & ~(score < (last - slack)[:, None])
    for i in np.flatnonzero(near.sum(axis=1) > 2 * top):
        some = np.flatnonzero(near[i])
        rest = np.lexsort((ids[at[i, some]], -exactly(queries[i], rows[at[i, some]])))[top:]
        near[i, some[rest]] = False
    score = np.where(near, score, -np.inf)
    keep = np.argpartition(-score, 2 * top - 1, axis=1)[:, : 2 * top]
    return np.take_along_axis(score, keep, 1), np.take_along_axis(at, keep, 1)


def search(vectors: DataFrame, is_query, top: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", share: float = VISIT_SHARE, least: int | None = None) -> DataFrame:
    """The `top` nearest of each query by inner product: (query_id, rank, vec_id, score).

    is_query is a condition over the columns of `vectors`. Candidates are all
    rows but those with the query's own id. Ties go to the smaller id; a query
    with fewer candidates gets them all. Null ids, and vectors that are null,
    empty, zero, hold a null or a non-finite component or have another length
    than most, take no part. A repeated query row gets its answers again; a
    repeated candidate row counts as often as it is there. Other columns are
    ignored; an empty table gives an empty one. Approximate: a neighbour in a
    cell that is not visited is missed. A query visits cells until they hold
    `share` of all vectors, and `least` (VISIT_TIMES * top), at any size of
    the table.
    """
    spark = vectors.sparkSession
    parts = X.parts_of(spark)
    v = F.col("v")
    some = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    usable = F.col("id").isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    good = some.where(usable)
    schema = "query_id long, rank int, vec_id long, score double"
    lengths = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    dim = lengths[0]
    good = good.where(F.size("v") == dim)
    picked = good.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1_000_000)) < min(1.0, SAMPLE / lengths[1]) * 1_000_000)
    sample = np.array([r[0] for r in picked.select("v").collect()] or [good.select("v").first()[0]], np.float64)
    k = min(CENTROIDS, max(1, len(sample) // 8))
    index = [centroids(h, k) if h.shape[1] else np.zeros((1, 0)) for h in halves(sample)]
    n_cells = len(index[0]) * len(index[1])

    def count(batches):
        n = np.zeros(n_cells, np.int64)
        for batch in batches:
            n += np.bincount(cells_of(matrix(batch, dim)[1], index), minlength=n_cells)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], names=["cell", "n"])

    sizes = np.zeros(n_cells, np.int64)
    for cell, n in good.select("id", "v").mapInArrow(lean(count), "cell long, n long").groupBy("cell").sum("n").collect():  # a row for each cell
        sizes[cell] = n
    shared = spark.sparkContext.broadcast((index, sizes))
    enough = max(VISIT_TIMES * top if least is None else least, share * sizes.sum())

    def shard(batches):
        index = shared.value[0]
        for batch in batches:
            ids, rows = matrix(batch, dim)
            at = few_ids(ids, rows, top + 1)
            ids, rows = ids[at], rows[at]
            part = np.array([xxhash.xxh3_64_intdigest(r.tobytes()) for r in rows], np.uint64) % np.uint64(parts)
            cell = cells_of(rows, index)
            for p in np.unique(part):
                mine = part == p
                yield X.packed_row(int(p), [ids[mine], cell[mine], rows[mine].ravel()])

    def ask(batches):
        index, sizes = shared.value
        held: list[tuple[int, np.ndarray, np.ndarray]] = []
        name = TaskContext.get().partitionId() << 32

        def send():
            seen = np.zeros((len(held), n_cells), bool)
            for i, h in enumerate(held):
                seen[i, h[2]] = True
            arrays = [np.array([h[0] for h in held], np.int64), np.concatenate([h[1] for h in held]), np.packbits(seen, axis=1).ravel(), np.array([name], np.int64)]
            for p in range(parts):
                yield X.packed_row(p, arrays)

        for batch in batches:
            ids, rows = matrix(batch, dim)
            for i, row in zip(ids, rows, strict=True):
                held.append((i, row, walk(row, index, sizes, enough)))
                if len(held) == BLOCK:
                    yield from send()
                    held, name = [], name + 1
        if held:
            yield from send()

    def answer(batches):
        part, shards, store = None, [], None
        for batch in batches:
            for p, kind, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if p != part:
                    part, shards, store = p, [], None
                found = X.unpack(blob.as_py())
                if kind == 0:
                    shards.append(found)
                    continue
                if not shards:
                    continue
                if store is None:
                    ids, cell, rows = (np.concatenate([s[i] for s in shards]) for i in range(3))
                    rows = rows.reshape(-1, dim)
                    at = few_ids(ids, rows, top + 1)
                    at = at[np.argsort(cell[at], kind="stable")]
                    ids, cell, rows = ids[at], cell[at], rows[at]
                    store = ids, rows, np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]), cell, np.linalg.norm(rows, axis=1).max()
                ids, rows, begin, cell, longest = store
                asked, queries, bits, name = found
                queries = queries.reshape(len(asked), dim)
                seen = np.unpackbits(bits.reshape(len(asked), -1), axis=1)[:, :n_cells].astype(bool)
                # twice what rounding can part two products
                slack = 4 * dim * np.finfo(float).eps * np.linalg.norm(queries, axis=1) * longest
                best_score, best_id = np.full((len(asked), 0), -np.inf), np.zeros((len(asked), 0), np.int64)
                # the vectors of a cell, or of some small ones, against the queries that visit any of them
                for a, b in chunks(begin, len(ids)):
                    visit = seen[:, cell[a:b]]
                    who = np.flatnonzero(visit.any(axis=1))
                    if not len(who):
                        continue
                    score = np.full((len(asked), b - a), -np.inf)
                    score[who] = np.where(visit[who] & (ids[a:b] != asked[who, None]), queries[who] @ rows[a:b].T, -np.inf)
                    best_score = np.concatenate([best_score, score], axis=1)
                    best_id = np.concatenate([best_id, np.broadcast_to(np.arange(a, b), score.shape)], axis=1)
                    if best_score.shape[1] > 4 * top:
                        best_score, best_id = cut(best_score, best_id, queries, ids, rows, slack, top)
                q, x = np.nonzero(best_score > -np.inf)
                at = best_id[q, x]
                exact = exactly(queries[q], rows[at])
                order = np.lexsort((ids[at], -exact, q))
                q, at, exact = q[order], at[order], exact[order]
                rank = np.arange(len(q)) - np.searchsorted(q, q)
                q, at, exact = q[rank < top], at[rank < top], exact[rank < top]
                yield pa.RecordBatch.from_arrays([pa.array(name), pa.array([X.pack([asked, np.bincount(q, minlength=len(asked)), ids[at], exact])], pa.binary())], names=["block", "payload"])

    def merge(batches):
        def rows(found):
            asked = found[0][0]
            row = np.concatenate([np.repeat(np.arange(len(asked)), f[1]) for f in found])
            ids, score = (np.concatenate([f[i] for f in found]) for i in (2, 3))
            order = np.lexsort((ids, -score, row))
            row, ids, score = row[order], ids[order], score[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            keep = rank < top
            return pa.RecordBatch.from_arrays([pa.array(asked[row[keep]]), pa.array((rank[keep] + 1).astype(np.int32)), pa.array(ids[keep]), pa.array(score[keep])], names=["query_id", "rank", "vec_id", "score"])

        block, found = None, []
        for batch in batches:
            for key, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if key != block and found:
                    yield rows(found)
                    found = []
                block = key
                found.append(X.unpack(blob.as_py()))
        if found:
            yield rows(found)

    stored = good.select("id", "v").mapInArrow(lean(shard), X.PACKED).select("part", F.lit(0).alias("kind"), "payload")
    asked = good.where("q").select("id", "v").mapInArrow(lean(ask), X.PACKED).select("part", F.lit(1).alias("kind"), "payload")
    dealt = stored.unionByName(asked).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "kind")
    found = dealt.mapInArrow(lean(answer), "block long, payload binary")
    return found.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(lean(merge), schema)
