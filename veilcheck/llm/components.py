"""Connected components of a table of edges.

Tasks first reduce the edges they hold to forests. What is left goes to one
task if its number, counted, is within ONE_TASK (16 bytes an edge), and is
else solved by alternating large and small stars, where no task holds more
than its share.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .common import lean, settled

_MOST_ROUNDS = 60
#: Edges, after forests, that one task may join.
ONE_TASK = 2_000_000


def forest(batches):
    """A mapInArrow function over (a, b): a star for each component of the edges that the task holds."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = np.fromiter(parent, np.int64, len(parent))
    roots = np.fromiter(map(find, list(parent)), np.int64, len(parent))
    keep = nodes != roots
    for lo in range(0, int(keep.sum()), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[keep][lo : lo + (1 << 16)]), pa.array(roots[keep][lo : lo + (1 << 16)])], names=["a", "b"])


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the least node around it."""
    near = _both(edges)
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return near.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours, and itself, to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a")
    return moved.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(moved.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, label) for every node of edges (a, b) but the least of each component: label is that least node. Nodes are longs."""
    ship(edges.sparkSession)
    now = settled(edges.where("a <> b").select("a", "b").mapInArrow(lean(forest), "a long, b long"), "forests")
    if now.count() <= one_task:
        one = settled(now.coalesce(1).mapInArrow(lean(forest), "a long, b long"), "stars")
        return one.select(F.col("a").alias("node"), F.col("b").alias("label"))
    mark = None
    for _ in range(_MOST_ROUNDS):
        now = settled(_small(_large(now)), "stars")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label"))
        mark = seen
    raise RuntimeError("connected components did not settle")
