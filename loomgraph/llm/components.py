"""Connected components over an edge table of any size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import prepare, release, written

#: So many edges are a single task's work: two longs each, and no rounds.
FEW = 1 << 18


def _stated(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """edges as a table, and its number of rows and sum of hashes, told by the job that writes it."""
    seen = Observation()
    out = written(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")), "edges")
    told = seen.get
    return out, (told["n"], told["s"])


def _hung(batches):
    """Of the edges of a partition: each node with the least one it is connected with there."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if parts:
        nodes, back = np.unique(np.concatenate([x for pair in parts for x in pair]), return_inverse=True)
        ends = np.split(back, np.cumsum([len(x) for pair in parts for x in pair])[:-1])
        root = local_roots(len(nodes), np.concatenate(ends[::2]), np.concatenate(ends[1::2]))
        some = np.flatnonzero(root != np.arange(len(nodes)))
        for a in range(0, len(some), 1 << 16):
            part = some[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(nodes[part]), pa.array(nodes[root[part]])], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of an edge.

    edges: columns a and b (long, no nulls; repeated ones and loops are fine). Each task
    first hangs the nodes of its share of the edges under the least one they are connected
    with there. If at most FEW edges are left, one task does so with all of them, and that is
    it. More of them go through large-star and small-star steps in turn: each node links its larger neighbours, then its smaller ones, to the least
    node it knows, until every node hangs from its component's least node. Each round
    is one table in the shared folder; joins are plain equi-joins against one row a
    node, so a hub's edges can be split. Empty edges give an empty result."""
    prepare(edges.sparkSession)
    ends = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, state = _stated(ends.mapInArrow(_hung, "a long, b long"))
    if state[0] <= FEW:
        whole, _ = _stated(now.coalesce(1).mapInArrow(_hung, "a long, b long"))
        release(now)
        now, state = whole, (0, None)
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        small = small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a != b").distinct()
        after, told = _stated(small)
        release(now)
        before, state, now = state, told, after
        if state == before:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def local_roots(n: int, left, right):
    """Least index of each index's component among n, for edge arrays left, right."""
    root = np.arange(n)
    while len(left):
        least = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, left, least)
        np.minimum.at(root, right, least)
        np.minimum.at(root, before[left], least)
        np.minimum.at(root, before[right], least)
        while True:
            jump = root[root]
            if (jump == root).all():
                break
            root = jump
        if (root == before).all():
            break
    return root
