"""Exact nearest neighbours, multi-query search and the vector store as frames."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector as V

#: Rows of a block of vectors and of a block of queries, on average.
ROWS_BLOCK, QUERIES_BLOCK = 8192, 1024


def as_vector(values) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


@dataclass(frozen=True)
class VectorStore:
    """rows: node_id and vector. Inserts normalise (for the cosine metric always)."""

    rows: DataFrame
    dimensions: int
    metric: str = V.COSINE
    normalized: bool = True

    @classmethod
    def of(cls, rows: DataFrame, dimensions: int, metric: str = V.COSINE, normalize: bool = True) -> VectorStore:
        empty = rows.where(F.lit(False)).select("node_id", F.col("vector").cast("array<double>").alias("vector"))
        return cls(empty, dimensions, metric, normalize or metric == V.COSINE).insert(rows)

    def problems(self, rows: DataFrame) -> DataFrame:
        """Rows that can't be stored: wrong length, not finite, all zero."""
        return rows.where(~F.coalesce(V.is_valid(F.col("vector"), self.dimensions), F.lit(False)))

    def insert(self, rows: DataFrame, order: str | None = None) -> VectorStore:
        """Insert or replace by node_id; of several rows of one the last by the column
        `order` (without one: the largest vector, so reruns agree). Fails on invalid vectors."""
        fine = F.coalesce(V.is_valid(F.col("vector"), self.dimensions), F.lit(False))
        value = V.normalize(F.col("vector")) if self.normalized else V.doubles(F.col("vector"))
        error = F.raise_error(F.concat(F.lit("invalid vector of node "), F.col("node_id").cast("string")))
        new = rows.select("node_id", F.when(fine, value).otherwise(error.cast("array<double>")).alias("vector"), (F.col(order) if order else F.lit(0)).alias("_o"))
        new = new.groupBy("node_id").agg(F.max(F.struct("_o", "vector")).alias("m")).select("node_id", "m.vector")
        old = self.rows.join(new.select("node_id"), "node_id", "left_anti")
        return replace(self, rows=old.unionByName(new))

    def delete(self, ids: DataFrame) -> VectorStore:
        return replace(self, rows=self.rows.join(ids.select("node_id"), "node_id", "left_anti"))

    def get(self, node_id: int) -> DataFrame:
        return self.rows.where(F.col("node_id") == node_id)

    def has(self, ids: DataFrame) -> DataFrame:
        known = self.rows.select("node_id", F.lit(True).alias("_f"))
        return ids.join(known, "node_id", "left").select(*ids.columns, F.coalesce("_f", F.lit(False)).alias("found"))

    def clear(self) -> VectorStore:
        return replace(self, rows=self.rows.where(F.lit(False)))

    def stats(self) -> DataFrame:
        return self.rows.agg(F.count("*").alias("vectors"), F.lit(self.dimensions).alias("dimensions"), (F.count("*") * self.dimensions * 4).alias("bytes"))

    def distances(self, query) -> DataFrame:
        q = query if isinstance(query, Column) else as_vector(query)
        q = V.normalize(q) if self.normalized else q
        d = V.distance(self.metric, F.col("vector"), q)
        return self.rows.select("node_id", d.alias("distance"), V.similarity(self.metric, d).alias("similarity"))

    def search(self, query, k: int = 10, threshold: float | None = None, keep: Column | DataFrame | None = None) -> DataFrame:
        """node_id, distance, similarity of the k nearest. keep (a condition on node_id, or
        a frame of node_id) and threshold (least similarity) come before the choice of k.
        Ties go to the smaller node_id."""
        store = self
        if isinstance(keep, DataFrame):
            store = replace(self, rows=self.rows.join(keep.select("node_id"), "node_id", "left_semi"))
        elif keep is not None:
            store = replace(self, rows=self.rows.where(keep))
        hits = store.distances(query)
        if threshold is not None:
            hits = hits.where(F.col("similarity") >= threshold)
        return hits.orderBy("distance", "node_id").limit(k)

    def search_many(self, queries: DataFrame, k: int) -> DataFrame:
        """queries: query_id and vector, any number. query_id, node_id, distance and rank
        (from 1) of the k nearest to each; ties go to the smaller node_id.

        Vectors and queries are dealt into blocks by hash; a task multiplies a block of
        one with a block of the other and keeps k rows for each query, which then meet."""
        n, m = self.rows.count(), queries.count()
        n_x, n_y = max(1, -(-n // ROWS_BLOCK)), max(1, -(-m // QUERIES_BLOCK))
        q = V.normalize(F.col("vector")) if self.normalized else V.doubles(F.col("vector"))
        every = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
        rows = self.rows.select(F.col("node_id").alias("id"), "vector", F.lit(False).alias("asks"), F.pmod(F.xxhash64("node_id"), F.lit(n_x)).cast("int").alias("x"), every(n_y).alias("y"))
        asked = queries.select(F.col("query_id").cast("long").alias("id"), q.alias("vector"), F.lit(True).alias("asks"), every(n_x).alias("x"), F.pmod(F.xxhash64("query_id"), F.lit(n_y)).cast("int").alias("y"))
        return nearest_in_groups(rows.unionByName(asked), ["x", "y"], self.metric, k)

    def search_multi(self, queries: DataFrame, k: int, how: str = "min", threshold: float | None = None, keep: Column | None = None) -> DataFrame:
        """The k nearest by an aggregate (min, max, avg, sum) of a node's distances over
        those queries that have it among their 2k nearest. keep and threshold come after."""
        hits = self.search_many(queries, 2 * k)
        total = {"min": F.min, "max": F.max, "avg": F.avg, "sum": F.sum}[how]("distance")
        rows = hits.groupBy("node_id").agg(total.alias("distance"))
        rows = rows.withColumn("similarity", V.similarity(self.metric, F.col("distance")))
        if keep is not None:
            rows = rows.where(keep)
        if threshold is not None:
            rows = rows.where(F.col("similarity") >= threshold)
        return rows.orderBy("distance", "node_id").limit(k)


def nearest_in_groups(rows: DataFrame, by: list[str], metric: str, k: int) -> DataFrame:
    """rows: id, vector, asks and the grouping columns. query_id, node_id, distance and
    rank of the k rows nearest to each asking row over all groups that it is in (every
    row at most once with it). A group is what one task holds at once."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, *by).sortWithinPartitions(*by)

    def run(batches):
        for part in _grouped(batches, by):
            asks = part["asks"].to_numpy(zero_copy_only=False)
            if asks.all() or not asks.any():
                continue
            ids, flat = part["id"].to_numpy(), part["vector"].combine_chunks() if isinstance(part["vector"], pa.ChunkedArray) else part["vector"]
            v = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            order = np.argsort(ids[~asks], kind="stable")
            nodes, x = ids[~asks][order], v[~asks][order]
            for a in range(0, int(asks.sum()), 256):
                who, q = ids[asks][a : a + 256], v[asks][a : a + 256]
                d = distances(q, x, metric)
                near = np.argsort(d, axis=1, kind="stable")[:, :k]
                who = np.repeat(who, near.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(nodes[near.reshape(-1)]), pa.array(np.take_along_axis(d, near, axis=1).reshape(-1))], names=["query_id", "node_id", "distance"])

    found = dealt.mapInArrow(run, "query_id long, node_id long, distance double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "node_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def distances(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Distances of each row of q to each row of x."""
    products = q @ x.T
    if metric == V.COSINE:
        return 1 - products
    if metric == V.DOT:
        return -products
    return np.sqrt(np.maximum(0, (q * q).sum(axis=1)[:, None] - 2 * products + (x * x).sum(axis=1)[None, :]))


def _grouped(batches, by):
    """The rows of each group, from partitions sorted by the grouping columns."""
    key, waiting = None, []
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in by]
        start = 0
        for at, k in enumerate(zip(*columns)):
            if k != key:
                if at > start:
                    waiting.append(batch.slice(start, at - start))
                if waiting:
                    yield pa.Table.from_batches(waiting)
                key, waiting, start = k, [], at
        if batch.num_rows > start:
            waiting.append(batch.slice(start))
    if waiting:
        yield pa.Table.from_batches(waiting)


def fragments_to_compact(fragments: DataFrame, min_ratio: float = 0.3, most: int = 4, min_vectors: int = 10_000) -> DataFrame:
    """fragments: fragment_id, active, total, deleted. The sealed fragments to rewrite:
    the `most` with the largest share of deleted vectors, from min_ratio on; none if it
    is a single one with fewer than min_vectors (but some) live vectors."""
    ratio = F.col("deleted") / F.col("total")
    rows = fragments.where(~F.col("active") & (F.col("total") > 0)).withColumn("ratio", ratio).where(F.col("ratio") >= min_ratio)
    rows = rows.withColumn("live", F.col("total") - F.col("deleted")).orderBy(F.desc("ratio"), "fragment_id").limit(most)
    whole = Window.partitionBy()
    rows = rows.withColumn("_n", F.count("*").over(whole)).withColumn("_live", F.sum("live").over(whole))
    return rows.where((F.col("_live") >= min_vectors) | (F.col("_n") >= 2) | (F.col("_live") == 0)).select("fragment_id", "ratio", "live")


def compact(vectors: DataFrame, deleted: DataFrame, fragments: DataFrame) -> DataFrame:
    """vectors (fragment_id, node_id, vector) with the chosen fragments' live rows moved
    to one new fragment; other fragments stay."""
    chosen = fragments.select("fragment_id")
    stay = vectors.join(chosen, "fragment_id", "left_anti")
    top = vectors.agg(F.max("fragment_id")).first()[0]
    moved = vectors.join(chosen, "fragment_id", "left_semi").join(deleted.select("node_id"), "node_id", "left_anti")
    moved = moved.withColumn("fragment_id", F.lit(-1 if top is None else top) + 1)
    return stay.unionByName(moved.select(*stay.columns))
