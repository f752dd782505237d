"""Approximate search: k-means, inverted lists, product quantisation and both together."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vector as V
from .knn import VectorStore, as_vector, nearest_in_groups

#: Rows that centroids are trained on at most. Everything is then assigned and encoded.
TRAIN_ROWS = 1 << 16
#: Rows of a block of a cluster in a search of many queries, on average.
CLUSTER_BLOCK = 8192
#: Below so many vectors, search is exact.
EXACT_BELOW = 1000


def default_clusters(n: int) -> int:
    return max(16, min(1024, math.isqrt(n)))


def default_subspaces(dimensions: int, most: int = 48) -> int:
    """The largest divisor of the dimensions that is at most `most`."""
    return max(m for m in range(1, min(most, dimensions) + 1) if dimensions % m == 0)


def kmeans(x: np.ndarray, k: int, rounds: int = 25, tolerance: float = 1e-4, metric: str = V.EUCLIDEAN, seed: int = 42) -> np.ndarray:
    """Lloyd's rounds from k-means++ starts; stops when the total distance changes by
    less than the tolerance, relatively. Empty clusters keep their centroids."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centres = np.empty((k, x.shape[1]))
    centres[0] = x[rng.integers(len(x))]
    near = ((x - centres[0]) ** 2).sum(axis=1)
    for i in range(1, k):
        total = near.sum()
        centres[i] = x[rng.choice(len(x), p=near / total) if total > 0 else rng.integers(len(x))]
        near = np.minimum(near, ((x - centres[i]) ** 2).sum(axis=1))
    last = None
    for _ in range(rounds):
        d = _all_distances(x, centres, metric)
        cell = d.argmin(axis=1)
        inertia = float(d[np.arange(len(x)), cell].sum())
        sums, counts = np.zeros_like(centres), np.bincount(cell, minlength=k)
        np.add.at(sums, cell, x)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
        if metric == V.COSINE:
            n = np.linalg.norm(centres, axis=1, keepdims=True)
            centres = np.where(n > V.TINY, centres / np.maximum(n, V.TINY), centres)
        if last is not None and abs(last - inertia) <= tolerance * max(abs(last), 1e-12):
            break
        last = inertia
    return centres


def _all_distances(x, centres, metric):
    products = x @ centres.T
    if metric == V.COSINE:
        return 1 - products
    if metric == V.DOT:
        return -products
    return np.maximum(0, (x * x).sum(axis=1)[:, None] - 2 * products + (centres * centres).sum(axis=1)[None, :])


def _sample(rows: DataFrame) -> np.ndarray:
    got = rows.select("vector").orderBy(F.xxhash64("node_id")).limit(TRAIN_ROWS).toArrow().column("vector").combine_chunks()
    return got.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(got), -1) if len(got) else np.zeros((0, 0))


@dataclass(frozen=True)
class IvfIndex:
    """Vectors with the cluster that each is nearest to. rows: node_id, vector, cluster."""

    store: VectorStore
    centroids: np.ndarray
    rows: DataFrame

    @classmethod
    def build(cls, store: VectorStore, clusters: int | None = None, seed: int = 42) -> IvfIndex:
        """Trained on at most TRAIN_ROWS vectors; all are assigned, in Arrow batches."""
        x = _sample(store.rows)
        n = store.rows.count()
        centroids = kmeans(x, clusters or default_clusters(n), metric=store.metric, seed=seed)
        return cls(store, centroids, assign(store.rows, centroids, store.metric))

    @property
    def spark(self) -> SparkSession:
        return self.store.rows.sparkSession

    def probes(self, query, n_probe: int) -> list[int]:
        q = _query(query, self.store)
        return np.argsort(_all_distances(q[None, :], self.centroids, self.store.metric)[0], kind="stable")[:n_probe].tolist()

    def search(self, query, k: int = 10, n_probe: int = 10, threshold: float | None = None, keep=None) -> DataFrame:
        """As the exact search, over the n_probe clusters nearest to the query. Written
        with partitionBy("cluster"), the filter on clusters prunes files."""
        near = self.rows.where(F.col("cluster").isin(self.probes(query, n_probe))).select("node_id", "vector")
        return VectorStore(near, self.store.dimensions, self.store.metric, self.store.normalized).search(query, k, threshold, keep)

    def search_many(self, queries: DataFrame, k: int = 10, n_probe: int = 10) -> DataFrame:
        """queries: query_id and vector, any number. query_id, node_id, distance and rank of
        the k nearest to each in its n_probe nearest clusters. Queries go to the blocks of
        the clusters that they probe, so no plan grows with their number; blocks of a
        cluster have CLUSTER_BLOCK rows on average."""
        centroids, metric, store = self.centroids, self.store.metric, self.store
        sizes = self.rows.groupBy("cluster").agg(F.ceil(F.count("*") / CLUSTER_BLOCK).cast("int").alias("blocks"))
        q = V.normalize(F.col("vector")) if store.normalized else V.doubles(F.col("vector"))
        asked = queries.select(F.col("query_id").cast("long").alias("node_id"), q.alias("vector"))
        near = lambda x, _: np.argsort(_all_distances(x, centroids, metric), axis=1, kind="stable")[:, :n_probe]
        asked = _map_vectors(asked, near, "probes", "array<int>", pa.list_(pa.int32())).select(F.col("node_id").alias("id"), "vector", F.explode("probes").alias("cluster"))
        asked = asked.join(sizes, "cluster").select("id", "vector", F.lit(True).alias("asks"), "cluster", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        block = F.pmod(F.xxhash64("node_id"), F.col("blocks")).cast("int")
        rows = self.rows.join(sizes, "cluster").select(F.col("node_id").alias("id"), "vector", F.lit(False).alias("asks"), "cluster", block.alias("block"))
        return nearest_in_groups(rows.unionByName(asked), ["cluster", "block"], metric, k)

    def search_multi(self, queries: list, k: int, n_probe: int = 10, how: str = "min", threshold: float | None = None, keep=None) -> DataFrame:
        asked = self.spark.createDataFrame([(i, [float(x) for x in q]) for i, q in enumerate(queries)], "query_id long, vector array<double>")
        return _merged(self.search_many(asked, 2 * k, n_probe), how, k, self.store.metric, threshold, keep)

    def insert(self, rows: DataFrame) -> IvfIndex:
        store = self.store.insert(rows)
        return IvfIndex(store, self.centroids, assign(store.rows, self.centroids, store.metric))

    def delete(self, ids: DataFrame) -> IvfIndex:
        return IvfIndex(self.store.delete(ids), self.centroids, self.rows.join(ids.select("node_id"), "node_id", "left_anti"))

    def stats(self) -> DataFrame:
        """Lists: total, empty, least, most and mean length."""
        counts = self.rows.groupBy("cluster").agg(F.count("*").alias("n"))
        k = len(self.centroids)
        return counts.agg(
            F.lit(k).alias("lists"),
            (F.lit(k) - F.count("*")).alias("empty"),
            F.when(F.count("*") < k, F.lit(0)).otherwise(F.min("n")).alias("least"),
            F.max("n").alias("most"),
            (F.sum("n") / k).alias("mean"),
        )

    def save(self, path: str) -> None:
        self.rows.write.mode("overwrite").partitionBy("cluster").parquet(f"{path}/lists")
        _save_matrix(self.spark, self.centroids, f"{path}/centroids")

    @classmethod
    def load(cls, spark: SparkSession, path: str, dimensions: int, metric: str = V.COSINE) -> IvfIndex:
        rows = spark.read.parquet(f"{path}/lists")
        store = VectorStore(rows.select("node_id", "vector"), dimensions, metric, metric == V.COSINE)
        return cls(store, _load_matrix(spark, f"{path}/centroids"), rows.select("node_id", "vector", "cluster"))


def _save_matrix(spark, m: np.ndarray, path: str) -> None:
    spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "i int, v array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def _load_matrix(spark, path: str) -> np.ndarray:
    return np.array([r["v"] for r in spark.read.parquet(path).orderBy("i").collect()])


def _query(query, store: VectorStore) -> np.ndarray:
    q = np.asarray(query, dtype=np.float64)
    if q.shape != (store.dimensions,) or not np.isfinite(q).all():
        raise ValueError("a query is a finite vector of the store's dimensions")
    n = np.linalg.norm(q)
    return q / n if store.normalized and n > V.TINY else q


def _merged(hits: DataFrame, how: str, k: int, metric: str, threshold, keep) -> DataFrame:
    total = {"min": F.min, "max": F.max, "avg": F.avg, "sum": F.sum}[how]("distance")
    rows = hits.groupBy("node_id").agg(total.alias("distance")).withColumn("similarity", V.similarity(metric, F.col("distance")))
    if keep is not None:
        rows = rows.where(keep)
    if threshold is not None:
        rows = rows.where(F.col("similarity") >= threshold)
    return rows.orderBy("distance", "node_id").limit(k)


def _map_vectors(rows: DataFrame, f, column: str, kind: str, arrow: pa.DataType) -> DataFrame:
    """rows (node_id, vector, ...) with a column made by f from a matrix of vectors, by Arrow batches."""
    names = rows.columns
    place = names.index("vector")
    schema = ", ".join([*(f"`{n}` {t}" for n, t in rows.dtypes), f"{column} {kind}"])

    def run(batches):
        for b in batches:
            v = b.column(place)
            x = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1) if len(v) else np.zeros((0, 1))
            made = f(x, b).tolist() if len(v) else []
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, arrow)], names=[*names, column])

    return rows.mapInArrow(run, schema)


def assign(rows: DataFrame, centroids: np.ndarray, metric: str) -> DataFrame:
    """rows with the nearest centroid's number as cluster."""
    return _map_vectors(rows.select("node_id", "vector"), lambda x, _: _all_distances(x, centroids, metric).argmin(axis=1), "cluster", "int", pa.int32())


@dataclass(frozen=True)
class PqIndex:
    """Product quantiser: codebooks (subspaces, centroids, width) and codes of vectors."""

    codebooks: np.ndarray
    rows: DataFrame | None = None

    @classmethod
    def train(cls, x: np.ndarray, subspaces: int | None = None, centroids: int = 256, seed: int = 42) -> PqIndex:
        m = subspaces or default_subspaces(x.shape[1])
        if x.shape[1] % m:
            raise ValueError("subspaces must divide the dimensions")
        parts = np.split(x, m, axis=1)
        return cls(np.stack([kmeans(p, min(centroids, len(x)), seed=seed + i) for i, p in enumerate(parts)]))

    def encode_matrix(self, x: np.ndarray) -> np.ndarray:
        return np.stack([_all_distances(p, c, V.EUCLIDEAN).argmin(axis=1) for p, c in zip(np.split(x, len(self.codebooks), axis=1), self.codebooks)], axis=1)

    def encode(self, rows: DataFrame, centroids: np.ndarray | None = None) -> PqIndex:
        """Codes of all rows; with centroids, of what is left after the row's cluster's."""

        def codes(x, batch):
            if centroids is not None:
                x = x - centroids[batch.column(batch.schema.get_field_index("cluster")).to_numpy()]
            return self.encode_matrix(x)

        return PqIndex(self.codebooks, _map_vectors(rows, codes, "codes", "array<int>", pa.list_(pa.int32())).drop("vector"))

    def decode_matrix(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([c[codes[:, i]] for i, c in enumerate(self.codebooks)], axis=1)

    def table(self, query: np.ndarray) -> np.ndarray:
        """Squared distances of the query's parts to all centroids, flat."""
        return np.concatenate([((c - q) ** 2).sum(axis=1) for c, q in zip(self.codebooks, np.split(query, len(self.codebooks)))])

    def stats(self) -> DataFrame:
        m, k, d = self.codebooks.shape
        return self.rows.agg(
            F.count("*").alias("vectors"), F.lit(m).alias("subspaces"), F.lit(k).alias("centroids"), F.lit(m * d).alias("dimensions"), F.lit(4.0 * d).alias("compression")
        )

    def cleared(self) -> PqIndex:
        return PqIndex(self.codebooks)

    def search(self, query, k: int = 10) -> DataFrame:
        q = np.asarray(query, dtype=np.float64)
        d = V.adc_distance(as_vector(self.table(q)), F.col("codes"), self.codebooks.shape[1])
        return self.rows.select("node_id", d.alias("distance")).orderBy("distance", "node_id").limit(k)


@dataclass(frozen=True)
class IvfPqIndex:
    """Inverted lists of codes. Distances are squared Euclidean between the query and the
    decoded vectors; the metric's formula turns them into similarities, as they are."""

    ivf: IvfIndex
    pq: PqIndex
    residuals: bool = False

    @classmethod
    def build(cls, store: VectorStore, clusters: int | None = None, subspaces: int | None = None, centroids: int = 256, residuals: bool = False, seed: int = 42) -> IvfPqIndex:
        ivf = IvfIndex.build(store, clusters, seed)
        x = _sample(store.rows)
        if residuals:
            x = x - ivf.centroids[_all_distances(x, ivf.centroids, store.metric).argmin(axis=1)]
        pq = PqIndex.train(x, subspaces, centroids, seed)
        return cls(ivf, pq.encode(ivf.rows, ivf.centroids if residuals else None), residuals)

    def search(self, query, k: int = 10, n_probe: int = 10, threshold: float | None = None, keep=None, rerank: bool = False) -> DataFrame:
        """node_id, distance, similarity. rerank replaces both by exact ones among 4k hits."""
        store = self.ivf.store
        q = _query(query, store)
        probes = self.ivf.probes(query, n_probe)
        rows = self.pq.rows.where(F.col("cluster").isin(probes))
        if keep is not None:
            rows = rows.where(keep)
        size = self.pq.codebooks.shape[1]
        if self.residuals:
            tables = F.create_map(*[c for p in probes for c in (F.lit(p), as_vector(self.pq.table(q - self.ivf.centroids[p])))])
            d = V.adc_distance(tables[F.col("cluster")], F.col("codes"), size)
        else:
            d = V.adc_distance(as_vector(self.pq.table(q)), F.col("codes"), size)
        hits = rows.select("node_id", d.alias("distance")).withColumn("similarity", V.similarity(store.metric, F.col("distance")))
        if threshold is not None and not rerank:
            hits = hits.where(F.col("similarity") >= threshold)
        if not rerank:
            return hits.orderBy("distance", "node_id").limit(k)
        near = hits.orderBy("distance", "node_id").limit(4 * k).select("node_id")
        return store.search(query, k, threshold, near)

    def search_multi(self, queries: list, k: int, n_probe: int = 10, how: str = "min", threshold: float | None = None, keep=None) -> DataFrame:
        hits = None
        for q in queries:
            h = self.search(q, 2 * k, n_probe).select("node_id", "distance")
            hits = h if hits is None else hits.unionByName(h)
        return _merged(hits, how, k, self.ivf.store.metric, threshold, keep)

    def delete(self, ids: DataFrame) -> IvfPqIndex:
        return IvfPqIndex(self.ivf.delete(ids), PqIndex(self.pq.codebooks, self.pq.rows.join(ids.select("node_id"), "node_id", "left_anti")), self.residuals)

    def save(self, path: str) -> None:
        self.ivf.save(path)
        self.pq.rows.write.mode("overwrite").partitionBy("cluster").parquet(f"{path}/codes")
        m, k, d = self.pq.codebooks.shape
        _save_matrix(self.ivf.spark, self.pq.codebooks.reshape(m * k, d), f"{path}/codebooks")

    @classmethod
    def load(cls, spark: SparkSession, path: str, dimensions: int, metric: str = V.COSINE, residuals: bool = False) -> IvfPqIndex:
        ivf = IvfIndex.load(spark, path, dimensions, metric)
        flat = _load_matrix(spark, f"{path}/codebooks")
        books = flat.reshape(dimensions // flat.shape[1], -1, flat.shape[1])
        return cls(ivf, PqIndex(books, spark.read.parquet(f"{path}/codes").select("node_id", "cluster", "codes")), residuals)


@dataclass(frozen=True)
class VectorIndex:
    """Exact below EXACT_BELOW vectors, IVF-PQ (or IVF) from there on."""

    store: VectorStore
    kind: str = "ivf_pq"
    index: IvfIndex | IvfPqIndex | None = None

    def build(self, seed: int = 42) -> VectorIndex:
        if self.store.rows.count() < EXACT_BELOW:
            return VectorIndex(self.store, self.kind, None)
        made = IvfIndex.build(self.store, seed=seed) if self.kind == "ivf" else IvfPqIndex.build(self.store, seed=seed)
        return VectorIndex(self.store, self.kind, made)

    def search(self, query, k: int = 10, threshold: float | None = None, n_probe: int = 10, keep=None) -> DataFrame:
        _query(query, self.store)
        if self.index is None:
            return self.store.search(query, k, threshold, keep)
        return self.index.search(query, k, n_probe, threshold, keep)

    def set(self, rows: DataFrame, order: str | None = None) -> VectorIndex:
        return VectorIndex(self.store.insert(rows, order), self.kind, None)

    def delete(self, ids: DataFrame) -> VectorIndex:
        return VectorIndex(self.store.delete(ids), self.kind, None)

    def get(self, node_id: int) -> DataFrame:
        return self.store.get(node_id)

    def has(self, ids: DataFrame) -> DataFrame:
        return self.store.has(ids)

    def __len__(self) -> int:
        return self.store.rows.count()

    def clear(self) -> VectorIndex:
        return VectorIndex(self.store.clear(), self.kind, None)

    def stats(self) -> DataFrame:
        """The store's row and whether an index is built."""
        return self.store.stats().withColumn("indexed", F.lit(self.index is not None))
