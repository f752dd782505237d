"""Embedding near-dedup by spherical k-means cells, and exact top-k by the threshold algorithm."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, quoted, release, written
from .components import components, local_roots

#: Vectors, and bytes of them, that k-means is trained on at most; cells aimed at so many
#: vectors; cells, and bytes of their centres, at most.
SAMPLE, SAMPLE_BYTES, CELL, CELLS, CENTRE_BYTES = 1 << 16, 64 << 20, 1 << 14, 4096, 64 << 20
#: Rows, and bytes, of a block; a task holds two.
BLOCK, BLOCK_BYTES = 1 << 14, 8 << 20
#: Products, and bytes of vectors, that are made at once.
PRODUCTS, EMIT_BYTES = 1 << 22, 8 << 20


def usable(vector):
    """Neither null nor with null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & fine


def _matrix(column, dtype) -> np.ndarray:
    """Rows of a list column of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(dtype) if len(column) else np.zeros((0, 0), dtype=dtype)


def _unit(x: np.ndarray) -> np.ndarray:
    # Scaled first, so that squares neither overflow nor vanish.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """k unit centres of unit rows x; a centre without rows keeps its place."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), size=k, replace=False)].copy()
    for _ in range(rounds):
        cell = np.concatenate([(x[a : a + 4096] @ centres.T).argmax(axis=1) for a in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, x)
        norm = np.linalg.norm(sums, axis=1)
        moved = norm > 1e-12
        centres[moved] = sums[moved] / norm[moved, None]
    return centres


def _centres(classes: DataFrame, n: int) -> dict[int, np.ndarray]:
    """Centres for each length of which there are more than CELL vectors; shorter tables
    of a length are one cell. At most n / CELL rows of counts come to the driver, and a
    sample of SAMPLE vectors or SAMPLE_BYTES in all, shared out by the lengths' counts."""
    out = {}
    for r in classes.groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") > CELL).orderBy("w").collect():
        share = r["n"] / n
        most = int(share * min(SAMPLE, SAMPLE_BYTES // (8 * r["w"])))
        k = min(-(-r["n"] // CELL), int(CELLS * share), int(share * CENTRE_BYTES) // (8 * r["w"]), most)
        if k > 1:
            sample = classes.where(F.col("w") == r["w"]).orderBy(F.xxhash64("rep")).limit(most).select("v").toArrow().column("v").combine_chunks()
            out[r["w"]] = spherical_kmeans(_unit(_matrix(sample, np.float64)), k)
    return out


def assigned(ids, copies, x, centres, reach):
    """Record batches of bounded size: unit rows x in their own cell, and as guests in
    each cell of a smaller number that a vector that links with them may be in."""
    n, w = x.shape
    emit = max(1, EMIT_BYTES // (8 * w))

    def batch(rows, cell, guest):
        for a in range(0, len(rows), emit):
            part = slice(a, a + emit)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x[rows[part]].reshape(-1)), w).cast(pa.list_(pa.float64()))
            m = len(rows[part])
            columns = [pa.array(ids[rows[part]]), pa.array(copies[rows[part]]), pa.array(np.full(m, w, dtype=np.int32)), pa.array(cell[part].astype(np.int32)), pa.array(np.full(m, guest)), flat]
            yield pa.RecordBatch.from_arrays(columns, names=["rep", "copies", "w", "cell", "guest", "v"])

    if centres is None:
        yield from batch(np.arange(n), np.zeros(n, dtype=np.int32), False)
        return
    step = max(1, PRODUCTS // len(centres))
    for a in range(0, n, step):
        near = x[a : a + step] @ centres.T
        home = near.argmax(axis=1)
        rows = np.arange(len(near))
        yield from batch(a + rows, home, False)
        # Distances between centres, for the plane between two.
        gap = np.sqrt(np.maximum(0, 2 - 2 * centres[home] @ centres.T))
        np.subtract(near[rows, home][:, None], near, out=near)
        guest = near <= reach * gap
        guest &= np.arange(len(centres))[None, :] < home[:, None]
        r, c = np.nonzero(guest)
        yield from batch(a + r, c, True)


def link_vectors(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", cosine: float = 0.95, margin: float | None = None) -> DataFrame:
    """Near-duplicate groups of vectors: id, n_links, component_id and kept for each row.

    Vectors of one length link if their cosine in double precision is >= cosine; null and
    zero vectors and those with null or non-finite components link with nothing. n_links
    counts the other rows linked directly, component_id is the least id reachable, kept
    says that it is the row's own. Rows with a null id take no part (null component, not
    kept); repeated rows link with each other. An empty table gives an empty one.

    Equal vectors are one class first, counted, so a vector that a third of the rows
    share is one row. k-means is fitted, for each length with more than CELL classes, on a
    sample (see _centres); every class then goes to its nearest cell as resident, and as
    guest to each cell of a smaller number where a vector that links with it may live: two
    unit vectors that link are at most sqrt(2 - 2 cosine) apart, so a class farther than
    that from the plane between both centres has no partner there. This loses no pair; a
    smaller `margin` in place of that distance trades recall for guests (on directions
    without clusters, where the exact margin sends guests to most cells: 0.12 keeps about
    99.8 % at cosine 0.95 in 64 dimensions). Cells are cut into blocks of at most BLOCK
    rows and BLOCK_BYTES; a task multiplies two blocks, slice by slice, and returns counts
    and a spanning forest of its links, never the pairs."""
    spark = vectors.sparkSession
    prepare(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = vectors.select(quoted(id_col).cast("long").alias("id"), quoted(vector).cast("array<double>").alias("v"))
    fine = usable(F.col("v")) & (F.size("v") > 0) & F.exists("v", lambda x: x != 0) & F.col("id").isNotNull()
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    # -0.0 and 0.0 are one value to arithmetic, so to the hash as well.
    text = F.transform("v", lambda x: x + F.lit(0.0))
    rows = rows.withColumn("c1", F.when(F.col("fine"), F.xxhash64(F.lit(31), text))).withColumn("c2", F.when(F.col("fine"), F.xxhash64(F.lit(32), text)))
    classes = rows.where("fine").groupBy("c1", "c2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v"))
    classes = written(classes.select("rep", "copies", "c1", "c2", F.size("v").alias("w"), "v"), "vector-classes")
    n = classes.count()
    shared = spark.sparkContext.broadcast(_centres(classes, n))  # at most CELLS rows, CENTRE_BYTES
    reach = np.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-9 if margin is None else margin

    def assign(batches):
        centres = shared.value
        for batch in batches:
            ids, copies, widths = (batch.column(i).to_numpy() for i in range(3))
            for w in np.unique(widths):
                some = np.flatnonzero(widths == w)
                x = _unit(_matrix(batch.column(3).take(pa.array(some)), np.float64))
                yield from assigned(ids[some], copies[some], x, centres.get(int(w)), reach)

    placed = classes.select("rep", "copies", "w", "v").mapInArrow(assign, "rep long, copies long, w int, cell int, guest boolean, v array<double>")
    placed = written(placed, "vector-cells")
    sizes = placed.groupBy("w", "cell").agg(F.count(F.when(~F.col("guest"), 1)).alias("own"), F.count(F.when(F.col("guest"), 1)).alias("guests"))
    dealt = placed.join(sizes.where("own > 0"), ["w", "cell"])
    size = F.greatest(F.lit(64), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("w")))))
    own, guests = F.ceil(F.col("own") / size).cast("int"), F.ceil(F.col("guests") / size).cast("int")
    block = F.pmod(F.xxhash64("rep"), F.greatest(F.lit(1), F.when(F.col("guest"), guests).otherwise(own))).cast("int")
    dealt = dealt.withColumn("block", block)
    # x: a block of residents; y: a block of residents (y >= x) or, after them, of guests.
    spot = F.when(F.col("guest"), own + F.col("block")).otherwise(F.col("block"))
    as_left = F.transform(F.sequence(F.col("block"), own + guests - 1), lambda y: F.struct(F.col("block").alias("x"), y.alias("y")))
    before = F.when(F.col("guest"), own - 1).otherwise(F.col("block") - 1)
    as_right = F.when(before >= 0, F.transform(F.sequence(F.lit(0), before), lambda x: F.struct(x.alias("x"), F.col("spot").alias("y"))))
    pairs = F.when(F.col("guest"), as_right).otherwise(F.concat(as_left, F.coalesce(as_right, F.array().cast("array<struct<x:int,y:int>>"))))
    dealt = dealt.withColumn("spot", spot).select("rep", "copies", "w", "cell", "spot", "v", F.explode(pairs).alias("p"))
    dealt = dealt.select("rep", "copies", "w", "cell", "spot", "v", "p.x", "p.y")
    dealt = dealt.repartition(tasks, "w", "cell", "x", "y").sortWithinPartitions("w", "cell", "x", "y")

    def compare(batches):
        for (_, _, x, y), part in _groups(batches, ("w", "cell", "x", "y")):
            ids, copies = part["rep"].to_numpy(), part["copies"].to_numpy()
            v, spot = _matrix(part["v"], np.float64), part["spot"].to_numpy()
            # Rows in order of id, so that a root is the least id.
            by_id = np.argsort(ids)
            ids, copies, v, spot = ids[by_id], copies[by_id], v[by_id], spot[by_id]
            links, root = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))
            for i, j in _close(v, np.flatnonzero(spot == x), np.flatnonzero(spot == y), x == y, cosine):
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                apart = root[i] != root[j]
                if apart.any():
                    root = local_roots(len(root), root[i[apart]], root[j[apart]])[root]
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some]), pa.array(ids[root[some]])], names=["rep", "links", "root"])

    found = written(dealt.mapInArrow(compare, "rep long, links long, root long"), "vector-links")
    release(placed)
    roots = components(found.where("rep != root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    near = classes.drop("v", "w").join(links, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    near = near.select("c1", "c2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("component"))
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return rows.drop("v").join(near, ["c1", "c2"], "left").select(
        F.col("id").alias(id_col),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )


def _groups(batches, by):
    """Values of the columns `by` and their rows, from partitions sorted by them, over
    batch borders."""
    key, waiting = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in by]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for a, b in zip([0, *change], [*change, batch.num_rows]):
            k = tuple(int(c[a]) for c in columns)
            if k != key and waiting:
                yield key, pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
                waiting = []
            key = k
            waiting.append(batch.slice(a, b - a))
    if waiting:
        yield key, pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]


def _close(v, left, right, same, cosine):
    """Arrays of pairs of rows (one of left, one of right) with cosine >= cosine, in parts
    of bounded size. Products in single precision sort out, those in double precision decide."""
    single = v.astype(np.float32)
    rights = single[right].T.copy()
    step = max(1, PRODUCTS // max(1, len(right)))
    for a in range(0, len(left), step):
        some = left[a : a + step]
        i, j = np.nonzero(single[some] @ rights >= np.float32(cosine - 1e-5))
        i, j = some[i], right[j]
        if same:
            i, j = i[i < j], j[i < j]
        for b in range(0, len(i), 1 << 15):
            x, y = i[b : b + (1 << 15)], j[b : b + (1 << 15)]
            sure = np.einsum("ij,ij->i", v[x], v[y]) >= cosine
            if sure.any():
                yield x[sure], y[sure]


# -- exact top-k ---------------------------------------------------------------


class SortedLists:
    """Candidates as sorted lists by dimension, for Fagin's threshold algorithm.

    Equal vectors are one entry with its `most` least ids: with that many equal
    scores at smaller ids, further copies can't be among the `most` best. Components
    are whole numbers, in doubles where all scores are exact in them, else as objects."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, most: int):
        by_id = np.argsort(ids, kind="stable")
        ids, x = ids[by_id], x[by_id]
        if x.dtype == object:
            seen: dict[tuple, int] = {}
            back = np.array([seen.setdefault(tuple(r), len(seen)) for r in x], dtype=np.int64)
            self.x = np.array(list(seen), dtype=object).reshape(len(seen), -1)
        else:
            self.x, back = np.unique(x, axis=0, return_inverse=True)
        back = back.reshape(-1)
        by_entry = np.argsort(back, kind="stable")
        starts = np.searchsorted(back[by_entry], np.arange(len(self.x) + 1))
        self.ids = [ids[by_entry[a : min(b, a + most)]] for a, b in zip(starts[:-1], starts[1:])]
        self.order = np.argsort(self.x, axis=0, kind="stable").astype(np.int32)
        self.met = 0

    def top(self, own_id: int, q: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(score, id) of the k best other rows: score descending, id ascending.

        Goes down all lists together, each from the end that is best for the query;
        every entry met is scored in full. What hasn't been met scores at most the sum
        of the lists' current values; it stops when that can't beat the kth score."""
        x, n = self.x, len(self.x)
        dims, down = np.arange(len(q)), (q >= 0).astype(bool)
        met, depth, step, cut = np.zeros(n, dtype=bool), 0, max(4, k), None
        entries, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=x.dtype)
        while depth < n:
            stop = min(n, depth + step)
            fresh = np.zeros(n, dtype=bool)
            fresh[self.order[n - stop : n - depth, down].reshape(-1)] = True
            fresh[self.order[depth:stop, ~down].reshape(-1)] = True
            new = np.flatnonzero(fresh & ~met)
            met[new] = True
            entries, scores = np.concatenate([entries, new]), np.concatenate([scores, x[new] @ q])
            depth, step = stop, step * 2
            if len(entries) > k:
                # k + 1 entries score `cut` or more; one of them may be the query's own.
                cut = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1] if x.dtype != object else sorted(scores)[-k - 1]
                last = np.where(down, self.order[n - depth], self.order[depth - 1])
                if x[last, dims] @ q < cut or len(entries) == n:
                    break
        self.met += len(entries)
        best = range(len(entries)) if cut is None else np.flatnonzero((scores >= cut).astype(bool))
        found = sorted((-int(scores[b]), int(i)) for b in best for i in self.ids[entries[b]] if i != own_id)
        return [(-s, i) for s, i in found[:k]]


def top_k(
    vectors: DataFrame, queries, id_col: str = "vec_id", vector: str = "embedding", k: int = 10, scale: int = 1024, candidates_block: int = 8192, queries_block: int = 2048
) -> DataFrame:
    """The k best rows for each query row by integer inner product of floor(scale * x).

    queries: a condition on the rows. Returns query_id, rank (from 1), vec_id, score;
    ties go to the smaller id; the query's own id is no candidate. Candidates of a query
    are the vectors of its length. Vectors that are null, hold null or non-finite
    components, or have a null id take no part. Scores outside the long range are held at
    its ends. Fewer candidates than k: all of them. Repeated rows are candidates each.
    An empty table gives an empty one.

    Candidates of a length are dealt into blocks by a hash of their id, queries into
    blocks, too (of at most so many rows on average, and BLOCK_BYTES); a task runs the
    threshold algorithm for a block of queries over the sorted lists of a block of
    candidates. The k best of each block meet by query: at most k rows for each block of
    candidates."""
    spark = vectors.sparkSession
    prepare(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = vectors.select(quoted(id_col).cast("long").alias("id"), quoted(vector).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("is_query"))
    rows = rows.where(usable(F.col("v")) & F.col("id").isNotNull() & (F.size("v") > 0)).withColumn("w", F.size("v"))
    held = lambda most: F.greatest(F.lit(64), F.least(F.lit(most), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("w")))))
    # One row for each length.
    widths = rows.groupBy("w").agg(F.count("*").alias("n"), F.count(F.when(F.col("is_query"), 1)).alias("q")).where("q > 0")
    widths = widths.select("w", F.ceil(F.col("n") / held(candidates_block)).cast("int").alias("n_c"), F.ceil(F.col("q") / held(queries_block)).cast("int").alias("n_q"))
    rows = rows.join(widths, "w")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    x, y = F.pmod(F.xxhash64("id"), F.col("n_c")).cast("int").alias("x"), F.pmod(F.xxhash64(F.lit(2), "id"), F.col("n_q")).cast("int").alias("y")
    dealt = rows.select("w", "id", "v", F.lit(False).alias("is_query"), x, every("n_q").alias("y"))
    dealt = dealt.unionByName(rows.where("is_query").select("w", "id", "v", F.lit(True).alias("is_query"), every("n_c").alias("x"), y))
    dealt = dealt.repartition(tasks, "w", "x", "y").sortWithinPartitions("w", "x", "y")

    def search(batches):
        for _, part in _groups(batches, ("w", "x", "y")):
            ids, asks = part["id"].to_numpy(), part["is_query"].to_numpy(zero_copy_only=False)
            v = np.floor(scale * _matrix(part["v"], np.float64)) + 0.0
            if np.abs(v).max(initial=0) ** 2 * v.shape[1] >= 2**52:
                v = np.array([[int(a) for a in r] for r in v], dtype=object).reshape(v.shape)
            if asks.all():
                continue
            lists = SortedLists(ids[~asks], v[~asks], k + 1)
            out = [(int(i), int(c), max(-(1 << 63), min((1 << 63) - 1, s))) for i, q in zip(ids[asks], v[asks]) for s, c in lists.top(int(i), q, k)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["query_id", "vec_id", "score"])

    best = dealt.mapInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).alias("rank")
    return best.select("query_id", rank, "vec_id", "score").where(F.col("rank") <= k)
