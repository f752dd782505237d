"""Near-dedup of vectors and exact top-k, against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm.components import components, local_roots
from loomgraph.llm.vectors import link_vectors, top_k


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(600, 16))
    base /= np.linalg.norm(base, axis=1)[:, None]
    near = base[:100] + rng.normal(size=(100, 16)) * 0.06
    x = np.concatenate([base, near, np.repeat(base[:1], 300, axis=0), base[1] + rng.normal(size=(250, 16)) * 0.03, np.zeros((2, 16)), base[:3] * 1e30]).astype("float32")
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [float("nan")] * 16, 1), (n + 2, [1.0] + [float("inf")] * 15, 1), (n + 3, [None] * 16, 1), (n + 4, [1.0, 2.0], 1), (n + 5, [], 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, kept int").repartition(5).persist(), x.astype(float)


@pytest.mark.parametrize("cosine", [0.95, 0.8])
def test_links(monkeypatch, table, cosine):
    from loomgraph.llm import vectors

    monkeypatch.setattr(vectors, "CELL", 100)
    monkeypatch.setattr(vectors, "BLOCK", 90)
    monkeypatch.setattr(vectors, "PRODUCTS", 3000)
    df, x = table
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in link_vectors(df, cosine=cosine).collect()}
    size = np.abs(x).max(axis=1)
    unit = x / np.where(size > 0, size, 1)[:, None]
    unit /= np.where(size > 0, np.linalg.norm(unit, axis=1), 1)[:, None]
    near = unit @ unit.T >= cosine
    np.fill_diagonal(near, False)
    roots = local_roots(len(x), *np.nonzero(near))
    for i in range(len(x)):
        assert got[i] == (near[i].sum(), roots[i], roots[i] == i), i
    for i in range(len(x), len(x) + 6):
        assert got[i] == (0, i, True)


def test_links_of_few(spark, table):
    df, _ = table
    assert link_vectors(df.where("false")).count() == 0
    assert [tuple(r) for r in link_vectors(df.where("embedding is null")).collect()] == [(df.count() - 6, 0, df.count() - 6, True)]
    twice = spark.createDataFrame([(None, [1.0, 0.0]), (4, [1.0, 0.0]), (4, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = sorted(map(tuple, link_vectors(twice).collect()), key=str)
    assert got == sorted([(None, 0, None, False), (4, 1, 4, True), (4, 1, 4, True)], key=str)


def test_margin_trades_recall(table):
    """A smaller margin only loses links, and few."""
    df, x = table
    exact = sum(r["n_links"] for r in link_vectors(df).collect())
    fast = sum(r["n_links"] for r in link_vectors(df, margin=0.12).collect())
    assert 0.9 * exact <= fast <= exact


def test_top_k(table):
    df, x = table
    got = {}
    for r in top_k(df, F.col("vec_id") % 50 == 0, candidates_block=300, queries_block=7).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    whole = [[int(np.floor(1024 * float(c))) for c in v] for v in x]
    for q in range(0, len(x), 50):
        best = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(whole[q], v)))), i) for i, v in enumerate(whole) if i != q)[:10]
        assert got[q] == [(k + 1, i, -s) for k, (s, i) in enumerate(best)], q
    assert set(got) == set(range(0, len(x), 50))


def test_top_k_of_few(spark, table):
    df, _ = table
    assert top_k(df.where("false"), F.lit(True)).count() == 0
    few = spark.createDataFrame([(1, [0.5]), (2, [-0.5]), (3, [0.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, top_k(few, F.lit(True)).collect())) == [(1, 1, 3, 0), (1, 2, 2, -262144), (2, 1, 3, 0), (2, 2, 1, -262144), (3, 1, 1, 0), (3, 2, 2, 0)]


def test_components(spark):
    import random

    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(5, k) for k in range(500, 700)] + [(k, k + 1) for k in range(1000, 1060)] + [(9, 9)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    roots = local_roots(1100, np.array([e[0] for e in edges]), np.array([e[1] for e in edges]))
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: roots[x] for x in touched}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_vectors_of_several_lengths(spark, monkeypatch):
    """Each length for itself: links, cells and searches."""
    from loomgraph.llm import vectors

    monkeypatch.setattr(vectors, "CELL", 60)
    rng = np.random.default_rng(3)
    parts = {w: np.concatenate([b, b[:20] + 0.01]) for w, n in ((3, 200), (5, 90), (8, 20), (1, 4)) for b in [rng.normal(size=(n, w))]}
    rows = [(i, v.tolist()) for i, v in enumerate(v for p in parts.values() for v in p)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in link_vectors(df).collect()}
    best = {}
    for r in top_k(df, F.col("vec_id") % 7 == 0, k=3, candidates_block=64).collect():
        best.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    start = 0
    for p in parts.values():
        unit = p / np.linalg.norm(p, axis=1, keepdims=True)
        near = unit @ unit.T >= 0.95
        np.fill_diagonal(near, False)
        roots = local_roots(len(p), *np.nonzero(near))
        whole = np.floor(1024 * p)
        for i in range(len(p)):
            assert got[start + i] == (near[i].sum(), start + roots[i])
            if (start + i) % 7 == 0:
                scores = sorted((-int(whole[i] @ whole[j]), start + j) for j in range(len(p)) if j != i)[:3]
                assert best[start + i] == {k + 1: (j, -s) for k, (s, j) in enumerate(scores)}
        start += len(p)


def test_guests_leave_in_bounded_batches(monkeypatch):
    """4,096 cells over rows without any clusters: no batch is large, memory stays under 1 GB."""
    import tracemalloc

    from loomgraph.llm import vectors

    rng = np.random.default_rng(4)
    unit = lambda n: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(rng.normal(size=(n, 64)))
    centres, x = unit(4096), unit(3000)
    tracemalloc.start()
    rows = guests = 0
    for batch in vectors.assigned(np.arange(len(x)), np.ones(len(x), dtype=np.int64), x, centres, np.sqrt(0.1)):
        assert batch.nbytes < 20 << 20
        rows += batch.num_rows
        guests += int(batch.column(4).to_numpy(zero_copy_only=False).sum())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1 << 30 and rows - guests == len(x) and guests > 100 * len(x)


def test_large_components_go_through_the_lists():
    """Whole numbers beyond exact doubles: the same lists, bound and stop."""
    from loomgraph.llm.vectors import SortedLists

    rng = np.random.default_rng(5)
    x = np.array([[int(a) for a in r] for r in rng.integers(-(10**15), 10**15, size=(300, 3))], dtype=object)
    x[5] = x[9]
    lists = SortedLists(np.arange(300), x, 4)
    for i in range(0, 300, 29):
        best = sorted((-sum(a * b for a, b in zip(x[i], v)), j) for j, v in enumerate(x) if j != i)[:3]
        assert lists.top(i, x[i], 3) == [(-s, j) for s, j in best]
    assert lists.met < 11 * 299
