"""Exact and approximate search, version tables, the change log."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.functions import keys
from loomgraph.functions import vector as V
from loomgraph.operators import ann, knn, versions
from loomgraph.streaming import changelog


def store(spark, rows, metric=V.COSINE, dims=4):
    rows = [(i, [float(x) for x in v]) for i, v in rows]
    return knn.VectorStore.of(spark.createDataFrame(rows, "node_id long, vector array<float>"), dims, metric)


BASIC = [(1, [1, 0, 0, 0]), (2, [0, 1, 0, 0]), (3, [0.707, 0.707, 0, 0])]


def test_exact_search(spark):
    s = store(spark, BASIC)
    hits = s.search([1, 0, 0, 0], 3).collect()
    assert hits[0]["node_id"] == 1 and hits[0]["similarity"] > 0.99
    assert [r["node_id"] for r in s.search([1, 0, 0, 0], 10, threshold=0.5).collect()] == [1, 3]
    many = store(spark, [(i, [1.0, 0, 0, 0]) for i in range(50)] + [(100, [0.8, 0.6, 0, 0]), (101, [0.0, 1, 0, 0])])
    assert [r["node_id"] for r in many.search([1, 0, 0, 0], 1, keep=F.col("node_id") >= 100).collect()] == [100]
    assert [r["node_id"] for r in ann.IvfIndex.build(many, 1).search([1, 0, 0, 0], 1, keep=F.col("node_id") >= 100).collect()] == [100]


def test_store_changes(spark):
    s = store(spark, BASIC).insert(spark.createDataFrame([(2, [0.0, 0.0, 2.0, 0.0])], "node_id long, vector array<float>"))
    assert s.get(2).first()["vector"] == [0.0, 0.0, 1.0, 0.0] and s.rows.count() == 3
    assert s.delete(spark.createDataFrame([(1,)], "node_id long")).rows.count() == 2
    bad = [(7, [0.0] * 4), (8, [float("nan")] * 4), (9, [1.0])]
    frame = spark.createDataFrame(bad, "node_id long, vector array<float>")
    assert s.problems(frame).count() == 3
    with pytest.raises(Exception, match="invalid vector"):
        s.insert(frame).rows.collect()
    with pytest.raises(ValueError):
        ann.VectorIndex(s).search([1.0, 2.0])
    with pytest.raises(ValueError):
        ann.VectorIndex(s).search([1.0, float("nan"), 0, 0])


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    x = centres[rng.integers(20, size=1500)] + rng.normal(size=(1500, 16)) * 0.3
    return store(spark, [(i, v.tolist()) for i, v in enumerate(x)], dims=16), x


def recall(exact, found):
    return len({r["node_id"] for r in exact.collect()} & {r["node_id"] for r in found.collect()}) / 10


def test_recall(spark, clustered, tmp_path):
    s, x = clustered
    ivf = ann.IvfIndex.build(s, 20)
    pq = ann.IvfPqIndex.build(s, 20, 8, 64)
    res = ann.IvfPqIndex.build(s, 20, 8, 64, residuals=True)
    scores = [[recall(s.search(x[i], 10), index.search(x[i], 10, n_probe=6, **k)) for i in (3, 400, 900)] for index, k in ((ivf, {}), (pq, {}), (res, {}), (pq, {"rerank": True}))]
    assert np.mean(scores[0]) >= 0.9 and np.mean(scores[1]) >= 0.4 and np.mean(scores[2]) >= 0.4 and np.mean(scores[3]) >= 0.8
    assert ivf.stats().first()["lists"] == 20
    ivf.save(str(tmp_path / "i"))
    again = ann.IvfIndex.load(spark, str(tmp_path / "i"), 16)
    assert [r["node_id"] for r in again.search(x[3], 5).collect()] == [r["node_id"] for r in ivf.search(x[3], 5).collect()]
    auto = ann.VectorIndex(s).build()
    assert isinstance(auto.index, ann.IvfPqIndex) and auto.search(x[3], 3).count() == 3
    assert ivf.search_multi([x[3], x[4]], 5).count() == 5 and pq.search_multi([x[3], x[4]], 5, how="avg").count() == 5


def test_pq_tables(spark, clustered):
    s, x = clustered
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    pq = ann.PqIndex.train(unit, 4, 32)
    codes = pq.encode_matrix(unit[:50])
    d = ((pq.decode_matrix(codes) - unit[7]) ** 2).sum(axis=1)
    table = pq.table(unit[7]).reshape(4, -1)
    assert np.allclose(d, [sum(table[m, c] for m, c in enumerate(row)) for row in codes])
    assert pq.encode(s.rows).search(unit[7], 3).count() == 3


def test_compaction(spark):
    f = lambda rows: knn.fragments_to_compact(spark.createDataFrame(rows, "fragment_id long, active boolean, total long, deleted long"))
    assert [r["fragment_id"] for r in f([(1, False, 10, 5), (2, False, 10, 9), (3, True, 10, 9), (4, False, 10, 1)]).collect()] == [2, 1]
    assert f([(1, False, 10, 5)]).count() == 0 and f([(1, False, 10, 10)]).count() == 1
    v = spark.createDataFrame([(0, 1, [1.0]), (0, 2, [1.0]), (1, 3, [1.0])], "fragment_id long, node_id long, vector array<float>")
    out = knn.compact(v, spark.createDataFrame([(1,)], "node_id long"), spark.createDataFrame([(0,)], "fragment_id long"))
    assert {(r["fragment_id"], r["node_id"]) for r in out.collect()} == {(2, 2), (1, 3)}


VERSION = "entity string, entity_id long, prop string, value string, txid long, commit_ts long, deleted boolean"


def test_versions(spark):
    v = spark.createDataFrame(
        [("n", 1, "p", "base", 0, 0, False), ("n", 1, "p", "a", 5, 10, False), ("n", 1, "p", "b", 6, 20, False), ("n", 2, "p", "x", 7, 15, False), ("n", 2, "p", "x", 8, 25, True)], VERSION
    )
    at = lambda ts, tx=None: {r["entity_id"]: r["value"] for r in versions.as_of(v, ts, tx).collect()}
    assert at(0) == {1: "base"} and at(10) == {1: "base"} and at(11) == {1: "a"} and at(20) == {1: "a", 2: "x"} and at(99) == {1: "b"}
    assert at(1, 6) == {1: "b"}
    kept = versions.collect_garbage(v, 18, 10**6, 0)
    assert {(r["entity_id"], r["commit_ts"]) for r in kept.collect()} == {(1, 10), (1, 20), (2, 15), (2, 25)}


def test_conflicts(spark):
    ops = spark.createDataFrame([(1, "add_edge", None, 5, "k", 6, None), (2, "add_edge", None, 5, "k", 7, None)], "txid long, op string, node_id long, src long, etype string, dst long, prop string")
    touched = versions.conflict_keys(ops)
    assert touched.where("txid = 1").count() == 5
    commits = touched.where("txid = 2").select("key", F.lit(9).cast("long").alias("commit_ts"))
    active = spark.createDataFrame([(1, 9)], "txid long, start_ts long")
    assert {r["key"] for r in versions.conflicts(active, touched, commits).collect()} == {"out:5", "out:5:k"}
    assert versions.conflicts(active.withColumn("start_ts", F.lit(10)), touched, commits).count() == 0


def frames(spark, rows):
    return spark.createDataFrame([(1, i, i, 0, op, n, None, None, None, None, p, v) for i, op, n, p, v in rows], changelog.LOG)


def test_stream_follows_the_log(spark, tmp_path):
    log, state, mark = (str(tmp_path / x) for x in ("log", "state", "mark"))
    first = frames(spark, [(1, "set_node_prop", 1, "a", "x"), (2, "set_node_prop", 1, "a", "y"), (3, "set_node_prop", 2, "a", "z")])
    changelog.append(first, log)
    changelog.follow(spark, log, state, mark).awaitTermination()
    read = lambda: {(r["node_id"], r["prop"]): None if r["removed"] else r["value"] for r in changelog.state(spark, state).collect()}
    assert read() == {(1, "a"): "y", (2, "a"): "z"}
    changelog.append(first, log)  # the same frames again
    changelog.append(frames(spark, [(4, "del_node_prop", 2, "a", None)]), log)
    changelog.follow(spark, log, state, mark).awaitTermination()
    assert read() == {(1, "a"): "y", (2, "a"): None}


def test_log_positions(spark):
    log = frames(spark, [(i, "set_node_prop", 1, "a", str(i)) for i in range(5, 10)])
    assert [r["log_index"] for r in changelog.frames_after(log, 1, 6, 2).orderBy("log_index").collect()] == [7, 8]
    with pytest.raises(LookupError):
        changelog.frames_after(log, 1, 2, 2)
    progress = spark.createDataFrame([("a", 1, 3), ("b", 2, 0)], "replica string, epoch long, applied long")
    assert changelog.retention_floor(100, 1, progress, 10) == 4 and changelog.retention_floor(100, 3, progress, 10) == 90 and changelog.retention_floor(5, 1, progress, 10, 2) == 2
    seg = spark.createDataFrame([(1, False, 3, 0), (2, False, 9, 0), (3, True, 2, 0)], "segment_id long, active boolean, end_index long, written_at long")
    assert [r["segment_id"] for r in changelog.prunable(seg, 4).collect()] == [1]
    assert changelog.newest_epoch(log.unionByName(log.withColumn("epoch", F.lit(2).cast("long")))).count() == 5


def test_values(spark):
    df = spark.createDataFrame([(1, 2.5, "s", True, [1.0])], "i long, f double, s string, b boolean, v array<float>")
    for c, kind in df.dtypes:
        pair = keys.tagged(F.col(c), kind)
        assert df.select(keys.untagged(pair, kind).alias("x") == F.col(c)).first()[0]
        assert df.select(keys.untagged(pair, "bigint" if kind != "bigint" else "string").alias("x")).first()[0] is None
    assert df.select(keys.weight(F.lit("abc"))).first()[0] == 1.0
    assert df.select(V.adc_distance(F.array(*map(F.lit, [1.0, 2.0, 30.0, 40.0])), F.array(F.lit(1), F.lit(0)), 2)).first()[0] == 32.0
    assert df.select(V.dot_at(F.array(*map(F.lit, [1.0, 2.0, 3.0, 4.0])), 2, F.lit(1), F.array(F.lit(1.0), F.lit(1.0)))).first()[0] == 7.0


def test_many_queries_in_blocks(spark, clustered, monkeypatch):
    """More queries than a block holds; inverted lists: all probed is exact, some reach 0.9."""
    monkeypatch.setattr(knn, "ROWS_BLOCK", 400)
    monkeypatch.setattr(ann, "CLUSTER_BLOCK", 50)
    s, x = clustered
    queries = s.rows.withColumnRenamed("node_id", "query_id")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    best = np.argsort(-(unit @ unit.T), axis=1, kind="stable")[:, :10]
    top = lambda df: {(r["query_id"], r["node_id"]) for r in df.collect()}
    want = {(q, int(n)) for q in range(len(x)) for n in best[q]}
    assert len(want - top(s.search_many(queries, 10))) <= 2  # 1,500 queries; equal distances may swap
    ivf = ann.IvfIndex.build(s, 20)
    assert len(want - top(ivf.search_many(queries, 10, n_probe=20))) <= 2
    asked = queries.where("query_id % 25 = 0")
    some = {p for p in want if p[0] % 25 == 0}
    assert len(some & top(ivf.search_many(asked, 10, n_probe=6))) >= 0.9 * len(some)
    assert s.search_many(queries.where("false"), 3).count() == 0


def test_reranked_codes_reach_recall(spark, clustered):
    s, x = clustered
    pq = ann.IvfPqIndex.build(s, 20, 8, 64)
    assert np.mean([recall(s.search(x[i], 10), pq.search(x[i], 10, n_probe=10, rerank=True)) for i in range(0, 1500, 150)]) >= 0.9


def test_last_of_repeated_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0], 2), (1, [0.0, 1.0, 0.0, 0.0], 3), (1, [0.0, 0.0, 1.0, 0.0], 1)], "node_id long, vector array<float>, at int")
    assert store(spark, BASIC).insert(rows, "at").get(1).first()["vector"] == [0.0, 1.0, 0.0, 0.0]
    index = ann.VectorIndex(store(spark, BASIC)).build()
    assert len(index) == 3 and index.get(2).count() == 1 and not index.stats().first()["indexed"] and len(index.clear()) == 0
    assert [r["found"] for r in index.has(spark.createDataFrame([(1,), (9,)], "node_id long")).orderBy("node_id").collect()] == [True, False]


def test_replay_of_positions_of_any_size(spark):
    from test_graph import make

    g = make(spark, [(1, "knows", 2, 1.0, 1)])
    rows = [(1 << 20, 1 << 40, 1, 0, "set_node_prop", 1, None, None, None, None, "age", "5"), (1 << 20, (1 << 40) + 1, 2, 1 << 25, "set_node_prop", 1, None, None, None, None, "age", "6"), (3, 9, 3, 0, "set_node_prop", 1, None, None, None, None, "age", "7")]
    log = spark.createDataFrame(rows, changelog.LOG)
    assert changelog.replay(g, log).nodes.where("id = 1").first()["age"] == 6
    deletes = spark.createDataFrame([(2, 1, 1, 0, "delete_node", 2, None, None, None, None, None, None), (2, 2, 1, 0, "link", None, None, 1, "knows", 2, None, None)], changelog.LOG)
    again = changelog.replay(g, deletes)
    assert again.nodes.count() == 1 and again.edges.count() == 1
    assert changelog.bootstrap(g, log, "0:0").nodes.where("id = 1").first()["age"] == 6


def test_any_text_is_a_value(spark):
    from loomgraph.operators import mutate
    from test_graph import make

    g = make(spark, [(1, "knows", 2, 1.0, 1)])
    change = spark.createDataFrame([("user:1", "__unset__")], "key string, name string")
    assert mutate.upsert_nodes(g, change).nodes.where("id = 1").first()["name"] == "__unset__"
