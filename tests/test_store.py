"""Transactions, published versions, replicas."""

import numpy as np
import pytest

from loomgraph.operators import ann, knn
from loomgraph.operators.transaction import Transaction
from loomgraph.sources import store
from loomgraph.streaming import changelog

from test_graph import make


@pytest.fixture(scope="module")
def mini(spark):
    return make(spark, [(1, "knows", 2, 1.0, 1), (2, "knows", 3, 1.0, 2)])


def test_transactions(mini):
    with Transaction(mini) as tx:
        tx.create_node(9, "user:9", age=3).link(9, "knows", 1, since=7).unlink(1, "knows", 2).set_node_prop(2, "age", None)
    g = tx.result
    assert {r["id"]: r["age"] for r in g.nodes.collect()} == {1: 21, 2: None, 3: 23, 9: 3}
    assert {(r["src"], r["dst"], r["since"]) for r in g.edges.collect()} == {(2, 3, 2), (9, 1, 7)}
    with pytest.raises(RuntimeError), Transaction(mini) as tx:
        tx.delete_node(1)
        raise RuntimeError
    assert tx.result is mini and tx.commit() is mini


def test_versions_are_published_whole(spark, mini, tmp_path):
    path = str(tmp_path / "store")
    with pytest.raises(LookupError):
        store.current(spark, path)
    assert store.publish(mini, path) == 0
    assert store.publish(Transaction(mini).delete_node(3).commit(), path) == 1
    assert store.current(spark, path).nodes.count() == 2 and store.current(spark, path, number=0).nodes.count() == 3
    assert store.optimize(spark, path) == 2 and store.vacuum(spark, path, 1) == [0, 1] and store.versions(spark, path) == [2]
    assert store.backup(mini, str(tmp_path / "b")).first().asDict() == {"nodes": 3, "edges": 2}
    assert store.restore(spark, str(tmp_path / "b"), str(tmp_path / "c")).edges.count() == 2


def test_bootstrap(spark, mini):
    rows = [(1, i, i, 0, "set_node_prop", 1, None, None, None, None, "age", str(i)) for i in range(1, 6)]
    log = spark.createDataFrame(rows, changelog.LOG)
    g = changelog.bootstrap(mini, log, "1:3")
    assert g.nodes.where("id = 1").first()["age"] == 5
    assert changelog.next_epoch(log) == 2 and changelog.parse_cursor("4:9") == (4, 9)
    with pytest.raises(ValueError):
        changelog.parse_cursor("-1:3")


def test_quantised_index_comes_back(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(300, 8))
    s = knn.VectorStore.of(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node_id long, vector array<float>"), 8)
    index = ann.IvfPqIndex.build(s, 8, 4, 16)
    index.save(str(tmp_path / "i"))
    again = ann.IvfPqIndex.load(spark, str(tmp_path / "i"), 8)
    assert [r["node_id"] for r in again.search(x[5], 5).collect()] == [r["node_id"] for r in index.search(x[5], 5).collect()]
    assert index.pq.stats().first()["subspaces"] == 4 and index.pq.cleared().rows is None
