"""Small graphs with literal results."""

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import mutate
from loomgraph.operators import traversal as T
from loomgraph.operators.graph import Graph
from loomgraph.operators.paths import PathFinder, bfs_depths, impact
from loomgraph.operators.schema import EdgeDef, NodeDef, PropDef, Schema, node_violations
from loomgraph.operators.traversal import Traversal
from loomgraph.sources import store
from loomgraph.sources.shared import cut


def make(spark, edges, schema=None, nodes=None):
    frame = spark.createDataFrame(edges, "src long, etype string, dst long, w double, since long")
    ids = nodes or sorted({e[0] for e in edges} | {e[2] for e in edges})
    node_frame = spark.createDataFrame([(i, f"user:{i}", ["User"], 20 + i, f"n{i}") for i in ids], "id long, key string, labels array<string>, age long, name string")
    return Graph.of(cut(node_frame), cut(frame), schema)


@pytest.fixture(scope="module")
def mini(spark):
    return make(spark, [(1, "knows", 2, 1.0, 1), (2, "knows", 3, 1.0, 2), (1, "follows", 4, 1.0, 3), (2, "follows", 5, 1.0, 4)])


@pytest.fixture(scope="module")
def paths(spark):
    return make(spark, [(1, "r", 2, 1.0, 0), (1, "r", 4, 2.0, 0), (2, "r", 3, 1.0, 0), (2, "r", 5, 1.0, 0), (4, "r", 5, 1.0, 0)])


def ids(df):
    return sorted(r["node_id"] for r in df.collect())


def walk(graph, *start):
    return Traversal.from_nodes(graph, list(start))


def test_hops(mini):
    assert ids(walk(mini, 1).out("knows").ids()) == [2]
    assert ids(walk(mini, 1).out().ids()) == [2, 4]
    two = walk(mini, 1).out("knows").out("knows").results().collect()
    assert [(r["node_id"], r["depth"]) for r in two] == [(3, 2)]
    assert ids(walk(mini, 3).in_("knows").ids()) == [2]
    assert ids(walk(mini, 2).both("knows").ids()) == [1, 3]
    assert ids(walk(mini, 999).out().ids()) == []
    assert ids(walk(mini, 1).ids()) == [1]


def test_take_and_order(mini):
    assert [r["node_id"] for r in walk(mini, 1).out().take(1).results().collect()] == [4]  # follows sorts before knows
    assert walk(mini, 1).out().take(1).count_frontier().first()["n"] == 1
    assert walk(mini, 1).out().first().first()["node_id"] == 4


def test_uniqueness(mini):
    assert ids(walk(mini, 1, 2).out("knows").ids()) == [3]
    assert ids(walk(mini, 1, 2).out("knows").unique(False).ids()) == [2, 3]
    assert walk(mini, 1, 2).out("knows").count_frontier().first()["n"] == 2
    assert walk(mini, 1, 2).out("knows").count_results().first()["n"] == 1
    assert ids(walk(mini, 1, 1).ids()) == [1, 1]


def test_both_is_a_bag(spark):
    g = make(spark, [(1, "k", 1, 1.0, 0), (1, "k", 2, 1.0, 0), (2, "k", 1, 1.0, 0)])
    assert ids(walk(g, 1).both().unique(False).ids()) == [1, 1, 2, 2]


def test_variable_depth(mini):
    assert ids(walk(mini, 1).traverse("knows", max_depth=2).ids()) == [2, 3]
    assert ids(walk(mini, 1).traverse("knows", max_depth=2, min_depth=2).ids()) == [3]
    assert ids(walk(mini, 1).traverse("knows", max_depth=3, where_node=F.col("id") >= 3).ids()) == []
    assert ids(walk(mini, 1).traverse("knows", max_depth=6).ids()) == [2, 3]
    assert ids(T.reachable_from(mini, 1, 9)) == [2, 3, 4, 5]
    rows = T.traverse_per_origin(mini, [1, 2], 2, "knows").collect()
    assert sorted((r["origin"], r["node_id"], r["depth"]) for r in rows) == [(1, 2, 1), (1, 3, 2), (2, 3, 1)]


def test_filters(spark):
    g = make(spark, [(1, "knows", 2, 1.0, 2020), (1, "knows", 3, 1.0, 2022), (3, "knows", 4, 1.0, 2022)])
    assert ids(walk(g, 1).traverse("knows", max_depth=2, where_edge=F.col("since") >= 2022).ids()) == [3, 4]
    assert ids(walk(g, 1).traverse("knows", max_depth=2).where_node(F.col("age") >= 23).ids()) == [3, 4]
    # A global filter looks at final rows only; a step's filter decides where to go on.
    assert ids(walk(g, 1).out("knows").out("knows").where_edge(F.col("since") >= 2022).ids()) == [4]
    assert ids(walk(g, 1).out("knows", where_edge=F.col("since") < 2022).out("knows").ids()) == []
    assert ids(walk(g, 1).where_edge(F.col("since") > 9999).ids()) == [1]
    assert {tuple(r) for r in walk(g, 1).out("knows").select("name").collect()} == {(2, "user:2", "n2"), (3, "user:3", "n3")}
    assert {(r["dst"], r["since"]) for r in walk(g, 1).out("knows").edges(props=True).collect()} == {(2, 2020), (3, 2022)}


def test_shortest_paths(paths):
    find = lambda s, t, **k: PathFinder(paths, s, (t,), **k)
    assert find(1, 2).dijkstra().path == [1, 2]
    assert (find(1, 3).dijkstra().path, find(1, 3).dijkstra().total_weight) == ([1, 2, 3], 2.0)
    p = find(1, 5).weighted("w").dijkstra()
    assert (p.path, p.total_weight, p.edges[0]) == ([1, 2, 5], 2.0, (1, "r", 2))
    lost = find(3, 1).dijkstra()
    assert (lost.found, lost.path, lost.total_weight) == (False, [], float("inf"))
    assert not find(1, 3).depth(1).dijkstra().found
    assert PathFinder(paths, 1).to_any([3, 4]).dijkstra().path == [1, 4]
    assert find(1, 5).weighted("w").a_star(F.lit(0.0)).path == [1, 2, 5]
    assert len(find(1, 5).bfs().path) == 3
    assert not PathFinder(paths, 1).dijkstra().found
    assert (find(1, 1).dijkstra().path, find(1, 1).dijkstra().total_weight) == ([1], 0.0)
    assert find(5, 1).bidirectional().has_path() and not find(5, 1).has_path()
    assert not find(1, 5).via("other").has_path()


def test_k_shortest(paths):
    finder = PathFinder(paths, 1, (5,)).weighted("w")
    assert [(p.path, p.total_weight) for p in finder.k_shortest(3)] == [([1, 2, 5], 2.0), ([1, 4, 5], 3.0)]
    assert finder.k_shortest(0) == [] and PathFinder(paths, 3, (1,)).k_shortest(2) == []
    assert finder.frame(finder.k_shortest(2)).count() == 2


def test_weights_that_are_no_weights(spark):
    g = make(spark, [(1, "r", 2, -5.0, 0), (2, "r", 3, 0.0, 0), (3, "r", 4, None, 0)])
    assert PathFinder(g, 1, (4,)).weighted("w").dijkstra().total_weight == 3.0


def test_depths_and_impact(paths):
    assert {(r["node_id"], r["depth"]) for r in bfs_depths(paths, 1).collect()} == {(1, 0), (2, 1), (4, 1), (3, 2), (5, 2)}
    assert {r["node_id"]: r["etypes"] for r in impact(paths, 5).collect()} == {2: ["r"], 4: ["r"], 1: ["r"]}


def test_lookups_and_counts(mini):
    assert [r["position"] for r in mini.by_ids([3, 99, 1]).orderBy("position").collect()] == [0, 2]
    assert {(r["id"], r["degree"]) for r in mini.degrees("out").collect()} == {(1, 2), (2, 2), (3, 0), (4, 0), (5, 0)}
    assert mini.count_edges("knows").first()["n"] == 2
    assert mini.check().count() == 0
    broken = mini.with_nodes(mini.nodes.where("id <> 4"))
    assert {tuple(r) for r in broken.check().collect()} == {("dangling dst", "1/follows/4")}
    assert broken.live_edges().count() == 3
    assert mini.reciprocity(mini.edges).count() == 0


def test_edges_are_a_set(spark):
    g = make(spark, [(1, "k", 2, 1.0, 0), (1, "k", 2, 2.0, 0)])
    assert g.edges.count() == 1
    again = mutate.add_edges(g, spark.createDataFrame([(1, "k", 2), (2, "k", 1)], "src long, etype string, dst long"))
    assert again.edges.count() == 2


def test_schema(spark, mini):
    user = NodeDef("User", "user:", (PropDef("name", required=True), PropDef("age", "int"), PropDef("mail", required=True)))
    assert {(r["id"], r["prop"], r["problem"]) for r in node_violations(mini.nodes.where("id = 1"), user).collect()} == {(1, "mail", "required")}
    schema = Schema.of(NodeDef("User", "user:"), NodeDef("Admin", "user:1"), EdgeDef("knows"))
    g = Graph(mini.nodes, mini.edges, schema)
    assert {r["id"] for r in g.all("Admin").collect()} == {1} and g.all("User").count() == 4
    with pytest.raises(ValueError):
        g.all("Nobody")
    with pytest.raises(ValueError):
        mutate.link(g, "hates", mini.edges)


def test_mutations(spark, mini):
    g = mutate.delete_nodes(mini, spark.createDataFrame([(2,)], "id long"))
    assert g.nodes.count() == 4 and {(r["src"], r["dst"]) for r in g.edges.collect()} == {(1, 4)}
    g = mutate.upsert_nodes(mini, spark.createDataFrame([("user:1", 99, None, None), ("user:2", None, None, ["age"]), ("user:77", 7, "new", None)], "key string, age long, name string, unset array<string>"))
    rows = {r["key"]: (r["id"], r["age"], r["name"]) for r in g.nodes.collect()}
    assert rows["user:1"] == (1, 99, "n1") and rows["user:2"] == (2, None, "n2") and rows["user:77"] == (6, 7, "new") and len(rows) == 6
    e = spark.createDataFrame([(1, "knows", 2, 5)], "src long, etype string, dst long, since long")
    assert mutate.upsert_edges(mini, e).edges.where("src = 1 and dst = 2").first()["since"] == 5
    gone = spark.createDataFrame([(1, "knows", 2, ["since"])], "src long, etype string, dst long, unset array<string>")
    assert mutate.upsert_edges(mini, gone).edges.where("src = 1 and dst = 2").first()["since"] is None
    assert [r["created"] for r in mutate.created_edges(mini, e.unionByName(e.withColumn("dst", F.lit(5).cast("long")))).orderBy("dst").collect()] == [False, True]
    labelled = mutate.remove_label(mutate.add_label(mini, "X", spark.range(1, 3)), "User", spark.range(1, 2))
    assert {r["id"]: r["labels"] for r in labelled.nodes.where("id < 4").collect()} == {1: ["X"], 2: ["User", "X"], 3: ["User"]}


OPS = "seq long, op string, node_id long, key string, src long, etype string, dst long, prop string, value string"


def test_batch_last_word_wins(spark, mini):
    ops = [
        (1, "create_node", 10, "user:10", None, None, None, None, None),
        (2, "set_node_prop", 10, None, None, None, None, "age", "5"),
        (3, "set_node_prop", 10, None, None, None, None, "age", "6"),
        (4, "delete_node", 2, None, None, None, None, None, None),
        (5, "create_node", 2, "user:2b", None, None, None, None, None),
        (6, "link", None, None, 2, "knows", 10, None, None),
        (7, "set_edge_prop", None, None, 2, "knows", 10, "since", "1999"),
        (8, "unlink", None, None, 1, "follows", 4, None, None),
        (9, "del_node_prop", 1, None, None, None, None, "age", None),
    ]
    g = mutate.batch(mini, spark.createDataFrame(ops, OPS))
    nodes = {r["id"]: (r["key"], r["age"], r["name"]) for r in g.nodes.collect()}
    assert nodes[10] == ("user:10", 6, None) and nodes[2] == ("user:2b", None, None) and nodes[1] == ("user:1", None, "n1")
    assert {(r["src"], r["etype"], r["dst"], r["since"]) for r in g.edges.collect()} == {(2, "knows", 10, 1999)}
    with pytest.raises(ValueError):
        mutate.batch(mini, spark.createDataFrame([(1, "explode", 1, None, None, None, None, None, None)], OPS))


def test_files_round_trip(spark, mini, tmp_path):
    store.save(mini, str(tmp_path / "g"))
    back = store.load(spark, str(tmp_path / "g"))
    assert back.nodes.count() == 5 and back.edges.where("since = 2").first()["dst"] == 3
    store.export_jsonl(mini, str(tmp_path / "l"))
    nodes, edges = store.import_jsonl(spark, str(tmp_path / "l"))
    empty = Graph(mini.nodes.limit(0), mini.edges.limit(0))
    again = store.merge_import(empty, nodes, edges)
    assert {(r["id"], r["key"], r["age"]) for r in again.nodes.collect()} == {(i, f"user:{i}", 20 + i) for i in range(1, 6)}
    assert {(r["src"], r["dst"], r["since"]) for r in again.edges.collect()} == {(1, 2, 1), (2, 3, 2), (1, 4, 3), (2, 5, 4)}
    same = store.merge_import(mini, nodes, edges)
    assert same.nodes.count() == 5 and same.edges.count() == 4
    store.export_json(mini, str(tmp_path / "j"))
    assert store.import_json(spark, str(tmp_path / "j"))[1].count() == 4


def test_pages(mini):
    page, cursor = store.node_page(mini, 2)
    assert [r["id"] for r in page.collect()] == [1, 2] and cursor == "n:2"
    page, cursor = store.node_page(mini, 2, "n:4")
    assert [r["id"] for r in page.collect()] == [5] and cursor is None
    page, cursor = store.edge_page(mini, 3)
    assert cursor == "e:2:follows:5"
    assert [tuple(r)[:3] for r in store.edge_page(mini, 3, cursor)[0].collect()] == [(2, "knows", 3)]
    assert [len(b) for b in store.batches(mini.nodes, 2)] == [2, 2, 1]


def test_traversal_against_mirror(spark):
    """Random graphs against a plain walk."""
    import random

    rng = random.Random(5)
    for seed in range(3):
        n = 30
        edges = sorted({(rng.randrange(n), rng.choice("ab"), rng.randrange(n)) for _ in range(70)})
        g = make(spark, [(*e, 1.0, 0) for e in edges], nodes=list(range(n)))
        start = [seed, seed + 1]
        seen, level, found = set(start), list(start), {}
        for depth in (1, 2, 3):
            new = sorted({d for s, t, d in edges if s in level and t == "a"} - seen)
            seen |= set(new)
            found |= {x: depth for x in new}
            level = new
        got = walk(g, *start).traverse("a", max_depth=3).results().collect()
        assert {r["node_id"]: r["depth"] for r in got} == found
