"""Changes to a graph as pure functions: each returns a new Graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import EDGE_KEY, Graph


def _aligned(df: DataFrame, like: DataFrame) -> DataFrame:
    """df with the columns of like, missing ones null, others dropped."""
    kinds = dict(like.dtypes)
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in like.columns])


def next_ids(graph: Graph, new: DataFrame, order: str) -> DataFrame:
    """new with ids above the largest known one, dense, in the order of a column.

    Numbers within ranges of the order column: counts by partition give each its start,
    so no single task holds all rows."""
    top = graph.nodes.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    dealt = new.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id()).withColumn("_k", F.monotonically_increasing_id())
    from ..sources.shared import cut

    dealt = cut(dealt)
    starts, at = [], top
    for r in dealt.groupBy("_p").count().orderBy("_p").collect():  # one row for each partition
        starts.append((r["_p"], at))
        at += r["count"]
    if not starts:
        return new.withColumn("id", F.lit(None).cast("long")).where(F.lit(False))
    frame = graph.spark.createDataFrame(starts, "_p int, _start long")
    place = F.row_number().over(Window.partitionBy("_p").orderBy("_k"))
    return dealt.join(F.broadcast(frame), "_p").withColumn("id", F.col("_start") + place).drop("_p", "_k", "_start")


def create_nodes(graph: Graph, new: DataFrame, order: str = "key") -> Graph:
    """new: key and properties; declared columns only are kept. With a column id, ids are as given."""
    if "id" not in new.columns:
        new = next_ids(graph, new, order)
    if "labels" not in new.columns:
        new = new.withColumn("labels", F.array().cast("array<string>"))
    return graph.with_nodes(graph.nodes.unionByName(_aligned(new, graph.nodes)))


def create_typed(graph: Graph, node_type: str, new: DataFrame, suffix: str = "suffix") -> Graph:
    """new: suffix and properties of the type; undeclared properties are dropped."""
    d = graph.schema.node(node_type)
    props = [p.name for p in d.props if p.name in new.columns]
    rows = new.select(d.key(F.col(suffix)).alias("key"), F.array(F.lit(d.name)).alias("labels"), *props)
    return create_nodes(graph, rows)


def _merge(old: DataFrame, changes: DataFrame, by: list[str], props: list[str]) -> DataFrame:
    """old with the changed properties: null leaves, a name in the array column unset
    removes, a value sets, whatever it says; rows without partner are added."""
    kinds = dict(old.dtypes)
    given = [p for p in props if p in changes.columns]
    unset = F.col("c.unset") if "unset" in changes.columns else F.lit(None).cast("array<string>")
    joined = old.alias("o").join(changes.alias("c"), [F.col(f"o.{k}") == F.col(f"c.{k}") for k in by], "full_outer")
    out = []
    for c in old.columns:
        if c in by:
            out.append(F.coalesce(f"o.{c}", f"c.{c}").alias(c))
        elif c in given:
            gone = F.coalesce(F.array_contains(unset, c), F.lit(False))
            new = F.col(f"c.{c}")
            value = F.when(gone, F.lit(None)).otherwise(F.coalesce(new.try_cast(kinds[c]) if dict(changes.dtypes)[c] == "string" else new.cast(kinds[c]), F.col(f"o.{c}")))
            out.append(value.cast(kinds[c]).alias(c))
        elif c in changes.columns and c not in props:
            out.append(F.coalesce(f"o.{c}", F.col(f"c.{c}").cast(kinds[c])).alias(c))
        else:
            gone = F.coalesce(F.array_contains(unset, c), F.lit(False)) if c in props else F.lit(False)
            out.append(F.when(~gone, F.col(f"o.{c}")).alias(c))
    return joined.select(*out)


def upsert_nodes(graph: Graph, changes: DataFrame) -> Graph:
    """changes: key, properties (null: leave) and optionally unset, an array of names to
    remove. Known keys are updated in place, others created with new ids."""
    known = graph.nodes.select("id", "key")
    old = changes.join(known, "key")
    new = next_ids(graph, changes.join(known.select("key"), "key", "left_anti"), "key")
    rows = old.unionByName(new.select(*old.columns))
    return upsert_nodes_by_id(graph, rows)


def upsert_nodes_by_id(graph: Graph, changes: DataFrame) -> Graph:
    merged = _merge(graph.nodes, changes, ["id"], graph.node_props)
    empty = F.array().cast("array<string>")
    return graph.with_nodes(merged.withColumn("labels", F.coalesce("labels", empty)))


def update_nodes(graph: Graph, changes: DataFrame, by: str = "id") -> Graph:
    """As upsert, for nodes that exist; other changes are dropped."""
    rows = changes if by == "id" else changes.join(graph.nodes.select("id", "key"), "key")
    return upsert_nodes_by_id(graph, rows.join(graph.nodes.select("id"), "id", "left_semi"))


def delete_nodes(graph: Graph, ids: DataFrame) -> Graph:
    """Nodes and every edge at either end of them."""
    gone = ids.select(F.col("id").alias("_gone")).distinct()
    edges = graph.edges.join(gone, F.col("src") == F.col("_gone"), "left_anti").join(gone, F.col("dst") == F.col("_gone"), "left_anti")
    nodes = graph.nodes.join(gone, F.col("id") == F.col("_gone"), "left_anti")
    return Graph(nodes, edges, graph.schema)


def add_edges(graph: Graph, new: DataFrame) -> Graph:
    """Edges stay a set; adding a known one changes nothing. Endpoints aren't checked."""
    fresh = _aligned(new, graph.edges).dropDuplicates(EDGE_KEY).join(graph.edges.select(*EDGE_KEY), EDGE_KEY, "left_anti")
    return graph.with_edges(graph.edges.unionByName(fresh.select(*graph.edges.columns)))


def link(graph: Graph, edge_type: str, pairs: DataFrame) -> Graph:
    """pairs: src, dst and properties. Unknown edge types are an error."""
    if graph.schema.edges:
        graph.schema.edge(edge_type)
    return add_edges(graph, pairs.withColumn("etype", F.lit(edge_type)))


def delete_edges(graph: Graph, gone: DataFrame) -> Graph:
    return graph.with_edges(graph.edges.join(gone.select(*EDGE_KEY), EDGE_KEY, "left_anti"))


unlink = delete_edges


def upsert_edges(graph: Graph, changes: DataFrame) -> Graph:
    return graph.with_edges(_merge(graph.edges, changes, EDGE_KEY, graph.edge_props))


def created_edges(graph: Graph, changes: DataFrame) -> DataFrame:
    """The changes' keys with created: whether an upsert would add the edge."""
    known = graph.edges.select(*EDGE_KEY, F.lit(False).alias("_c"))
    return changes.select(*EDGE_KEY).join(known, EDGE_KEY, "left").select(*EDGE_KEY, F.coalesce("_c", F.lit(True)).alias("created"))


def update_edges(graph: Graph, changes: DataFrame) -> Graph:
    return upsert_edges(graph, changes.join(graph.edges.select(*EDGE_KEY), EDGE_KEY, "left_semi"))


def set_node_prop(graph: Graph, name: str, values: DataFrame) -> Graph:
    """values: id and value; a null value removes the property."""
    rows = values.select("id", F.col("value").alias(name), F.when(F.col("value").isNull(), F.array(F.lit(name))).alias("unset"))
    return update_nodes(graph, rows)


def set_edge_prop(graph: Graph, name: str, values: DataFrame) -> Graph:
    rows = values.select(*EDGE_KEY, F.col("value").alias(name), F.when(F.col("value").isNull(), F.array(F.lit(name))).alias("unset"))
    return update_edges(graph, rows)


def add_label(graph: Graph, label: str, ids: DataFrame) -> Graph:
    return _labels(graph, ids, lambda l: F.array_union(l, F.array(F.lit(label))))


def remove_label(graph: Graph, label: str, ids: DataFrame) -> Graph:
    return _labels(graph, ids, lambda l: F.array_remove(l, label))


def _labels(graph: Graph, ids: DataFrame, change) -> Graph:
    hit = graph.nodes.join(ids.select("id", F.lit(True).alias("_hit")).distinct(), "id", "left")
    hit = hit.withColumn("labels", F.when(F.col("_hit"), change(F.col("labels"))).otherwise(F.col("labels")))
    return graph.with_nodes(hit.select(*graph.nodes.columns))


def overlay(base: DataFrame, deleted: DataFrame, added: DataFrame, by: list[str]) -> DataFrame:
    """(base without deleted) and added, as a set: what a reader of base plus changes sees."""
    stay = base.join(deleted.select(*by), by, "left_anti")
    return stay.unionByName(added.select(*stay.columns)).dropDuplicates(by)


#: Kinds of operations of a batch.
NODE_OPS = ("create_node", "delete_node", "set_node_prop", "del_node_prop")
EDGE_OPS = ("link", "unlink", "set_edge_prop", "del_edge_prop")


def batch(graph: Graph, ops: DataFrame) -> Graph:
    """ops: seq (a number, or a struct that sorts alike), op, node_id, key, src, etype, dst,
    prop, value (text), applied in the order of seq as one change: any op of an unknown kind or (with a schema) edge type
    fails the whole batch before anything is made.

    The last word wins: a node is there if its last create is later than its last
    delete; a property keeps the last set or removal after the node's last delete.
    Deleting a node removes all edges that it had by then, re-adding an edge cancels its removal."""
    known = F.col("op").isin([*NODE_OPS, *EDGE_OPS])
    if graph.schema.edges:
        known &= ~F.col("op").isin(list(EDGE_OPS)) | F.col("etype").isin(list(graph.schema.edges))
    wrong = ops.where(~F.coalesce(known, F.lit(False))).select("seq", "op").first()
    if wrong:
        raise ValueError(f"operation {wrong['seq']} ({wrong['op']}) is unknown or of an unknown type")
    at = lambda *kinds: F.max(F.when(F.col("op").isin(list(kinds)), F.col("seq")))
    life = ops.where(F.col("op").isin("create_node", "delete_node")).groupBy(F.col("node_id").alias("id")).agg(
        at("create_node").alias("born"), at("delete_node").alias("died"), F.max_by(F.when(F.col("op") == "create_node", F.col("key")), F.when(F.col("op") == "create_node", F.col("seq"))).alias("new_key")
    )
    deaths = life.where("died is not null").select("id", "died")

    def folded(kinds, by):
        sets = ops.where(F.col("op").isin(list(kinds)))
        return sets.groupBy(*by, "prop").agg(F.max_by(F.struct("op", "value"), "seq").alias("last"), F.max("seq").alias("seq"))

    # Nodes
    nodes = graph.nodes.alias("n").join(life.alias("l"), "id", "full_outer")
    gone = F.col("died").isNotNull() & (F.col("born").isNull() | (F.col("died") > F.col("born")))
    fresh = F.col("died").isNotNull() | F.col("key").isNull() & F.col("labels").isNull()
    nodes = nodes.where(~gone)
    nodes = nodes.select(
        "id",
        F.when(F.col("born").isNotNull(), F.coalesce("new_key", F.when(~fresh, F.col("key")))).otherwise(F.col("key")).alias("key"),
        F.when(fresh, F.array().cast("array<string>")).otherwise(F.col("labels")).alias("labels"),
        *[F.when(~fresh, F.col(p)).alias(p) for p in graph.node_props],
    )
    changes = folded(("set_node_prop", "del_node_prop"), [F.col("node_id").alias("id")])
    changes = changes.join(deaths, "id", "left").where("died is null or seq > died")
    nodes = _pivoted(nodes, changes, ["id"], graph.node_props)

    # Edges
    touched = ops.where(F.col("op").isin("link", "unlink")).groupBy(*EDGE_KEY).agg(at("link").alias("linked"), at("unlink").alias("cut"))
    ends = deaths.select(F.col("id").alias("_e"), F.col("died").alias("_d"))
    edges = graph.edges.withColumn("_old", F.lit(True)).join(touched, EDGE_KEY, "full_outer")
    edges = edges.join(ends.withColumnsRenamed({"_e": "src", "_d": "d1"}), "src", "left").join(ends.withColumnsRenamed({"_e": "dst", "_d": "d2"}), "dst", "left")
    end = F.greatest("cut", "d1", "d2")
    alive = F.when(F.col("linked").isNotNull(), end.isNull() | (F.col("linked") > end)).otherwise(F.col("_old").isNotNull() & end.isNull())
    edges = edges.where(alive)
    fresh = end.isNotNull()
    edges = edges.select(*EDGE_KEY, *[F.when(~fresh, F.col(p)).alias(p) for p in graph.edge_props], end.alias("_end"))
    changes = folded(("set_edge_prop", "del_edge_prop"), EDGE_KEY)
    changes = changes.join(edges.select(*EDGE_KEY, "_end"), EDGE_KEY).where("_end is null or seq > _end").drop("_end")
    edges = _pivoted(edges.drop("_end"), changes, EDGE_KEY, graph.edge_props)
    return Graph(nodes, edges, graph.schema)


def _pivoted(rows: DataFrame, changes: DataFrame, by: list[str], props: list[str]) -> DataFrame:
    """rows with the last change of each property."""
    if not props:
        return rows
    kinds = dict(rows.dtypes)
    pick = [F.max_by(F.when(F.col("prop") == p, F.col("last")), F.when(F.col("prop") == p, F.col("seq"))).alias(f"_{p}") for p in props]
    wide = changes.groupBy(*by).agg(*pick)
    joined = rows.join(wide, by, "left")
    out = []
    for c in rows.columns:
        if c in props:
            new = F.when(F.col(f"_{c}.op").startswith("set"), F.col(f"_{c}.value").try_cast(kinds[c]) if not kinds[c].startswith("array") else F.from_json(F.col(f"_{c}.value"), kinds[c]))
            out.append(F.when(F.col(f"_{c}").isNotNull(), new).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)
