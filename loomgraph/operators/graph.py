"""A property graph as two DataFrames: scans, lookups, degrees, counts and checks."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys
from .schema import NodeDef, Schema

EDGE_KEY = ["src", "etype", "dst"]


@dataclass(frozen=True)
class Graph:
    """nodes: id, key, labels and property columns; edges: src, etype, dst and property
    columns, a set on (src, etype, dst). Every method returns a lazy DataFrame."""

    nodes: DataFrame
    edges: DataFrame
    schema: Schema = field(default_factory=Schema)

    @classmethod
    def of(cls, nodes: DataFrame, edges: DataFrame, schema: Schema | None = None, bag: bool = False) -> Graph:
        """Edges are made a set unless bag (parallel edges, as in a plain weighted edge list)."""
        return cls(nodes, edges if bag else edges.dropDuplicates(EDGE_KEY), schema or Schema())

    @classmethod
    def from_edges(cls, edges: DataFrame, bag: bool = True) -> Graph:
        """Nodes are whatever edges touch."""
        ids = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
        nodes = ids.select("id", F.lit(None).cast("string").alias("key"), F.array().cast("array<string>").alias("labels"))
        return cls.of(nodes, edges, bag=bag)

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def with_nodes(self, nodes: DataFrame) -> Graph:
        return replace(self, nodes=nodes)

    def with_edges(self, edges: DataFrame) -> Graph:
        return replace(self, edges=edges)

    @property
    def node_props(self) -> list[str]:
        return [c for c in self.nodes.columns if c not in ("id", "key", "labels")]

    @property
    def edge_props(self) -> list[str]:
        return [c for c in self.edges.columns if c not in EDGE_KEY]

    # -- scans -----------------------------------------------------------------

    def node_ids(self) -> DataFrame:
        return self.nodes.select("id")

    def live_edges(self, etype: str | None = None) -> DataFrame:
        """Edges with both endpoints alive; dangling edges are legal to store."""
        edges = self.edges if etype is None else self.edges.where(F.col("etype") == etype)
        ids = self.nodes.select(F.col("id").alias("_id"))
        return edges.join(ids, edges.src == F.col("_id"), "left_semi").join(ids, edges.dst == F.col("_id"), "left_semi")

    def all_edges(self, etype: str | None = None) -> DataFrame:
        if etype is not None and self.schema.edges:
            self.schema.edge(etype)
        return self.live_edges(etype)

    def all(self, node_type: str | NodeDef) -> DataFrame:
        """Nodes of a type: their keys start with its prefix and with no longer one of another type."""
        d = node_type if isinstance(node_type, NodeDef) else self.schema.node(node_type)
        rows = self.nodes.where(F.col("key").startswith(d.prefix))
        rivals = [p for p in self.schema.prefixes.values() if p != d.prefix and p.startswith(d.prefix)]
        for p in rivals:
            rows = rows.where(~F.col("key").startswith(p))
        return rows

    def with_prefix(self, prefix: str) -> DataFrame:
        return self.nodes.where(F.col("key").startswith(prefix))

    # -- lookups -----------------------------------------------------------------

    def by_key(self, key: str) -> DataFrame:
        return self.nodes.where(F.col("key") == key)

    def by_keys(self, wanted: DataFrame) -> DataFrame:
        """wanted: a column key."""
        return self.nodes.join(wanted.select("key").distinct(), "key", "left_semi")

    def get(self, node_type: str, suffix) -> DataFrame:
        return self.nodes.where(F.col("key") == self.schema.node(node_type).key(F.lit(suffix)))

    def node_ref(self, node_type: str, suffix) -> DataFrame:
        return self.get(node_type, suffix).select("id", "key")

    def by_id(self, node_id: int) -> DataFrame:
        """The node and its type by key prefix."""
        return self.nodes.where(F.col("id") == node_id).withColumn("type", self.type_column())

    def key_of(self, ids: DataFrame) -> DataFrame:
        """ids: a column id."""
        return ids.join(self.nodes.select("id", "key"), "id", "left")

    def by_ids(self, ids: list[int], props: list[str] | None = None) -> DataFrame:
        """Nodes in the order of ids (column position, from 0); missing ones are left out."""
        wanted = self.spark.createDataFrame(list(enumerate(ids)), "position int, id long") if ids else self.spark.createDataFrame([], "position int, id long")
        columns = ["key", *(self.node_props if props is None else props)]
        return wanted.join(self.nodes.select("id", *columns), "id").select("position", "id", *columns)

    def type_column(self) -> Column:
        return keys.type_of_key(F.col("key"), self.schema.prefixes)

    # -- properties ----------------------------------------------------------------

    def props_map(self) -> DataFrame:
        """id and a map of all properties that are set, as text."""
        pairs = F.array(*[F.struct(F.lit(p).alias("k"), F.col(p).cast("string").alias("v")) for p in self.node_props])
        return self.nodes.select("id", F.map_from_entries(F.filter(pairs, lambda e: e["v"].isNotNull())).alias("props"))

    def node_prop(self, name: str, kind: str | None = None) -> DataFrame:
        value = F.col(name) if kind is None else keys.typed(F.col(name), kind)
        return self.nodes.select("id", value.alias(name))

    def edge_prop(self, name: str) -> DataFrame:
        return self.edges.select(*EDGE_KEY, name)

    def edge_props_of(self, src: int, etype: str, dst: int) -> DataFrame:
        return self.edges.where((F.col("src") == src) & (F.col("etype") == etype) & (F.col("dst") == dst))

    # -- existence -----------------------------------------------------------------

    def exists(self, ids: DataFrame) -> DataFrame:
        """ids with a boolean column found."""
        known = self.nodes.select("id", F.lit(True).alias("_found"))
        return ids.join(known, "id", "left").select(*ids.columns, F.coalesce("_found", F.lit(False)).alias("found"))

    def edge_exists(self, wanted: DataFrame) -> DataFrame:
        """wanted (src, etype, dst) with a boolean column found."""
        known = self.edges.select(*EDGE_KEY, F.lit(True).alias("_found"))
        return wanted.join(known, EDGE_KEY, "left").select(*wanted.columns, F.coalesce("_found", F.lit(False)).alias("found"))

    def with_relation(self, etype: str | None = None, direction: str = "out") -> DataFrame:
        """Nodes that have an edge of the type in the direction."""
        edges = self.edges if etype is None else self.edges.where(F.col("etype") == etype)
        end = "src" if direction == "out" else "dst"
        return self.nodes.join(edges.select(F.col(end).alias("id")), "id", "left_semi")

    def labels_of(self, node_id: int) -> DataFrame:
        """label, one row for each label of the node."""
        return self.nodes.where(F.col("id") == node_id).select(F.explode("labels").alias("label"))

    def with_label(self, label: str) -> DataFrame:
        return self.nodes.where(F.array_contains("labels", label))

    # -- neighbours ------------------------------------------------------------------

    def neighbors(self, frontier: DataFrame, direction: str = "out", etype=None, columns=()) -> DataFrame:
        """frontier (id, ...) joined with its edges: neighbor, src, etype, dst, dir (0 out, 1 in).

        `both` is the outgoing edges followed by the incoming ones, without removing
        doubles: a self-loop comes twice."""
        edges = self.edges.select(*EDGE_KEY, *columns)
        if etype is not None:
            edges = edges.where(F.col("etype").isin(list(etype)) if not isinstance(etype, str) else F.col("etype") == etype)
        parts = []
        if direction in ("out", "both"):
            parts.append(edges.select(F.col("src").alias("id"), F.col("dst").alias("neighbor"), *edges.columns, F.lit(0).alias("dir")))
        if direction in ("in", "both"):
            parts.append(edges.select(F.col("dst").alias("id"), F.col("src").alias("neighbor"), *edges.columns, F.lit(1).alias("dir")))
        if not parts:
            raise ValueError(f"unknown direction {direction!r}")
        step = parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0]
        return frontier.join(step, "id")

    # -- counts ------------------------------------------------------------------------

    def count_nodes(self) -> DataFrame:
        return self.nodes.agg(F.count("*").alias("n"))

    def count_edges(self, etype: str | None = None) -> DataFrame:
        return self.live_edges(etype).agg(F.count("*").alias("n"))

    def count_nodes_by_type(self) -> DataFrame:
        return self.nodes.groupBy(self.type_column().alias("type")).agg(F.count("*").alias("n"))

    def count_edges_by_type(self) -> DataFrame:
        return self.live_edges().groupBy("etype").agg(F.count("*").alias("n"))

    def degrees(self, direction: str = "out", etype: str | None = None) -> DataFrame:
        """id and degree of every node, 0 included; `both` adds both ends."""
        edges = self.edges if etype is None else self.edges.where(F.col("etype") == etype)
        ends = {"out": ["src"], "in": ["dst"], "both": ["src", "dst"]}[direction]
        touched = edges.select(F.explode(F.array(*ends)).alias("id"))
        counts = touched.groupBy("id").agg(F.count("*").alias("_n"))
        return self.nodes.select("id").join(counts, "id", "left").select("id", F.coalesce("_n", F.lit(0)).alias("degree"))

    def accessor_counts(self) -> DataFrame:
        ids = self.edges.select(F.explode(F.array("src", "dst")).alias("id"))
        return ids.agg(F.countDistinct("id").alias("nodes"), (F.count("*") / 2).cast("long").alias("edges"))

    def stats(self) -> DataFrame:
        """One row: nodes, edges, edge types, largest id."""
        rows = self.nodes.select("id", F.lit(None).cast("string").alias("etype"), F.lit(1).alias("node"))
        rows = rows.unionByName(self.edges.select(F.lit(None).cast("long").alias("id"), "etype", F.lit(0).alias("node")))
        return rows.agg(
            F.coalesce(F.sum("node"), F.lit(0)).alias("nodes"), F.max("id").alias("max_node_id"), F.count_if(F.col("node") == 0).alias("edges"), F.countDistinct("etype").alias("edge_types")
        )

    # -- catalog and checks ------------------------------------------------------------

    def catalog(self) -> DataFrame:
        """Names of labels, edge types and property keys with their ids (from 1, by name)."""
        from pyspark.sql import Window

        labels = self.nodes.select(F.explode("labels").alias("name")).distinct().select(F.lit("label").alias("kind"), "name")
        etypes = self.edges.select(F.col("etype").alias("name")).distinct().select(F.lit("etype").alias("kind"), "name")
        props = self.spark.createDataFrame([("propkey", p) for p in sorted({*self.node_props, *self.edge_props})], "kind string, name string")
        # As many rows as there are names.
        return labels.union(etypes).union(props).select("kind", F.row_number().over(Window.partitionBy("kind").orderBy("name")).alias("id"), "name")

    def describe(self) -> str:
        nodes = "\n".join(f"  {d.name} ({d.prefix}): {', '.join(p.name + (' required' if p.required else '') for p in d.props)}" for d in self.schema.nodes.values())
        edges = "\n".join(f"  {d.name}: {', '.join(p.name for p in d.props)}" for d in self.schema.edges.values())
        return f"Node types:\n{nodes}\nEdge types:\n{edges}"

    def check(self) -> DataFrame:
        """problem and the row it is about; no rows: the graph is consistent.

        Dangling ends, doubled ids, keys and edges, null parts of an edge's key, and
        (with a schema) keys of no type and edges of no declared type."""
        ids = self.nodes.select(F.col("id").alias("_id"))
        edge = F.concat_ws("/", F.col("src").cast("string"), "etype", F.col("dst").cast("string"))
        found = [
            self.edges.join(ids, F.col("src") == F.col("_id"), "left_anti").select(F.lit("dangling src").alias("problem"), edge.alias("item")),
            self.edges.join(ids, F.col("dst") == F.col("_id"), "left_anti").select(F.lit("dangling dst"), edge),
            self.nodes.groupBy("id").count().where("count > 1").select(F.lit("doubled id"), F.col("id").cast("string")),
            self.nodes.where("key is not null").groupBy("key").count().where("count > 1").select(F.lit("doubled key"), "key"),
            self.edges.groupBy(*EDGE_KEY).count().where("count > 1").select(F.lit("doubled edge"), edge),
            self.edges.where("src is null or etype is null or dst is null").select(F.lit("incomplete edge"), edge),
        ]
        if self.schema.nodes:
            found.append(self.nodes.where(F.col("key").isNotNull() & self.type_column().isNull()).select(F.lit("unknown node type"), "key"))
        if self.schema.edges:
            found.append(self.edges.where(~F.col("etype").isin(list(self.schema.edges))).select(F.lit("unknown edge type"), edge))
        whole = found[0]
        for f in found[1:]:
            whole = whole.union(f)
        return whole

    def reciprocity(self, incoming: DataFrame) -> DataFrame:
        """Edges that a reversed copy of the edges (src, etype, dst) lacks or has too many of."""
        both = self.edges.select(*EDGE_KEY, F.lit(1).alias("n")).unionByName(incoming.select(*EDGE_KEY, F.lit(-1).alias("n")))
        return both.groupBy(*EDGE_KEY).agg(F.sum("n").alias("n")).where("n != 0")

    def metrics(self) -> DataFrame:
        """name and value rows; health: no dangling edges."""
        stats = self.stats()
        wide = stats.select(F.expr("stack(4, 'nodes', nodes, 'edges', edges, 'edge_types', edge_types, 'max_node_id', max_node_id) as (name, value)"))
        ids = self.nodes.select(F.col("id").alias("_id"))
        dangling = self.edges.join(ids, F.col("src") == F.col("_id"), "left_anti").unionByName(self.edges.join(ids, F.col("dst") == F.col("_id"), "left_anti"))
        return wide.unionByName(dangling.select(*EDGE_KEY).distinct().agg(F.count("*").alias("value")).select(F.lit("dangling_edges").alias("name"), "value"))

    def metrics_text(self) -> DataFrame:
        """The metrics as lines of the usual text exposition format."""
        return self.metrics().select(F.concat(F.lit("loomgraph_"), "name", F.lit(" "), F.col("value").cast("string")).alias("line"))

    def cached(self) -> Graph:
        return replace(self, nodes=self.nodes.persist(), edges=self.edges.persist())
