"""Fluent traversals, compiled to one DataFrame plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut
from .graph import EDGE_KEY, Graph

#: How results are made unique. global: a node once in the whole traversal, never a
#: start node; per_step: once in each step; none: as often as it is reached.
GLOBAL, PER_STEP, NONE = "global", "per_step", "none"

RESULT = ["node_id", "edge", "depth", "ord"]

Predicate = Callable[[Callable[[str], Column]], Column]


@dataclass(frozen=True)
class Step:
    direction: str
    etype: object = None
    where_edge: Column | None = None
    where_node: Column | None = None
    min_depth: int = 1
    max_depth: int | None = None  # None: a single hop
    unique: bool = True


@dataclass(frozen=True)
class Traversal:
    """start (node_id and, if rows are to keep an order, position) and steps.

    Filters are conditions on columns: of the edge (src, etype, dst and properties) or
    of the node (id, key, labels and properties). A step's filters decide where it
    goes on; where_edge and where_node of the traversal look at final rows only, and
    rows without an edge (start nodes) pass where_edge. Rows have node_id, edge
    (struct of src, etype, dst; null at start nodes), depth and ord. ord sorts rows as
    a walk would meet them: by the node before, then outgoing before incoming, then
    etype, then neighbour; it decides which edge is named as the one that led to a node
    and which rows take() keeps."""

    graph: Graph
    start: DataFrame
    steps: tuple[Step, ...] = ()
    uniqueness: str = GLOBAL
    edge_filter: Column | None = None
    node_filter: Column | None = None
    limit: int | None = None

    # -- building ------------------------------------------------------------------

    @classmethod
    def from_nodes(cls, graph: Graph, ids) -> Traversal:
        if isinstance(ids, DataFrame):
            start = ids.select(F.col(ids.columns[0]).alias("node_id"), (F.col("position") if "position" in ids.columns else F.lit(0)).alias("position"))
        else:
            start = graph.spark.createDataFrame([(int(i), k) for k, i in enumerate(ids)], "node_id long, position int")
        return cls(graph, start)

    def _step(self, **kind) -> Traversal:
        return replace(self, steps=(*self.steps, Step(**kind)))

    def out(self, etype=None, where_edge=None, where_node=None) -> Traversal:
        return self._step(direction="out", etype=etype, where_edge=where_edge, where_node=where_node)

    def in_(self, etype=None, where_edge=None, where_node=None) -> Traversal:
        return self._step(direction="in", etype=etype, where_edge=where_edge, where_node=where_node)

    def both(self, etype=None, where_edge=None, where_node=None) -> Traversal:
        return self._step(direction="both", etype=etype, where_edge=where_edge, where_node=where_node)

    def traverse(self, etype=None, max_depth: int = 1, min_depth: int = 1, direction: str = "out", unique: bool = True, where_edge=None, where_node=None) -> Traversal:
        return self._step(direction=direction, etype=etype, where_edge=where_edge, where_node=where_node, min_depth=min_depth, max_depth=max_depth, unique=unique)

    def where_edge(self, condition: Column) -> Traversal:
        return replace(self, edge_filter=condition)

    def where_node(self, condition: Column) -> Traversal:
        return replace(self, node_filter=condition)

    def take(self, n: int) -> Traversal:
        return replace(self, limit=n)

    def unique(self, on: bool | str = True) -> Traversal:
        return replace(self, uniqueness=on if isinstance(on, str) else GLOBAL if on else NONE)

    # -- compiling -----------------------------------------------------------------

    def _expand(self, frontier: DataFrame, step: Step) -> DataFrame:
        """All edges of the step from the frontier: node_id, edge, depth + 1, ord."""
        props = self.graph.edge_props if step.where_edge is not None else []
        near = self.graph.neighbors(frontier.select(F.col("node_id").alias("id"), "depth", "ord"), step.direction, step.etype, props)
        if step.where_edge is not None:
            near = near.where(step.where_edge)
        here = F.struct(F.col("dir").cast("int").alias("d"), F.col("etype").alias("e"), F.col("neighbor").alias("n"))
        near = near.select(
            F.col("neighbor").alias("node_id"),
            F.struct(*EDGE_KEY).alias("edge"),
            (F.col("depth") + 1).alias("depth"),
            F.concat("ord", F.array(here)).alias("ord"),
        )
        return self._passing(near, step.where_node) if step.where_node is not None else near

    def _passing(self, rows: DataFrame, condition: Column) -> DataFrame:
        """Rows whose node meets a condition on the node's columns."""
        met = self.graph.nodes.where(condition).select(F.col("id").alias("_id"))
        return rows.join(met, rows.node_id == F.col("_id"), "left_semi")

    def _first(self, rows: DataFrame, *by: str) -> DataFrame:
        """The first row in order for each node: an aggregate, so it combines before the shuffle."""
        best = F.min(F.struct("ord", "edge", "depth"))
        return rows.groupBy("node_id", *by).agg(best.alias("b")).select("node_id", *by, "b.edge", "b.depth", "b.ord")

    def frontier(self) -> DataFrame:
        """Rows after all steps, before filters and limit."""
        zero = F.struct(F.lit(0).alias("d"), F.lit("").alias("e"), F.col("position").cast("long").alias("n"))
        no_edge = F.lit(None).cast("struct<src:bigint,etype:string,dst:bigint>")
        now = self.start.select("node_id", no_edge.alias("edge"), F.lit(0).alias("depth"), F.array(zero).alias("ord"))
        if len(self.steps) > 1 and self.uniqueness == GLOBAL:
            now = cut(now)
        visited = now.select("node_id")
        for place, step in enumerate(self.steps):
            if step.max_depth is None:
                now = self._expand(now, step)
                if self.uniqueness == GLOBAL:
                    now = self._first(now.join(visited, "node_id", "left_anti"))
                    # Each later step reads this frontier twice: as start and as visited.
                    now = cut(now) if place + 1 < len(self.steps) else now
                    visited = visited.unionByName(now.select("node_id"))
                elif self.uniqueness == PER_STEP:
                    now = self._first(now)
            else:
                now, visited = self._variable(now, visited, step)
        return now

    def _variable(self, start: DataFrame, visited: DataFrame, step: Step):
        """Level by level from all of start; depths count from 0 again. A node is met at
        its first level only; levels before min_depth go on but aren't results."""
        level = start.select("node_id", "edge", F.lit(0).alias("depth"), "ord")
        local = level.select("node_id")
        found = []
        for depth in range(1, step.max_depth + 1):
            rows = self._expand(level, step)
            if self.uniqueness == GLOBAL:
                rows = rows.join(visited, "node_id", "left_anti")
            if step.unique:
                rows = rows.join(local, "node_id", "left_anti")
            if step.unique or self.uniqueness == GLOBAL:
                rows = self._first(rows)
            level = cut(rows) if step.max_depth > 3 else rows
            if step.max_depth > 3 and level.isEmpty():
                break
            if step.unique:
                local = local.unionByName(level.select("node_id"))
            if self.uniqueness == GLOBAL:
                visited = visited.unionByName(level.select("node_id"))
            if depth >= step.min_depth:
                found.append(level)
        rows = found[0] if found else level.where(F.lit(False))
        for more in found[1:]:
            rows = rows.unionByName(more)
        return rows, visited

    # -- results ---------------------------------------------------------------------

    def results(self) -> DataFrame:
        """node_id, edge, depth, ord: filtered, then cut at the limit."""
        rows = self.frontier()
        if self.edge_filter is not None:
            edges = self.graph.edges.where(self.edge_filter).select(F.struct(*EDGE_KEY).alias("_edge")).distinct()
            rows = rows.where("edge is null").unionByName(rows.where("edge is not null").join(edges, rows.edge == F.col("_edge"), "left_semi"))
        if self.node_filter is not None:
            rows = self._passing(rows, self.node_filter)
        if self.limit is not None:
            rows = rows.orderBy(F.size("ord"), "ord").limit(self.limit)
        return rows

    def ids(self) -> DataFrame:
        return self.results().select("node_id")

    def keys(self) -> DataFrame:
        return self.select()

    def select(self, *props: str) -> DataFrame:
        """node_id, key and the named properties (only these are read)."""
        nodes = self.graph.nodes.select(F.col("id").alias("node_id"), "key", *props)
        return self.ids().join(nodes, "node_id", "left")

    def nodes(self) -> DataFrame:
        return self.select(*self.graph.node_props)

    def edges(self, props: bool = False) -> DataFrame:
        """The edges that led to the results."""
        rows = self.results().where("edge is not null").select("edge.*")
        return rows.join(self.graph.edges, EDGE_KEY, "left") if props else rows

    def raw_edges(self) -> DataFrame:
        """All edges of the last step, whatever was visited before it."""
        if not self.steps or self.steps[-1].max_depth is not None:
            raise ValueError("raw_edges needs a single hop as last step")
        before = replace(self, steps=self.steps[:-1], limit=None, edge_filter=None, node_filter=None)
        return self._expand(before.frontier(), self.steps[-1]).select("edge.*")

    def first(self) -> DataFrame:
        return self.take(1).results()

    def count_results(self) -> DataFrame:
        return self.results().agg(F.count("*").alias("n"))

    def count_frontier(self) -> DataFrame:
        """The quick count: distinct nodes step by step, without a memory of earlier
        steps, held at the limit. With filters or variable depth it is the count of results."""
        if self.edge_filter is not None or self.node_filter is not None or any(s.max_depth is not None or s.where_edge is not None or s.where_node is not None for s in self.steps):
            return self.count_results()
        now = self.start.select("node_id")
        for s in self.steps:
            now = self.graph.neighbors(now.select(F.col("node_id").alias("id")), s.direction, s.etype).select(F.col("neighbor").alias("node_id")).distinct()
        n = F.count("*")
        return now.agg((F.least(n, F.lit(self.limit)) if self.limit is not None else n).cast("long").alias("n"))


def reachable_from(graph: Graph, source, max_depth: int, etype=None, direction: str = "out") -> DataFrame:
    """Nodes within max_depth of the source, without it."""
    return Traversal.from_nodes(graph, [source] if isinstance(source, int) else source).traverse(etype, max_depth=max_depth, direction=direction).ids()


def traverse_per_origin(graph: Graph, starts, max_depth: int, etype=None, direction: str = "out", min_depth: int = 1, where_edge=None) -> DataFrame:
    """Breadth-first from each start on its own: origin, node_id, depth."""
    t = Traversal.from_nodes(graph, starts)
    level = t.start.select(F.col("node_id").alias("origin"), "node_id", F.lit(0).alias("depth"))
    seen, found = level, []
    for depth in range(1, max_depth + 1):
        near = graph.neighbors(level.withColumnRenamed("node_id", "id"), direction, etype, graph.edge_props if where_edge is not None else [])
        if where_edge is not None:
            near = near.where(where_edge)
        rows = near.select("origin", F.col("neighbor").alias("node_id"), F.lit(depth).alias("depth")).distinct()
        level = rows.join(seen.select("origin", "node_id"), ["origin", "node_id"], "left_anti")
        level = cut(level) if max_depth > 3 else level
        seen = seen.unionByName(level)
        if depth >= min_depth:
            found.append(level)
    rows = found[0] if found else level.where(F.lit(False))
    for more in found[1:]:
        rows = rows.unionByName(more)
    return rows
