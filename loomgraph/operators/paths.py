"""Path finding by rounds of frontier relaxation; no adjacency ever leaves the executors."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys
from ..sources.shared import cut
from .graph import EDGE_KEY, Graph

PATH = "path array<long>, edges array<struct<src:long,etype:string,dst:long>>, total_weight double, found boolean"


@dataclass(frozen=True)
class Path:
    path: list[int]
    edges: list[tuple[int, str, int]]
    total_weight: float
    found: bool
    weights: tuple[float, ...] = ()


NOT_FOUND = Path([], [], float("inf"), False)


@dataclass(frozen=True)
class PathFinder:
    """Shortest paths from source to the nearest of targets.

    weight: an expression over edge columns (missing, zero, negative or non-numeric
    values count 1); without one, every edge weighs 1. Edge types in via, a direction
    and max_depth restrict the search. As in a search that settles nodes by cost, a node
    whose cheapest path has max_depth edges isn't gone on from. Ties go to fewer edges,
    then the smaller node and edge type before."""

    graph: Graph
    source: int
    targets: tuple[int, ...] = ()
    types: tuple[str, ...] = ()
    direction: str = "out"
    max_depth: int = 100
    weight: Column | None = None
    heuristic: Column | None = None

    def to(self, target: int) -> PathFinder:
        return replace(self, targets=(target,))

    def to_any(self, targets) -> PathFinder:
        return replace(self, targets=tuple(targets))

    def via(self, *types: str) -> PathFinder:
        return replace(self, types=(*self.types, *types))

    def depth(self, n: int) -> PathFinder:
        return replace(self, max_depth=n)

    def bidirectional(self) -> PathFinder:
        return replace(self, direction="both")

    def weighted(self, by: Column | str) -> PathFinder:
        return replace(self, weight=F.col(by) if isinstance(by, str) else by)

    # -- search -------------------------------------------------------------------

    def _steps(self) -> DataFrame:
        """id, neighbor, w, src, etype, dst: what one relaxation joins with, computed once."""
        edges = self.graph.edges
        if self.types:
            edges = edges.where(F.col("etype").isin(list(self.types)))
        w = keys.weight(self.weight) if self.weight is not None else F.lit(1.0)
        edges = edges.select(*EDGE_KEY, w.alias("w"))
        out = edges.select(F.col("src").alias("id"), F.col("dst").alias("neighbor"), "w", *EDGE_KEY)
        back = edges.select(F.col("dst").alias("id"), F.col("src").alias("neighbor"), "w", *EDGE_KEY)
        return {"out": out, "in": back, "both": out.unionByName(back)}[self.direction]

    def costs(self, stop_at_targets: bool = False, steps: DataFrame | None = None, trails: bool = False) -> DataFrame:
        """node_id, cost, depth, parent, edge of every node reached; with trails also
        trail, the edges (src, etype, dst, w) from the source, so a path needs no looking up.

        Each round relaxes the nodes improved in the last one; a node keeps the least
        (cost, depth, parent, etype), an older one at equal cost. A round is one join of
        the frontier with the edges, which stay where they are, dealt by node, and one
        aggregate; only one row of counts comes to the driver."""
        steps = self._dealt() if steps is None else steps
        spark = self.graph.spark
        edge = "struct<src:bigint,etype:string,dst:bigint>"
        trail = "array<struct<src:bigint,etype:string,dst:bigint,w:double>>"
        best = spark.createDataFrame([(self.source, 0.0, 0, None, None, [], 0)], f"node_id long, cost double, depth int, parent long, edge {edge}, trail {trail}, round int")
        if self.heuristic is not None:
            h = self.graph.nodes.select(F.col("id").alias("node_id"), F.coalesce(self.heuristic, F.lit(0.0)).alias("h"))
        round_, limit = 0, None
        while True:
            frontier = best.where((F.col("round") == round_) & (F.col("depth") < self.max_depth))
            # What can't beat the nearest target found so far needn't be followed.
            if limit is not None:
                if self.heuristic is not None:
                    frontier = frontier.join(h, "node_id", "left").where(F.col("cost") + F.coalesce("h", F.lit(0.0)) < limit)
                else:
                    frontier = frontier.where(F.col("cost") < limit)
            round_ += 1
            near = frontier.withColumnRenamed("node_id", "id").select("id", "cost", "depth", "trail").join(steps, "id")
            near = near.select(
                F.col("neighbor").alias("node_id"), (F.col("cost") + F.col("w")).alias("cost"), (F.col("depth") + 1).alias("depth"), F.col("id").alias("parent"), F.struct(*EDGE_KEY).alias("edge"),
                (F.concat("trail", F.array(F.struct(*EDGE_KEY, "w"))) if trails else F.col("trail")).alias("trail"), F.lit(round_).alias("round")
            )
            both = best.withColumn("fresh", F.lit(0)).unionByName(near.withColumn("fresh", F.lit(1)))
            least = F.min(F.struct("cost", "fresh", "depth", "parent", F.col("edge.etype").alias("t"), "edge", "trail", "round"))
            best = cut(both.groupBy("node_id").agg(least.alias("b")).select("node_id", "b.cost", "b.depth", "b.parent", "b.edge", "b.trail", "b.round"))
            hit = F.min(F.when(F.col("node_id").isin(list(self.targets)), F.col("cost"))) if stop_at_targets and self.targets else F.lit(None).cast("double")
            row = best.agg(F.count_if(F.col("round") == round_).alias("n"), hit.alias("limit")).first()
            limit = row["limit"]
            if not row["n"]:
                return best.drop("round") if trails else best.drop("round", "trail")

    def _dealt(self) -> DataFrame:
        """The steps computed once and dealt by node: a round's join moves the frontier only."""
        n = int(self.graph.spark.conf.get("spark.sql.shuffle.partitions"))
        return cut(self._steps().repartition(n, "id"))

    def _walk(self, trail, cost: float) -> Path:
        nodes, edges = [self.source], [(e["src"], e["etype"], e["dst"]) for e in trail]
        for src, _, dst in edges:
            nodes.append(dst if self.direction == "out" or self.direction == "both" and src == nodes[-1] else src)
        return Path(nodes, edges, cost, True, tuple(e["w"] for e in trail))

    def dijkstra(self, steps: DataFrame | None = None) -> Path:
        if not self.targets:
            return NOT_FOUND
        if self.source in self.targets:
            return Path([self.source], [], 0.0, True)
        best = self.costs(stop_at_targets=True, steps=steps, trails=True)
        hit = best.where(F.col("node_id").isin(list(self.targets))).orderBy("cost", "depth", "node_id").first()
        return self._walk(hit["trail"], hit["cost"]) if hit else NOT_FOUND

    find = dijkstra

    def bfs(self) -> Path:
        return replace(self, weight=None).dijkstra()

    def a_star(self, heuristic: Column) -> Path:
        """heuristic: an expression over node columns, never above the true rest; it only
        prunes. Of several targets the smallest is searched."""
        target = self.targets and (min(self.targets),)
        return replace(self, heuristic=heuristic, targets=target or ()).dijkstra()

    def has_path(self) -> bool:
        return self.bfs().found

    def k_shortest(self, k: int) -> list[Path]:
        """Up to k loopless paths to one target (the smallest of several), in order of
        weight: from each prefix of the last path found, the cheapest way on that uses
        neither its nodes nor an edge that a known path takes from there. Paths over the
        same nodes count once."""
        if k <= 0 or not self.targets:
            return []
        target = min(self.targets)
        one = replace(self, targets=(target,))
        steps = one._dealt()
        best = one.dijkstra(steps)
        if not best.found:
            return []
        done, waiting = [best], []

        while len(done) < k:
            last = done[-1]
            for i in range(len(last.path) - 1):
                root, spur = last.path[: i + 1], last.path[i]
                taken = {p.edges[i] for p in (*done, *waiting) if p.path[: i + 1] == root and len(p.edges) > i}
                allowed = steps
                if root[:-1]:
                    allowed = allowed.where(~F.col("neighbor").isin(root[:-1]))
                for e in taken:
                    allowed = allowed.where(~((F.col("id") == spur) & (F.col("src") == e[0]) & (F.col("etype") == e[1]) & (F.col("dst") == e[2])))
                rest = replace(one, source=spur, max_depth=self.max_depth - i).dijkstra(allowed)
                if rest.found:
                    edges, weights = [*last.edges[:i], *rest.edges], (*last.weights[:i], *rest.weights)
                    path = Path([*root[:-1], *rest.path], edges, sum(last.weights[:i]) + rest.total_weight, True, weights)
                    if all(path.path != p.path for p in (*done, *waiting)):
                        waiting.append(path)
            if not waiting:
                break
            waiting.sort(key=lambda p: (p.total_weight, p.path))
            done.append(waiting.pop(0))
        return done

    def all_paths(self, k: int = 100) -> list[Path]:
        return self.k_shortest(k)

    def frame(self, paths) -> DataFrame:
        """Paths as rows: path, edges, total_weight, found."""
        paths = [paths] if isinstance(paths, Path) else paths
        return self.graph.spark.createDataFrame([(p.path, p.edges, p.total_weight, p.found) for p in paths], PATH)


def shortest_path(graph: Graph, source: int, target: int) -> PathFinder:
    return PathFinder(graph, source, (target,))


def impact(graph: Graph, source: int, max_depth: int = 100) -> DataFrame:
    """Everything that depends on the source: node_id, depth and the edge types met on
    the way in (sorted), over incoming edges."""
    spark = graph.spark
    level = spark.createDataFrame([(source,)], "node_id long")
    seen = level.select("node_id", F.lit(0).alias("depth"), F.array().cast("array<string>").alias("etypes"))
    for depth in range(1, max_depth + 1):
        near = graph.neighbors(level.select(F.col("node_id").alias("id")), "in").select(F.col("neighbor").alias("node_id"), "etype")
        near = near.join(seen.select("node_id"), "node_id", "left_anti")
        level = cut(near.groupBy("node_id").agg(F.sort_array(F.collect_set("etype")).alias("etypes")))
        if level.isEmpty():
            break
        seen = cut(seen.unionByName(level.select("node_id", F.lit(depth).alias("depth"), "etypes")))
    return seen.where("depth > 0")


def bfs_depths(graph: Graph, source: int, etype=None, direction: str = "out", max_depth: int = 100) -> DataFrame:
    """node_id and its least number of hops, the source with 0."""
    finder = PathFinder(graph, source, (), (etype,) if etype else (), direction, max_depth)
    return finder.costs().select("node_id", F.col("depth"))
