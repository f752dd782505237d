"""Stores, exchange files, pages and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys
from ..operators.graph import EDGE_KEY, Graph
from ..operators.mutate import next_ids
from ..operators.schema import Schema


def save(graph: Graph, path: str) -> None:
    """Nodes sorted by key (row groups and bloom filters then answer lookups), edges by
    type and sorted by source."""
    graph.nodes.repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").option("parquet.bloom.filter.enabled#key", "true").parquet(f"{path}/nodes")
    graph.edges.repartition("etype", "src").sortWithinPartitions("src", "dst").write.mode("overwrite").partitionBy("etype").parquet(f"{path}/edges")


def load(spark: SparkSession, path: str, schema: Schema | None = None) -> Graph:
    edges = spark.read.parquet(f"{path}/edges")
    return Graph(spark.read.parquet(f"{path}/nodes"), edges.select(*EDGE_KEY, *[c for c in edges.columns if c not in EDGE_KEY]), schema or Schema())


def backup(graph: Graph, path: str) -> DataFrame:
    """A copy and a row about it: nodes and edges in it."""
    save(graph, path)
    return info(graph.spark, path)


def restore(spark: SparkSession, path: str, to: str, schema: Schema | None = None) -> Graph:
    save(load(spark, path, schema), to)
    return load(spark, to, schema)


def info(spark: SparkSession, path: str) -> DataFrame:
    return load(spark, path).stats().select("nodes", "edges")


# -- pages and batches -----------------------------------------------------------


def node_page(graph: Graph, limit: int = 100, cursor: str | None = None) -> tuple[DataFrame, str | None]:
    """Nodes after the cursor ("n:<id>") by id, and the next cursor (None at the end).
    Keys, not positions: a cursor stays good when its node goes."""
    rows = graph.nodes
    if cursor:
        rows = rows.where(F.col("id") > int(cursor.removeprefix("n:")))
    page = rows.orderBy("id").limit(limit)
    ids = [r["id"] for r in rows.select("id").orderBy("id").limit(limit + 1).collect()]
    return page, f"n:{ids[limit - 1]}" if len(ids) > limit else None


def after_edge(cursor: str):
    """The condition on edges after "e:<src>:<etype>:<dst>"."""
    _, src, rest = cursor.split(":", 2)
    etype, dst = rest.rsplit(":", 1)
    return F.struct(*EDGE_KEY) > F.struct(F.lit(int(src)).cast("long").alias("src"), F.lit(etype).alias("etype"), F.lit(int(dst)).cast("long").alias("dst"))


def edge_page(graph: Graph, limit: int = 100, cursor: str | None = None) -> tuple[DataFrame, str | None]:
    rows = graph.edges.where(after_edge(cursor)) if cursor else graph.edges
    found = rows.select(*EDGE_KEY).orderBy(*EDGE_KEY).limit(limit + 1).collect()
    last = found[limit - 1] if len(found) > limit else None
    return rows.orderBy(*EDGE_KEY).limit(limit), f"e:{last['src']}:{last['etype']}:{last['dst']}" if last else None


def batches(rows: DataFrame, size: int = 1000):
    """Lists of rows of a frame, partition by partition, never all at once."""
    waiting = []
    for row in rows.toLocalIterator(prefetchPartitions=True):
        waiting.append(row)
        if len(waiting) == size:
            yield waiting
            waiting = []
    if waiting:
        yield waiting


def numbered_batches(ids: DataFrame, size: int = 1000) -> DataFrame:
    """id and batch (from 0): batches of `size` in order of id. Ranges of ids are counted
    first, so ranking stays within ranges."""
    return _ranked(ids).select("id", F.floor((F.col("_n") - 1) / size).cast("long").alias("batch"))


def _ranked(ids: DataFrame) -> DataFrame:
    """ids with their rank (_n, from 1) by id."""
    empty = Graph(ids.where(F.lit(False)), ids.where(F.lit(False)))
    return next_ids(empty, ids.select(F.col("id").alias("_id")), "_id").select(F.col("_id").alias("id"), F.col("id").alias("_n"))


# -- exchange ------------------------------------------------------------------------


def _tagged_props(df: DataFrame, props: list[str]):
    kinds = dict(df.dtypes)
    pairs = [F.struct(F.lit(p).alias("k"), keys.tagged(F.col(p), kinds[p]).alias("v")) for p in props]
    none = F.array().cast("array<struct<k:string,v:struct<type:string,value:string>>>")
    return F.map_from_entries(F.filter(F.array(*pairs), lambda e: e["v"]["type"] != "null") if pairs else none)


def export_frames(graph: Graph, with_props: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, key, labels, props) and edges (src, etype, dst, props); values are tagged
    with their types."""
    nodes = graph.nodes.select("id", "key", "labels", *([_tagged_props(graph.nodes, graph.node_props).alias("props")] if with_props else []))
    edges = graph.edges.select(*EDGE_KEY, *([_tagged_props(graph.edges, graph.edge_props).alias("props")] if with_props else []))
    return nodes, edges


def jsonl_lines(graph: Graph) -> DataFrame:
    """line (text) and ord: a header, a schema line, node lines, edge lines, each
    {"type": ..., "data": ...}."""
    nodes, edges = export_frames(graph)
    wrap = lambda kind, data: F.to_json(F.struct(F.lit(kind).alias("type"), data.alias("data")))
    stats = graph.stats()
    header = stats.select(wrap("header", F.struct(F.lit(1).alias("version"), "nodes", "edges")).alias("line"), F.lit(0).alias("ord"))
    etypes = graph.edges.agg(F.sort_array(F.collect_set("etype")).alias("etypes"))  # names of edge types
    props = F.array(*[F.lit(p) for p in sorted({*graph.node_props, *graph.edge_props})]).cast("array<string>")
    schema = etypes.select(wrap("schema", F.struct("etypes", props.alias("props"))).alias("line"), F.lit(1).alias("ord"))
    node_lines = nodes.select(wrap("node", F.struct(*nodes.columns)).alias("line"), F.lit(2).alias("ord"))
    edge_lines = edges.select(wrap("edge", F.struct(*edges.columns)).alias("line"), F.lit(3).alias("ord"))
    return header.unionByName(schema).unionByName(node_lines).unionByName(edge_lines)


def export_jsonl(graph: Graph, path: str) -> None:
    """A folder of text files, the header's first."""
    jsonl_lines(graph).repartitionByRange("ord", "line").sortWithinPartitions("ord", "line").select("line").write.mode("overwrite").text(path)


def export_json(graph: Graph, path: str) -> None:
    """One JSON object a row: nodes and edges in a folder each."""
    nodes, edges = export_frames(graph)
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


PROPS = "map<string,struct<type:string,value:string>>"
NODE_JSON = f"id long, key string, labels array<string>, props {PROPS}"
EDGE_JSON = f"src long, etype string, dst long, props {PROPS}"


def import_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    lines = spark.read.text(path).select(F.from_json("value", "type string, data string").alias("l")).select("l.*")
    nodes = lines.where(F.col("type") == "node").select(F.from_json("data", NODE_JSON).alias("d")).select("d.*")
    edges = lines.where(F.col("type") == "edge").select(F.from_json("data", EDGE_JSON).alias("d")).select("d.*")
    return nodes, edges


def import_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema(NODE_JSON).json(f"{path}/nodes"), spark.read.schema(EDGE_JSON).json(f"{path}/edges")


def _untagged(df: DataFrame, like: DataFrame, props: list[str]) -> list:
    kinds = dict(like.dtypes)
    return [keys.untagged(F.col("props")[p], kinds[p]).cast(kinds[p]).alias(p) for p in props]


def merge_import(graph: Graph, nodes: DataFrame, edges: DataFrame, skip_existing: bool = True) -> Graph:
    """The graph with imported nodes and edges. Nodes get new ids; with skip_existing,
    those whose key is known stand for the known node. Edges follow the new ids; edges
    with an end that wasn't imported are left out, known edges stay as they are."""
    known = graph.nodes.where("key is not null").select(F.col("id").alias("new_id"), "key")
    if skip_existing:
        met = nodes.join(known, "key").select(F.col("id").alias("old_id"), "new_id")
        fresh = nodes.join(known.select("key"), "key", "left_anti")
    else:
        met, fresh = None, nodes
    fresh = next_ids(graph, fresh.withColumnRenamed("id", "old_id"), "old_id")
    mapping = fresh.select("old_id", F.col("id").alias("new_id"))
    mapping = mapping if met is None else mapping.unionByName(met)
    props = _untagged(fresh, graph.nodes, graph.node_props) if "props" in fresh.columns else [F.lit(None).cast(t).alias(c) for c, t in graph.nodes.dtypes if c in graph.node_props]
    labels = F.coalesce("labels", F.array().cast("array<string>")) if "labels" in fresh.columns else F.array().cast("array<string>")
    added = fresh.select("id", "key", labels.alias("labels"), *props)
    moved = edges.join(mapping.withColumnsRenamed({"old_id": "src", "new_id": "_s"}), "src").join(mapping.withColumnsRenamed({"old_id": "dst", "new_id": "_d"}), "dst")
    eprops = _untagged(moved, graph.edges, graph.edge_props) if "props" in moved.columns else [F.lit(None).cast(t).alias(c) for c, t in graph.edges.dtypes if c in graph.edge_props]
    moved = moved.select(F.col("_s").alias("src"), "etype", F.col("_d").alias("dst"), *eprops).dropDuplicates(EDGE_KEY)
    moved = moved.join(graph.edges.select(*EDGE_KEY), EDGE_KEY, "left_anti").select(*graph.edges.columns)
    return Graph(graph.nodes.unionByName(added.select(*graph.nodes.columns)), graph.edges.unionByName(moved), graph.schema)


# -- versions of a store ------------------------------------------------------------


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that were published whole."""
    where, files = _files(spark, path)
    if not files.exists(where):
        return []
    names = [s.getPath().getName() for s in files.listStatus(where)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("version="))


def publish(graph: Graph, path: str) -> int:
    """Write the graph beside earlier versions and make it current in one step: the
    folder gets its name only when everything is in it."""
    import uuid

    spark = graph.spark
    number = max(versions(spark, path), default=-1) + 1
    part = f"{path}/.part-{uuid.uuid4().hex}"
    save(graph, part)
    source, files = _files(spark, part)
    target, _ = _files(spark, f"{path}/version={number}")
    if files.exists(target) or not files.rename(source, target):
        files.delete(source, True)
        raise RuntimeError(f"version {number} was published by another writer")
    return number


def current(spark: SparkSession, path: str, schema: Schema | None = None, number: int | None = None) -> Graph:
    known = versions(spark, path)
    if not known or number is not None and number not in known:
        raise LookupError(f"{path} has no version {'at all' if number is None else number}")
    return load(spark, f"{path}/version={known[-1] if number is None else number}", schema)


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> list[int]:
    """Delete all but the `keep` newest versions; returns their numbers."""
    gone = versions(spark, path)[:-keep] if keep else versions(spark, path)
    for n in gone:
        where, files = _files(spark, f"{path}/version={n}")
        files.delete(where, True)
    return gone


def optimize(spark: SparkSession, path: str, schema: Schema | None = None) -> int:
    """Write the current version anew, sorted and in few files, as the next version."""
    return publish(current(spark, path, schema), path)
