"""Version tables: reads as of a time, conflict checks, garbage collection.

versions: entity, entity_id, prop, value, txid, commit_ts, deleted; one row for each
value that was ever committed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHAIN = ["entity", "entity_id", "prop"]


def as_of(versions: DataFrame, ts: int, txid: int | None = None) -> DataFrame:
    """The state a snapshot taken at ts sees: of each chain the latest version committed
    before ts (strictly), or the reader's own; baseline versions (txid 0, commit_ts 0)
    are seen by all. Deleted ones give no row."""
    seen = (F.col("commit_ts") < ts) | ((F.col("txid") == 0) & (F.col("commit_ts") == 0))
    order = F.struct("commit_ts", "txid")
    if txid is not None:
        own = F.col("txid") == txid
        seen, order = seen | own, F.struct(own.cast("int").alias("own"), "commit_ts", "txid")
    latest = versions.where(seen).groupBy(*CHAIN).agg(F.max_by(F.struct("value", "txid", "commit_ts", "deleted"), order).alias("v"))
    return latest.where(~F.col("v.deleted")).select(*CHAIN, "v.value", "v.txid", "v.commit_ts")


def conflict_keys(ops: DataFrame) -> DataFrame:
    """ops: txid, op (create_node, delete_node, set_node_prop, add_edge, delete_edge,
    set_edge_prop, label), node_id, src, etype, dst, prop. txid and key: everything that
    each write counts as having touched. An edge touches itself and the neighbour sets of
    both ends, typed and untyped; a deleted node its labels, key and neighbour sets."""
    c = lambda *parts: F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    node, src, dst, etype, prop = (F.col(x) for x in ("node_id", "src", "dst", "etype", "prop"))
    sets = lambda out, inn: [c("out", out), c("out", out, etype), c("in", inn), c("in", inn, etype)]
    touched = (
        F.when(F.col("op").isin("add_edge", "delete_edge"), F.array(c("edge", src, etype, dst), *sets(src, dst)))
        .when(F.col("op") == "delete_node", F.array(c("node", node), c("labels", node), c("key", node), c("out", node), c("in", node)))
        .when(F.col("op") == "create_node", F.array(c("node", node), c("key", node)))
        .when(F.col("op") == "set_node_prop", F.array(c("nodeprop", node, prop)))
        .when(F.col("op") == "set_edge_prop", F.array(c("edgeprop", src, etype, dst, prop)))
        .when(F.col("op") == "label", F.array(c("labels", node)))
    )
    return ops.select("txid", F.explode(touched).alias("key")).distinct()


def conflicts(active: DataFrame, touched: DataFrame, commits: DataFrame) -> DataFrame:
    """active: txid, start_ts; touched: txid, key (reads and writes); commits: key,
    commit_ts of committed writes. txid and key of each conflict: a key whose last
    commit isn't before the transaction's start, whether it was read or written."""
    last = commits.groupBy("key").agg(F.max("commit_ts").alias("commit_ts"))
    rows = active.join(touched.select("txid", "key").distinct(), "txid").join(last, "key")
    return rows.where(F.col("commit_ts") >= F.col("start_ts")).select("txid", "key", "commit_ts")


def collect_garbage(versions: DataFrame, min_active_ts: int, now: int, retention: int = 60_000, depth: int = 10) -> DataFrame:
    """The versions to keep: in each chain all from the horizon on (the smaller of
    min_active_ts and now - retention), the newest one before it, and of these the
    `depth` newest."""
    horizon = min(min_active_ts, now - retention)
    newest = Window.partitionBy(*CHAIN).orderBy(F.desc("commit_ts"), F.desc("txid"))
    rows = versions.withColumn("_old", F.col("commit_ts") < horizon)
    within = Window.partitionBy(*CHAIN, "_old").orderBy(F.desc("commit_ts"), F.desc("txid"))
    rows = rows.withColumn("_r", F.row_number().over(within)).where(~F.col("_old") | (F.col("_r") == 1))
    return rows.withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= depth).select(*versions.columns)
