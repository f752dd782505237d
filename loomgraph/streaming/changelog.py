"""The replication log: commit frames, replay, streaming catch-up, retention.

log: epoch, log_index, txid, seq, op and the columns of a batch operation (node_id,
key, src, etype, dst, prop, value). Frames are ordered by (epoch, log_index), operations
in a frame by seq.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.graph import Graph
from ..operators.mutate import batch

LOG = "epoch long, log_index long, txid long, seq int, op string, node_id long, key string, src long, etype string, dst long, prop string, value string"


def append(frames: DataFrame, path: str) -> None:
    """Append commit frames to a log folder, one directory for each epoch."""
    frames.select(*[c.split()[0] for c in LOG.split(", ")]).write.mode("append").partitionBy("epoch").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG).parquet(path)


def committed(log: DataFrame) -> DataFrame:
    """Operations of transactions that have a commit record."""
    commits = log.where(F.col("op") == "commit").select("txid")
    return log.where(~F.col("op").isin("begin", "commit", "rollback")).join(commits, "txid", "left_semi")


def frames_after(log: DataFrame, epoch: int, log_index: int, most: int | None = None) -> DataFrame:
    """The next frames after a position, at most so many (None: all). A gap right after the
    position is an error: the reader has to start anew from a snapshot."""
    later = log.where((F.col("epoch") > epoch) | ((F.col("epoch") == epoch) & (F.col("log_index") > log_index)))
    first = later.where(F.col("epoch") == epoch).agg(F.min("log_index")).first()[0]
    if first is not None and first > log_index + 1:
        raise LookupError(f"frames {log_index + 1} to {first - 1} of epoch {epoch} are gone")
    if most is None:
        return later
    heads = later.select("epoch", "log_index").distinct().orderBy("epoch", "log_index").limit(most)
    return later.join(heads, ["epoch", "log_index"], "left_semi")


def newest_epoch(log: DataFrame) -> DataFrame:
    """Frames of writers that haven't been fenced off by a later epoch."""
    top = log.agg(F.max("epoch").alias("epoch"))
    return log.join(top, "epoch", "left_semi")


def latest_values(log: DataFrame) -> DataFrame:
    """node_id, prop, value: the last set or removal of each property by (epoch,
    log_index, seq), nodes whose last word is a delete left out."""
    order = F.struct("epoch", "log_index", "seq")
    deaths = log.where(F.col("op") == "delete_node").groupBy("node_id").agg(F.max(order).alias("died"))
    sets = log.where(F.col("op").isin("set_node_prop", "del_node_prop"))
    last = sets.groupBy("node_id", "prop").agg(F.max_by(F.struct("op", "value"), order).alias("v"), F.max(order).alias("at"))
    alive = last.join(deaths, "node_id", "left").where("died is null or at > died")
    return alive.where(F.col("v.op") == "set_node_prop").select("node_id", "prop", "v.value")


def replay(graph: Graph, log: DataFrame) -> Graph:
    """The graph after all operations of the log, in its order. Frames that come twice
    count once."""
    ops = log.dropDuplicates(["epoch", "log_index", "seq"])
    return batch(graph, ops.withColumn("seq", F.struct("epoch", "log_index", "seq")))


def follow(spark: SparkSession, log_path: str, state_path: str, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """Keep a table of property states (node_id, prop, value, position, removed) in step
    with a log folder.

    Each micro-batch merges its frames with the state by position, last writer first, and
    writes the next version of the table, named by the batch; so a batch that runs again
    writes the same, and frames that come again change nothing."""
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_per_batch).parquet(log_path)

    def apply(frames: DataFrame, number: int) -> None:
        position = F.struct("epoch", "log_index", "seq")
        news = frames.where(F.col("op").isin("set_node_prop", "del_node_prop")).select(
            "node_id", "prop", "value", position.alias("position"), (F.col("op") == "del_node_prop").alias("removed")
        )
        old = state(frames.sparkSession, state_path, before=number)
        rows = news if old is None else old.unionByName(news)
        last = rows.groupBy("node_id", "prop").agg(F.max_by(F.struct("value", "position", "removed"), "position").alias("v"))
        last.select("node_id", "prop", "v.value", "v.position", "v.removed").write.mode("overwrite").parquet(f"{state_path}/version={number:012d}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def state(spark: SparkSession, state_path: str, before: int | None = None) -> DataFrame | None:
    """The newest version of the followed table (before a batch number)."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(state_path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(where):
        return None
    numbers = [int(s.getPath().getName().split("=")[1]) for s in files.listStatus(where) if s.getPath().getName().startswith("version=")]
    numbers = [n for n in numbers if before is None or n < before]
    return spark.read.parquet(f"{state_path}/version={max(numbers):012d}") if numbers else None


def caught_up(query: StreamingQuery, timeout: int | None = None) -> bool:
    """Wait until everything in the log so far has been applied."""
    if timeout is None:
        query.processAllAvailable()
        return True
    return bool(query.awaitTermination(timeout))


def lag(log: DataFrame, progress: DataFrame) -> DataFrame:
    """progress: replica, epoch, applied. replica and how many frames it is behind the head of its epoch."""
    head = log.groupBy("epoch").agg(F.max("log_index").alias("head"))
    return progress.join(head, "epoch", "left").select("replica", "epoch", "applied", "head", (F.col("head") - F.col("applied")).alias("lag"))


def retention_floor(head: int, epoch: int, progress: DataFrame, min_entries: int, old_floor: int = 0) -> int:
    """The first frame that must stay: at least min_entries from the head, and what
    every replica of the epoch still needs; it never goes back."""
    needed = progress.where(F.col("epoch") == epoch).agg(F.min(F.col("applied") + 1)).first()[0]
    window = max(0, head - min_entries)
    return max(old_floor, min(window, window if needed is None else needed))


def prunable(segments: DataFrame, floor: int, older_than: int | None = None) -> DataFrame:
    """segments: segment_id, active, end_index, written_at. Sealed ones wholly before the
    floor and, if asked, old enough."""
    rows = segments.where(~F.col("active") & (F.col("end_index") > 0) & (F.col("end_index") < floor))
    return rows if older_than is None else rows.where(F.col("written_at") <= older_than)


def parse_cursor(text: str) -> tuple[int, int]:
    """Epoch and log index of "epoch:log_index"."""
    epoch, index = text.split(":")
    if int(epoch) < 0 or int(index) < 0:
        raise ValueError(f"no position: {text!r}")
    return int(epoch), int(index)


def bootstrap(snapshot: Graph, log: DataFrame, cursor: str, most: int | None = None) -> Graph:
    """A replica from a snapshot taken at the cursor and the frames after it (all of them,
    unless told)."""
    return replay(snapshot, frames_after(log, *parse_cursor(cursor), most))


def next_epoch(log: DataFrame) -> int:
    """The epoch of a promoted writer; frames of earlier ones are fenced off (newest_epoch)."""
    top = log.agg(F.max("epoch")).first()[0]
    return 1 if top is None else top + 1
