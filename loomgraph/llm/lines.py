"""Line dedup: a levelled store of sorted runs of line hashes, and dropping by it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, SPACE, UPPER, carried, fresh_dir, prepare, quoted, release, remove, row_key, spare, written

KEYS = ["h1", "h2"]
#: Rows of a run's bucket, on average (about 24 MB); Spark's own bound on buckets.
ROWS_BUCKET, MOST_BUCKETS = 1 << 20, 100_000


def line_key(line):
    """The line without white space at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def text_lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def hashed(key):
    return [F.xxhash64(F.lit(21), key).alias("h1"), F.xxhash64(F.lit(22), key).alias("h2")]


class LineRuns:
    """Counts by line hash, as levelled runs of (h1, h2, n) sorted by hash.

    add() merge-anti-joins a batch with the keys already decided (seen in min_docs
    documents or more) and adds the rest as a run of level 0. As soon as a level has
    `fanout` runs, they are merged: keys that reach min_docs move to the decided
    runs, the others become one run of the next level. A run is a table bucketed and
    sorted by hash, so a merge join of runs neither shuffles nor sorts them again.
    All runs lie in the shared folder; a lost executor costs only its tasks."""

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 3, buckets: int | None = None):
        prepare(spark)
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name, self.made = f"lines_{uuid.uuid4().hex[:12]}", 0
        self.levels: list[list[str]] = [[]]
        self.decided: list[str] = []
        self.paths: dict[str, str] = {}

    def _run(self, counts: DataFrame) -> str:
        self.made += 1
        table = f"{self.name}_{self.made}"
        self.paths[table] = fresh_dir(self.spark, "run")
        (
            counts.select(*KEYS, "n")
            .repartition(self.buckets, *KEYS)
            .sortWithinPartitions(*KEYS)
            .write.bucketBy(self.buckets, *KEYS)
            .sortBy(*KEYS)
            .option("path", self.paths[table])
            .saveAsTable(table)
        )
        return table

    def _union(self, tables: list[str]) -> DataFrame:
        """Rows of several runs, read as plain files: a union of bucketed tables claims to be
        dealt by key, which it isn't where the planner reads the buckets as plain files."""
        frames = [self.spark.read.schema("h1 long, h2 long, n long").parquet(self.paths[t]) for t in tables]
        whole = frames[0]
        for f in frames[1:]:
            whole = whole.unionByName(f)
        return whole

    def add(self, counts: DataFrame) -> None:
        """counts: h1, h2 and in n the number of documents of this batch that hold the line."""
        for table in self.decided:
            counts = counts.join(self.spark.table(table), KEYS, "left_anti")
        self.levels[0].append(self._run(counts))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self._compact(level)
            level += 1

    def _compact(self, level: int) -> None:
        runs = self.levels[level]
        merged = written(self._union(runs).groupBy(*KEYS).agg(F.sum("n").alias("n")), "merge")
        self.decided.append(self._run(merged.where(F.col("n") >= self.min_docs)))
        if len(self.levels) == level + 1:
            self.levels.append([])
        self.levels[level + 1].append(self._run(merged.where(F.col("n") < self.min_docs)))
        self.levels[level] = []
        release(merged)
        self._drop(runs)

    def _drop(self, tables: list[str]) -> None:
        for table in tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            remove(self.spark, self.paths.pop(table))

    def drop(self) -> None:
        """Take all runs out of the catalog and the shared folder."""
        self._drop(list(self.paths))
        self.levels, self.decided = [[]], []

    def heavy(self) -> DataFrame:
        """h1, h2 of every line found in min_docs documents or more."""
        parts = [self.spark.table(t).select(*KEYS) for t in self.decided]
        if open_runs := [t for runs in self.levels for t in runs]:
            counts = self._union(open_runs).groupBy(*KEYS).agg(F.sum("n").alias("n"))
            parts.append(counts.where(F.col("n") >= self.min_docs).select(*KEYS))
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        return whole


def drop_common_lines(
    docs: DataFrame, text: str = "text", min_docs: int = 10, batches: int = 4, made: tuple[str, str, str] = ("n_lines", "n_dropped", "kept_text")
) -> DataFrame:
    """Drop the lines that min_docs or more documents hold.

    A row is a document; its lines are the parts of the text between \\n (null or
    empty: one empty line). Lines are alike if their keys are (see line_key); lines
    with an empty key always stay. Returns the columns of docs and (named by `made`)
    n_lines, n_dropped and kept_text (the other lines joined by \\n); input columns of these
    names give way, any others may be there. Repeated rows count as documents each and
    get the same result, rows with a null id like any other; lines that differ in nothing
    but their key's white space and case are ties and go or stay together; an empty table
    gives an empty table; text length is not bounded.

    The documents arrive in `batches` parts by a hash of the row, each added to
    LineRuns once. Then every line meets the heavy keys in a plain equi-join, which
    adaptive execution splits where one line is very frequent; only hashes travel."""
    spark = docs.sparkSession
    prepare(spark)
    k1, k2 = row_key(docs)
    a, b, marks_, kept_ = spare(docs.columns, "__k1", "__k2", "__marks", "__kept")
    keyed = docs.select(k1.alias("k1"), k2.alias("k2"), text_lines(quoted(text)).alias("lines"))

    # One pass over the texts: for each batch (by the row's hash) and key, the number of
    # the batch's documents that hold it.
    counts = (
        keyed.select(
            F.pmod("k2", F.lit(batches)).cast("int").alias("batch"),
            F.explode(F.array_distinct(F.transform("lines", line_key))).alias("key"),
        )
        .where("key != ''")
        .select("batch", *hashed(F.col("key")))
        .groupBy("batch", *KEYS)
        .agg(F.count("*").alias("n"))
    )
    counts = written(counts, "line-counts", "batch")  # each batch reads its own files only
    # As many buckets as the rows need: a file for each of many small ones costs more than its rows.
    runs = LineRuns(spark, min_docs, buckets=min(MOST_BUCKETS, 1 + counts.count() // ROWS_BUCKET))
    for n in range(batches):
        runs.add(counts.where(F.col("batch") == n))
    heavy = written(runs.heavy(), "line-heavy").withColumn("heavy", F.lit(True))
    runs.drop()
    release(counts)

    # A line with an empty key gets a hash of its own place, which no run holds.
    lines = keyed.select("k1", "k2", F.posexplode(F.transform("lines", line_key)).alias("pos", "key")).select(
        "k1",
        "k2",
        "pos",
        F.when(F.col("key") == "", F.xxhash64("k1", "pos")).otherwise(F.xxhash64(F.lit(21), "key")).alias("h1"),
        F.when(F.col("key") == "", F.col("k2")).otherwise(F.xxhash64(F.lit(22), "key")).alias("h2"),
    )
    marks = (
        lines.join(heavy, KEYS, "left")
        .select(F.col("k1").alias(a), F.col("k2").alias(b), F.struct("pos", F.col("heavy").isNotNull().alias("drop")).alias("mark"))
        .groupBy(a, b)
        .agg(F.sort_array(F.collect_set("mark")).alias(marks_))
    )
    rows = docs.select("*", k1.alias(a), k2.alias(b)).join(marks, [a, b])
    all_lines = text_lines(quoted(text))
    kept = F.filter(all_lines, lambda line, i: ~F.element_at(F.col(marks_), i + 1)["drop"])
    return (
        rows.withColumn(kept_, kept)
        .select(
            *[quoted(c) for c in carried(docs, made)],
            F.size(all_lines).cast("long").alias(made[0]),
            (F.size(all_lines) - F.size(kept_)).cast("long").alias(made[1]),
            F.array_join(kept_, "\n").alias(made[2]),
        )
    )
