"""What the operators of this subpackage share: places to write to, settings, columns."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space in the contracts: blank and the control characters 9 to 13.
SPACE = " \t\n\x0b\f\r"
WORD = "[^\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows go to Python in batches of at most so many bytes, whatever their length.
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches, make sure of a checkpoint folder, send this package
    to the executors. Cheap when it has been done for this session before."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    context = spark.sparkContext
    if getattr(context, "_loomgraph_sent", False):
        return
    if not spark.conf.get("spark.checkpoint.dir", None) and context._jsc.sc().getCheckpointDir().isEmpty():
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="loomgraph-"))
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="loomgraph-"), "loomgraph_code.zip")
    with zipfile.ZipFile(target, "w") as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(target)
    context._loomgraph_sent = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where it is
    set, else the one prepare() chose (local sessions only)."""
    prepare(spark)
    base = spark.conf.get("spark.checkpoint.dir", None)
    return base.rstrip("/") if base else spark.sparkContext._jsc.sc().getCheckpointDir().get()


#: What the current operator remembers in this worker.
_held: list = []


def hold(*memories) -> None:
    """Called by a task before it uses what a worker remembers between tasks (dicts
    of words and the like): whatever another operator left there is let go, so a worker
    never holds the memories of several."""
    if [id(m) for m in memories] != [id(m) for m in _held]:
        for m in _held:
            m.clear()
        _held[:] = memories
        trim()


def let_go() -> None:
    """Forget what is held: called when a task is through, since the worker stays while
    other stages need the executor's memory. A task fills its memory anew more than once."""
    for m in _held:
        m.clear()
    trim()


def trim() -> None:
    """Give freed memory back to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries lack it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


_written: list[tuple[SparkSession, str]] = []


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/loomgraph-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before
            continue


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """What is executed within gives its shuffle files back when it is through. Else they stay
    until the driver's JVM collects its own garbage, which comes no sooner for larger files."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df as a table in the shared folder (in folders by the columns `by`): cuts the
    lineage, survives lost executors. release() removes it before the driver ends."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    with tidy(spark):
        (df.write.partitionBy(*by) if by else df.write).parquet(path, compression="zstd")
    out = spark.read.schema(df.schema).parquet(path)
    out._loomgraph_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove tables that written() made, once nothing reads them any more."""
    for t in tables:
        path = t.__dict__.pop("_loomgraph_path", None)
        if path:
            remove(t.sparkSession, path)
            _written.remove((t.sparkSession, path))


def spare(columns, *wanted: str) -> list[str]:
    """The wanted names, with underscores until none is like one of the columns."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def carried(df: DataFrame, made) -> list[str]:
    """Columns of df that go on beside the made ones; a made column replaces its namesake."""
    taken = {m.lower() for m in made}
    return [c for c in df.columns if c.lower() not in taken]


def quoted(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def row_key(df: DataFrame, columns=None) -> list:
    """Two 64-bit hashes of a row (of all columns, unless told). Rows that are alike share them."""
    columns = [quoted(c) for c in (columns or df.columns)]
    seen = [c.isNull() for c in columns]
    return [F.xxhash64(F.lit(seed), *columns, *seen) for seed in (11, 12)]
