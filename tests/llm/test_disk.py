"""What steps leave on disk."""

import time

from pyspark.sql import functions as F

from loomgraph.llm.common import release, written


def shuffle_files(spark) -> int:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return files.mkString("\n").count("/shuffle_")


def test_written_tables_leave_no_shuffle_files(spark):
    before = shuffle_files(spark)
    kept = [written(spark.range(10_000).groupBy((F.col("id") % 1000).alias("k")).count(), "disk") for _ in range(3)]
    end = time.time() + 10
    while shuffle_files(spark) > before and time.time() < end:
        time.sleep(0.1)
    assert shuffle_files(spark) <= before and all(t.agg(F.sum("count")).first()[0] == 10_000 for t in kept)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None
    release(*kept)
