"""Work tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """spark.checkpoint.dir.  Where that is unset, a temporary folder if all tasks run in this process' JVM (tests), else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="stratalens-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    own = f"{root(spark)}/stratalens/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(own)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return own


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a written table, so that lineage ends there and nothing is lost with an executor; deleted when the driver's JVM ends."""
    own = path(df.sparkSession, name)
    df.write.parquet(own)
    return df.sparkSession.read.schema(df.schema).parquet(own)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by their keys over as many tasks as the cluster runs: a small file is one task, whatever its rows cost later."""
    return df.repartition(most_tasks(df.sparkSession), *keys)


def most_tasks(spark: SparkSession, least: int = 0) -> int:
    """As many tasks as the cluster runs, or `least`, if that is more."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, least)


#: Rows of a task that groups or joins them in memory.
TASK_ROWS = 1 << 20


def tasks(df: DataFrame) -> int:
    """As many tasks as the cluster runs, more where they would hold more than TASK_ROWS of the counted rows."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // TASK_ROWS))
