"""Work tables in the folder that driver and executors share, and joins that bear hot keys."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its measured size is at most this many bytes.
BROADCAST_BYTES = 32 << 20


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir.  Where that is unset, a temporary one if all tasks run in this process' JVM (tests), else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="stratalens-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path for one work table; it is deleted when the driver's JVM ends."""
    path = f"{checkpoint_root(spark)}/stratalens/{name}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a work table as Parquet and read it back: cuts the lineage, survives lost executors."""
    path = work_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def fits(df: DataFrame, row_bytes: int) -> bool:
    """Whether a stored table, by its counted rows, may be broadcast."""
    return df.count() * row_bytes <= BROADCAST_BYTES


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """Mark a stored table for broadcast if it fits; else leave it to a shuffle join."""
    return F.broadcast(df) if fits(df, row_bytes) else df


def bucket_of(column: str, buckets: int) -> Column:
    """A deterministic bucket for a row id; equal ids (nulls too) share one."""
    return F.pmod(F.xxhash64(F.col(column)), F.lit(buckets)).cast("int")


def spread_join(rows: DataFrame, dim: DataFrame, keys: list[str], salt: str) -> DataFrame:
    """Left join of `rows` to `dim` (one row per key) where a key may hold a third of all rows.

    `dim` is first joined to the (key, salt) pairs that occur, so that a key reaches as many tasks as
    it has salts, and a key with one row costs one row.
    """
    present = rows.select(*keys, salt).distinct()
    wide = present.join(dim, keys)
    return rows.join(wide, [*keys, salt], "left")


def lowest(rows: DataFrame, order: str, most: int, *ties: str) -> DataFrame:
    """The `most` rows with the lowest `order` (a 64-bit hash).

    Rows beyond the share that can be among them go before the sort, so that a task sends its share of the sample
    and not as many rows as the sample has.  (Ten deviations of slack; a sample that misses is a little smaller.)
    """
    share = (most + 10 * most**0.5) / max(1, rows.count())
    if share < 1:
        rows = rows.where(F.col(order) < int(share * 2**64) - 2**63)
    return rows.orderBy(order, *ties).limit(most)
