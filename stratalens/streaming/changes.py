"""Extension: change detection over a stream of snapshots of files."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import diff


def statuses(stream: DataFrame, key: str = "path", digest: str = "content_hash") -> DataFrame:
    """key, digest, status (added or modified) of each row that differs from the last seen of its key."""

    def run(keys: tuple, parts, state: GroupState):
        last = state.get[0] if state.exists else None
        out = []
        for pdf in parts:
            for value in pdf[digest]:
                if value != last:
                    out.append((keys[0], value, "added" if last is None else "modified"))
                    last = value
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=[key, digest, "status"])

    schema = f"{key} string, {digest} string, status string"
    return stream.groupBy(key).applyInPandasWithState(run, schema, "last string", "append", GroupStateTimeout.NoTimeout)


def newest_version(spark: SparkSession, path: str, before: int) -> int | None:
    """The number of the newest complete version under `path` that is older than `before`."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    names = [x.getPath().getName() for x in fs.listStatus(root)]
    numbers = [int(x[1:]) for x in names if re.fullmatch(r"v\d+", x) and fs.exists(hadoop.Path(f"{path}/{x}/_SUCCESS"))]
    return max((n for n in numbers if n < before), default=None)


def upsert_to(path: str, key: str, order: tuple[str, ...] = ()):
    """A foreachBatch sink that keeps one row per key in versioned Parquet folders under `path`.

    Of a batch's rows of one key the greatest by `order`, then by the other columns, stays.  A batch starts from the newest
    complete version older than itself and overwrites its own, so a repeated or interrupted batch gives the same version.
    """

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rest = [*order, *(c for c in batch.columns if c not in (key, *order))]
        best = batch.groupBy(key).agg(F.max(F.struct(*rest)).alias("best")) if rest else batch.select(key).distinct()
        latest = best.select(*(F.col(key) if c == key else F.col(f"best.{c}").alias(c) for c in batch.columns))
        if (last := newest_version(spark, path, number)) is not None:
            latest = diff.upsert(spark.read.parquet(f"{path}/v{last}"), latest, key)
        latest.write.mode("overwrite").parquet(f"{path}/v{number}")

    return sink
