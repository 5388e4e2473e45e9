"""A content-addressed cache for what a provider makes of texts: embeddings, answers.

Values are kept under the SHA-256 of their text, in segments that are only appended, so that writers do not meet; each use
is noted the same way.  A read takes the newest value of a text.  Eviction keeps the texts used last.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import work

#: Texts in one call of the provider, at most.
MOST_BATCH = 20


class ContentCache:
    """root: a folder that all machines see; kind: the SQL type of a value."""

    def __init__(self, spark: SparkSession, root: str, kind: str = "array<double>") -> None:
        self.spark, self.root, self.kind = spark, root.rstrip("/"), kind

    def _segments(self, part: str) -> list[str]:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        path = hadoop(f"{self.root}/{part}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(p.toString() for p in found if fs.exists(hadoop(p, "_SUCCESS")))

    def _append(self, part: str, rows: DataFrame) -> str:
        path = f"{self.root}/{part}/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return path

    def _all(self, part: str, schema: str) -> DataFrame:
        found = self._segments(part)
        return self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        """sha, value, created: the newest value of each text."""
        rows = self._all("values", f"sha string, value {self.kind}, created timestamp")
        return rows.groupBy("sha").agg(F.max_by("value", "created").alias("value"), F.max("created").alias("created"))

    def through(self, items: DataFrame, key: str, text: str, provider: Callable[[list[str]], list[Any]], batch: int = MOST_BATCH) -> DataFrame:
        """key, value, cached, error of each row of items whose text is not empty: what is known from the cache, the rest from the provider.

        Each distinct new text goes to the provider once, in batches of at most 20; if a batch fails, its texts go one by one, and
        those that fail alone keep their rows, without a value and with the error.  New values are appended, uses noted.
        """
        rows = items.where(F.length(F.trim(text)) > 0).select(key, F.sha2(text, 256).alias("sha"), F.col(text).alias("text"))
        known = work.stored(self.read().join(rows.select("sha").distinct(), "sha", "left_semi").select("sha", "value"), "known")
        new = rows.join(known.select("sha"), "sha", "left_anti").groupBy("sha").agg(F.first("text").alias("text"))
        size = max(1, min(batch, MOST_BATCH))

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            def one(value: str) -> tuple[Any, str | None]:
                try:
                    return provider([value])[0], None
                except Exception as e:  # whatever a provider raises is told in the row
                    return None, f"{type(e).__name__}: {e}"

            for pdf in parts:
                for at in range(0, len(pdf), size):
                    part = pdf.iloc[at : at + size]
                    texts = part["text"].tolist()
                    try:
                        values = list(provider(texts))
                        if len(values) != len(texts):
                            raise ValueError(f"{len(values)} values for {len(texts)} texts")
                        found = [(v, None) for v in values]
                    except Exception:
                        found = [one(x) for x in texts]
                    yield pd.DataFrame({"sha": part["sha"].tolist(), "value": pd.Series([v for v, _ in found], dtype=object), "error": pd.Series([e for _, e in found], dtype=object)})

        made = work.stored(new.mapInPandas(run, f"sha string, value {self.kind}, error string"), "made")  # the provider is asked once
        fresh = made.where("error IS NULL")
        if not fresh.isEmpty():
            self._append("values", fresh.select("sha", "value", F.current_timestamp().alias("created")))
        if not known.isEmpty():
            self._append("uses", known.select("sha", F.current_timestamp().alias("used")))
        both = known.select("sha", "value", F.lit(True).alias("cached"), F.lit(None).cast("string").alias("error")).unionByName(made.select("sha", "value", F.lit(False).alias("cached"), "error"))
        return rows.join(both, "sha").select(key, "value", "cached", "error")

    def evict(self, most: int = 500) -> DataFrame:
        """The entries that stay: the `most` used last (made last, if never used), ties to the smaller sha; all others are deleted."""
        old = self._segments("values"), self._segments("uses")
        uses = self._all("uses", "sha string, used timestamp").groupBy("sha").agg(F.max("used").alias("used"))
        kept = self.read().join(uses, "sha", "left").withColumn("last", F.greatest("created", "used")).orderBy(F.desc("last"), "sha").limit(most)
        kept = work.stored(kept, "kept")
        self._append("values", kept.select("sha", "value", "created"))
        self._append("uses", kept.where("used IS NOT NULL").select("sha", "used"))
        for path in (p for part in old for p in part):
            hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        return self.read()
