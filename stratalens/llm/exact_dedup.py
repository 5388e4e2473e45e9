"""Exact duplicates by a log-structured merge index, with DataFrame functions only.

Rows are dealt to memtables by a hash of their id.  Each memtable is flushed as a run: its entries
(digest, id, copies) sorted by digest in one Parquet file with row-group bounds and a bloom filter on the
digest, so that `lookup` skips runs without the digest.  Compaction merges all runs and keeps the
smallest id of each digest.  A row whose digest occurs more than once is a hit: its whole text is compared
with that of the kept row, and texts that only share a digest are grouped again by the text itself.

Defined cases: a null text counts as empty; rows with equal id and text are copies of which one is kept; a
null id sorts after all others (the kept id is null only if a group has no other); an empty table gives no
rows.  Any further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: Rows of one memtable, thus of one run.
MEMTABLE_ROWS = 1_000_000
#: A column that no input has.
ADDED = "__stratalens_digest"


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space.  (A lone space needs no replacement.)"""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


@dataclass
class Index:
    """entries: run, digest, doc_id, copies; heads: run, digest, keep_id, group_size of digests with several rows."""

    entries: DataFrame
    heads: DataFrame
    memtables: int


def keyed(docs: DataFrame, memtables: int, digest: Callable[[Column], Column]) -> DataFrame:
    return docs.select("doc_id", shared.bucket_of("doc_id", memtables).alias("run"), normalised(F.col("text")).alias("norm")).withColumn("digest", digest(F.col("norm")))


def flush(docs: DataFrame, memtables: int, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Sorted runs with filters.  Each run is one task's file, and that task has no other; a hot text is spread over all runs."""
    runs = keyed(docs, memtables, digest).select("run", "digest", "doc_id").repartitionById(memtables, F.col("run"))
    entries = runs.groupBy("run", "digest", "doc_id").agg(F.count("*").alias("copies")).sortWithinPartitions("run", "digest", "doc_id")
    return shared.stored(entries, "runs", **{"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.expected.ndv#digest": str(MEMTABLE_ROWS)})


def compact(entries: DataFrame) -> DataFrame:
    """Merge the runs: digests with several rows, and the smallest id.  A run adds one row per digest at most to the shuffle."""
    merged = entries.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")).where("group_size > 1")
    return entries.select("run", "digest").distinct().join(merged, "digest").select("run", "digest", "keep_id", "group_size")


def build(docs: DataFrame, memtable_rows: int = MEMTABLE_ROWS, digest: Callable[[Column], Column] = sha256) -> Index:
    memtables = max(shared.shuffle_partitions(docs.sparkSession), ceil(docs.count() / memtable_rows))
    entries = flush(docs, memtables, digest)
    return Index(entries, shared.stored(compact(entries), "heads"), memtables)


def lookup(entries: DataFrame, digests: list[bytes]) -> DataFrame:
    """Entries of a few digests; bounds and filters of the runs prune the scan."""
    return entries.where(F.col("digest").isin(*[F.lit(bytearray(x)) for x in digests]))


def verified(docs: DataFrame, index: Index, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Digests under which some text differs from the kept row's text, byte by byte."""
    heads = shared.small(index.heads, 80)
    texts = shared.stored(keyed(docs, index.memtables, digest).join(heads.drop("group_size"), ["run", "digest"]), "hits")
    kept = texts.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.min("norm").alias("kept_norm"))
    kept = index.heads.select("run", "digest").join(kept, "digest")
    return texts.join(kept, ["run", "digest"]).where(~F.col("norm").eqNullSafe(F.col("kept_norm"))).select("digest").distinct()


def groups(docs: DataFrame, memtable_rows: int = MEMTABLE_ROWS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per input row: doc_id, digest, keep_id, group_size, kept."""
    index = build(docs, memtable_rows, digest)
    clashes = shared.stored(verified(docs, index, digest), "clashes")
    plain = index.entries.join(index.heads, ["run", "digest"], "left")
    plain = plain.withColumns({"keep_id": F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")), "group_size": F.coalesce("group_size", "copies")})
    columns = ["doc_id", "digest", "copies", "keep_id", "group_size"]
    if clashes.isEmpty():
        found = plain.select(*columns)
    else:
        apart = keyed(docs, index.memtables, digest).join(clashes, "digest")
        rows = apart.groupBy("run", "digest", "norm", "doc_id").agg(F.count("*").alias("copies"))
        of = rows.groupBy("digest", "norm").agg(F.min("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
        found = plain.join(clashes, "digest", "left_anti").select(*columns).unionByName(shared.spread_join(rows, of, ["digest", "norm"], "run").select(*columns))
    first = F.col("copy") == 1
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("doc_id", "digest", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & first).alias("kept"))


def drop_duplicates(docs: DataFrame, memtable_rows: int = MEMTABLE_ROWS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The rows that stay, with all their columns.  Rows that go are removed by id and digest."""
    index = shared.stored(groups(docs, memtable_rows, digest), "groups")
    gone = shared.stored(index.where("not kept").groupBy("doc_id", "digest").agg(F.count("*").alias("rows")), "gone")
    g, k = gone.alias("g"), index.where("kept").alias("k")
    twice = shared.stored(g.join(k, F.col("g.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("g.digest") == F.col("k.digest")), "left_semi"), "twice")
    named = docs.withColumn(ADDED, digest(normalised(F.col("text"))))

    def on(side: DataFrame):
        return named["doc_id"].eqNullSafe(side["doc_id"]) & (named[ADDED] == side["digest"])

    rest = named.join(shared.small(gone, 64), on(gone), "left_anti")
    once = named.join(shared.small(twice, 64), on(twice), "left_semi").dropDuplicates(["doc_id", ADDED])
    return rest.unionByName(once).drop(ADDED)
