"""Sharding by extendible hashing.

A row's hash selects its bucket by leading bits.  Only a bucket beyond the byte limit splits, on one more bit,
until each fits.  The sums of all prefixes come from one histogram of fine prefixes, so that a round looks at
many splits at once; rows of buckets that are still too large at its depth go to the next, deeper round.  The
directory is a table of buckets; it grows with the number of shards.  While it may be broadcast, rows try the depths
that occur; beyond, it is spread out over the fine prefixes that occur, which rows join under salts, so that a
prefix with very many rows is nobody's single task.

A bucket whose rows all have one hash (rows that are repeated, or a single row beyond the limit) cannot split;
its rows are counted off into overflow pages under the limit, one row at least in each.

Defined cases: a null text has no bytes beside the overhead; rows with equal id and text have one hash; a null id is
hashed like any other; an empty table makes no shards.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import shared

SHARD_BYTES = 4 << 20
#: Counted for each row beside its text.
ROW_BYTES = 16
#: Bits beyond the even split that the histogram of a round resolves, and the most bits of a hash.
SLACK_BITS, MOST_BITS = 6, 64


def prefix(depth: int | Column) -> Column:
    """The leading `depth` bits of column hash, as a non-negative integer; depth 0 gives 0."""
    if isinstance(depth, int):
        depth = F.lit(depth)
    return F.when(depth == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", F.col("hash"), (F.lit(64) - depth).cast("int")))


def hashed(docs: DataFrame) -> DataFrame:
    """doc_id, hash, bytes of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(F.col("doc_id").cast("string"), text).alias("hash"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("bytes"))


def _cut(levels: DataFrame, depth: int) -> DataFrame:
    """Fine prefixes of `depth` bits with column depth -> their bucket at that depth."""
    back = F.call_function("shiftrightunsigned", "fine", (F.lit(depth) - F.col("depth")).cast("int"))
    return levels.withColumn("bucket", F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(back))


def histogram(rows: DataFrame, depth: int) -> DataFrame:
    """Sums by fine prefix, with the least and the largest hash."""
    return rows.groupBy(prefix(depth).alias("fine")).agg(F.sum("bytes").alias("sum"), F.min("hash").alias("low"), F.max("hash").alias("high"))


def directory(fine: DataFrame, limit: int, above: int, depth: int) -> DataFrame:
    """Buckets (depth, bucket, shard_bytes, one_hash, stops) of depths above to `depth` that fit or cannot split, or are left to the next round (stops false)."""
    levels = _cut(fine.withColumn("depth", F.explode(F.sequence(F.lit(above), F.lit(depth)))), depth)
    nodes = levels.groupBy("depth", "bucket").agg(F.sum("sum").alias("shard_bytes"), F.min("low").alias("low"), F.max("high").alias("high"))
    nodes = nodes.select("depth", "bucket", "shard_bytes", (F.col("low") == F.col("high")).alias("one_hash")).withColumn("stops", (F.col("shard_bytes") <= limit) | F.col("one_hash"))
    nodes = shared.stored(nodes, "buckets")
    inner = nodes.where("not stops").select((F.col("depth") + 1).alias("depth"), F.col("bucket").alias("parent"))
    children = nodes.withColumn("parent", F.call_function("shiftrightunsigned", "bucket", F.lit(1)))
    child = children.join(inner, ["depth", "parent"], "left_semi").drop("parent")
    return child.unionByName(nodes.where(F.col("depth") == above)).where(F.col("stops") | (F.col("depth") == depth))


def _met(rows: DataFrame, fine: DataFrame, found: DataFrame, depth: int) -> DataFrame:
    """Each row with its bucket."""
    if shared.fits(found, 64):
        depths = sorted(r["depth"] for r in found.select("depth").distinct().collect())  # at most 65 numbers
        tried = rows.withColumn("try", F.explode(F.array(*map(F.lit, depths)))).withColumn("at", prefix(F.col("try")))
        return tried.join(F.broadcast(found), (F.col("try") == F.col("depth")) & (F.col("at") == F.col("bucket")))
    depths = F.array(*(F.lit(d) for d in range(depth + 1)))
    leads = _cut(fine.select("fine", F.explode(depths).alias("depth")), depth).join(found, ["depth", "bucket"])
    return shared.spread_join(rows.withColumn("fine", prefix(depth)), shared.stored(leads, "prefixes"), ["fine"], "salt")


def assign(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """One row per input row: doc_id, bytes, depth, bucket, page, shard (bits of the prefix, then the page), shard_bytes."""
    salts = shared.shuffle_partitions(docs.sparkSession)
    left = shared.stored(hashed(docs).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")), "hashes")
    total = left.agg(F.sum("bytes").alias("n")).first()["n"]
    if total is None:
        return left.select("doc_id", "bytes", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("page"), F.lit("").alias("shard"), F.lit(0).cast("long").alias("shard_bytes"))
    above, out = 0, None
    while True:
        depth = min(MOST_BITS, max(above + 1, ceil(log2(max(1.0, total / limit))) + SLACK_BITS))
        fine = shared.stored(histogram(left, depth), "histogram")
        found = shared.stored(directory(fine, limit, above, depth), "directory")
        met = _met(left, fine, found, depth).select("doc_id", "hash", "bytes", "salt", "depth", "bucket", "shard_bytes", "one_hash", "stops")
        met = shared.stored(met, "assigned")
        done = met.where("stops")
        out = done if out is None else out.unionByName(done)
        rest = met.where("not stops").select("doc_id", "hash", "bytes", "salt")
        if depth == MOST_BITS or rest.isEmpty():
            break
        left, above = rest, depth
        total = limit * 2.0 ** (depth - SLACK_BITS + 8)
    return paged(out, limit).select("doc_id", "bytes", "depth", "bucket", "page", shard_name().alias("shard"), "shard_bytes")


def paged(rows: DataFrame, limit: int) -> DataFrame:
    """Buckets that cannot split are cut into overflow pages; all others are page 0."""
    fits = rows.where(F.col("shard_bytes") <= limit).withColumn("page", F.lit(0).cast("long"))
    over = rows.where(F.col("shard_bytes") > limit)
    over = shared.stored(over, "overflow")
    counts = over.groupBy("depth", "bucket", "salt").agg(F.count("*").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("depth", "bucket").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("ahead", ahead).drop("n")
    nth = F.row_number().over(Window.partitionBy("depth", "bucket", "salt").orderBy("doc_id")) - 1
    room = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col("bytes")))
    over = over.withColumn("nth", nth).join(counts, ["depth", "bucket", "salt"]).withColumn("page", F.floor((F.col("ahead") + F.col("nth")) / room).cast("long"))
    rows_of = F.floor(F.col("shard_bytes") / F.col("bytes"))
    last = F.least(room, rows_of - F.col("page") * room)
    over = over.withColumn("shard_bytes", (last * F.col("bytes")).cast("long"))
    return fits.unionByName(over.select(*fits.columns))


def shard_name() -> Column:
    bits = F.lpad(F.bin(F.col("bucket")), F.col("depth"), F.lit("0"))
    name = F.when(F.col("depth") == 0, F.lit("root")).otherwise(bits)
    return F.when(F.col("page") == 0, name).otherwise(F.concat(name, F.lit("+"), F.col("page").cast("string")))


def write(docs: DataFrame, path: str, limit: int = SHARD_BYTES) -> None:
    """The rows of `docs`, one directory per shard.  docs needs unique ids."""
    shards = assign(docs, limit).select(F.col("doc_id").alias("__id"), "shard")
    docs.join(shards, docs["doc_id"].eqNullSafe(shards["__id"])).drop("__id").repartition("shard").write.partitionBy("shard").parquet(path)
