"""SimHash near duplicates: fingerprints, pigeonhole blocks, verified Hamming distance, components.

A fingerprint is cut into m blocks.  Two fingerprints with d differing bits agree on m - d blocks at least,
so every choice of m - d blocks is a key and any close pair shares one.  m follows from the number of
fingerprints, so that a key holds few that are not close; any m finds all pairs.  A bucket is searched from
its members outward and gives a spanning forest of its links, never all its pairs; a bucket beyond
BUCKET_ROWS is cut into tiles, and every pair of its members meets in one of them.

Defined cases: a null or wordless text has fingerprint zero and is linked like any other; fewer words than a
shingle make one shingle; rows with equal ids are rows of their own; a null id never is the smallest unless
its group has no other (then the component id is null); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb, log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .components import components

SHINGLE = 4
DISTANCE = 4
SEED = 42
#: Members of a bucket that one search takes.
BUCKET_ROWS = 4096
#: Shingles that are counted at once.
CHUNK = 1 << 16


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Majority bits of the XXH64 of all word shingles, as a signed 64-bit integer."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    total = max(1, len(words) - size + 1)
    ends = ends[size - 1 :] if len(words) >= size else ends[-1:]
    ones = np.zeros(64, np.int64)
    for at in range(0, total, CHUNK):
        spans = zip(starts[at : min(at + CHUNK, total)].tolist(), ends[at : at + CHUNK].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, fp (signed 64-bit) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(x.as_py(), size) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def block_masks(fingerprints: int, distance: int = DISTANCE) -> list[int]:
    """One mask per choice of blocks: the fewest blocks whose keys hold 2 bits more than the fingerprints need."""
    need = min(56.0, log2(max(2, fingerprints)) + 2)
    m = distance + 1
    while 64 * (m - distance) / m < need and comb(m + 1, distance) <= 1001:
        m += 1
    edges = [64 * i // m for i in range(m + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(x) - (sum(x) >> 63 << 64) for x in combinations(blocks, m - distance)]


def forest(fps: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Links that connect what lies within the distance, one less than members per group."""
    fps = fps.view(np.uint64)
    left, out = fps[1:], []
    queue = [fps[0]] if len(fps) else []
    while queue:
        at = queue.pop()
        near = np.bitwise_count(left ^ at) <= distance
        if near.any():
            found = left[near]
            out += [(int(at.astype(np.int64)), int(x)) for x in found.view(np.int64)]
            queue += list(found)
            left = left[~near]
        if not queue and len(left):
            queue, left = [left[0]], left[1:]
        if not len(left):
            break
    return out


def links(fps: DataFrame, distance: int = DISTANCE, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """fps: distinct values in column fp.  Returns links a, b that connect all within the distance."""
    masks = block_masks(fps.count(), distance)
    keys = F.explode(F.array(*[F.struct(F.lit(i).cast("short").alias("c"), F.col("fp").bitwiseAND(F.lit(x)).alias("key")) for i, x in enumerate(masks)]))
    keyed = fps.select("fp", keys.alias("k")).select("fp", "k.c", "k.key")
    sizes = keyed.groupBy("c", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = keyed.join(shared.stored(sizes, "buckets"), ["c", "key"])
    tiles = F.ceil(F.col("n") / bucket_rows).cast("int")
    own = F.pmod(F.xxhash64("fp"), tiles).cast("int")
    met = met.withColumn("own", own).withColumn("other", F.explode(F.when(tiles == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), tiles - 1))))
    met = met.select("c", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, name = [], None

        def close() -> pa.RecordBatch | None:
            found = forest(np.unique(np.concatenate(held)), distance) if held else []
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"]) if found else None

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(x).to_numpy(zero_copy_only=False) for x in ("c", "key", "i", "j")]
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.any([x[1:] != x[:-1] for x in cols], axis=0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fp)], strict=True):
                this = tuple(int(x[a]) for x in cols)
                if this != name:
                    if (out := close()) is not None:
                        yield out
                    held, name = [], this
                held.append(fp[a:b])
        if (out := close()) is not None:
            yield out

    dealt = met.repartition(shared.shuffle_partitions(fps.sparkSession), "c", "key", "i", "j").sortWithinPartitions("c", "key", "i", "j")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _grouped(docs: DataFrame, distance: int, size: int, bucket_rows: int) -> DataFrame:
    """One row per input row: doc_id, fp, component_id, and the fingerprint of the component's row that stays (smallest id, then fingerprint)."""
    spark = docs.sparkSession
    salts = shared.shuffle_partitions(spark)
    rows = shared.stored(fingerprints(docs, size).withColumn("salt", shared.bucket_of("doc_id", salts)), "fingerprints")
    heads = shared.stored(rows.groupBy("fp").agg(F.min("doc_id").alias("head")), "heads")
    found = components(links(heads.select("fp"), distance, bucket_rows))
    found = shared.stored(found.join(heads, found["node"] == heads["fp"]).select("fp", "root", "head"), "members")
    least = found.groupBy("root").agg(F.min(F.struct(F.col("head").isNull().alias("none"), "head", F.col("fp").alias("keep_fp"))).alias("least"))
    linked = found.join(least, "root").select("fp", "least")
    named = heads.join(linked, "fp", "left").select("fp", F.coalesce("least.head", "head").alias("component_id"), F.coalesce("least.keep_fp", "fp").alias("keep_fp"))
    return shared.spread_join(rows, shared.stored(named, "named"), ["fp"], "salt").select("doc_id", "fp", "component_id", "keep_fp")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, size: int = SHINGLE, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per input row: doc_id, fp, component_id."""
    return _grouped(docs, distance, size, bucket_rows).drop("keep_fp")


def drop_near_duplicates(docs: DataFrame, distance: int = DISTANCE, size: int = SHINGLE, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row of each component stays: that with the smallest id, then the smallest fingerprint (a null id only if all are null).

    Rows are told apart by id and fingerprint.  Only ids with several rows, some of which stay, need their fingerprints again.
    """
    found = _grouped(docs, distance, size, bucket_rows)
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("fp") == F.col("keep_fp"))
    found = shared.stored(found.select("doc_id", "fp", stays.alias("stays")), "components")
    ids = found.groupBy("doc_id").agg(F.count("*").alias("rows"), F.count_if("stays").alias("kept")).where("kept = 0 OR rows > 1")
    ids = shared.stored(ids.select(F.col("doc_id").alias("_id"), (F.col("kept") > 0).alias("_mixed")), "gone")
    rest = docs.join(shared.small(ids, 24), docs["doc_id"].eqNullSafe(ids["_id"]), "left_anti")
    mixed = ids.where("_mixed")
    if mixed.isEmpty():
        return rest

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: fingerprint(t, size)).astype("int64")

    name = "__stratalens_fp"  # a column that no input has
    some = docs.join(shared.small(mixed, 24), docs["doc_id"].eqNullSafe(mixed["_id"]), "left_semi").withColumn(name, of(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    kept = found.where("stays").join(shared.small(mixed, 24), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select(F.col("doc_id").alias("_id"), F.col("fp").alias("_fp")).distinct()
    kept = shared.stored(kept, "kept")
    some = some.join(shared.small(kept, 32), some["doc_id"].eqNullSafe(kept["_id"]) & (some[name] == kept["_fp"]), "left_semi")
    return rest.unionByName(some.dropDuplicates(["doc_id", name]).drop(name))
