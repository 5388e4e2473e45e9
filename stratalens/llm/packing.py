"""Best-fit packing by minimum bin slack.

Texts become token ids; a document longer than a sequence is cut into full pieces and a rest.  Only the counts
of the piece lengths, at most one per possible length, reach the driver.  There each bin starts with the
longest piece left; bitset subset-sum dynamic programming over the lengths still available finds the fullest
combination beside it, which is removed as often as the counts allow.  The resulting table of patterns, whose
size depends on the capacity alone, is applied to pieces ranked within their length; ranks are counted per
(length, salt), so that a very common length is nobody's single task.

Defined cases: a null or empty text has the end id alone; repeated rows are documents of their own; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import shared, words

CAPACITY = 2048
END_ID = 0

def fullest(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of available lengths with the largest sum up to `room`; longer pieces first among equals.

    lengths: descending.  Bit s of a set is 1 if some choice among the lengths so far has the sum s.
    """
    every = (1 << (room + 1)) - 1
    reach, trail = 1, []
    for length in lengths:
        if length > room or not counts[length]:
            continue
        left, step, before = min(counts[length], room // length), 1, reach
        while left:  # multiplicities in binary, so that each count takes a logarithm of shifts
            step = min(step, left)
            reach |= reach << (length * step) & every
            left -= step
            step *= 2
        if reach != before:
            trail.append((length, before))
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, before in reversed(trail):
        while not before >> total & 1:
            total -= length
            chosen[length] = chosen.get(length, 0) + 1
    return chosen


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Patterns (pieces of each length, number of bins) that use up the histogram."""
    counts = {k: v for k, v in histogram.items() if v > 0}
    out = []
    while counts:
        lengths = sorted(counts, reverse=True)
        seed = lengths[0]
        counts[seed] -= 1
        pattern = fullest(lengths, counts, capacity - seed)
        counts[seed] += 1
        pattern[seed] = pattern.get(seed, 0) + 1
        times = min(counts[k] // n for k, n in pattern.items())
        for k, n in pattern.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
        out.append((pattern, times))
    return out


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every row."""
    with open(path, encoding="utf-8") as file:
        spec = file.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            first = 0
            for ids, bounds in words.tokens(spec).encode(batch.column("text")):
                raw = memoryview(ids).cast("B")
                rows, nth, starts, lengths, sums = [], [], [], [], []
                for i, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist(), strict=False), first):
                    total = b - a + 1  # with the end id
                    for k, at in enumerate(range(0, total, capacity)):
                        length = min(capacity, total - at)
                        last = at + length == total
                        value = crc32(raw[4 * (a + at) : 4 * (a + at + length - last)])
                        rows.append(i)
                        nth.append(k)
                        starts.append(at)
                        lengths.append(length)
                        sums.append(crc32(end, value) if last else value)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(nth, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )
                first += len(bounds) - 1

    rows = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with their sequence_id and offset."""
    spark = docs.sparkSession
    salt = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shared.shuffle_partitions(spark))).cast("int")
    rows = shared.stored(pieces(docs, path, capacity).withColumn("salt", salt), "pieces")
    counted = shared.stored(rows.groupBy("length", "salt").agg(F.count("*").alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row per length: at most `capacity`
    used: dict[int, int] = {}
    table, first = [], 0
    for pattern, times in plan(histogram, capacity):
        offset = 0
        for length, n in sorted(pattern.items(), reverse=True):
            low = used.get(length, 0)
            used[length] = low + n * times
            table.append((length, low, low + n * times, first, n, offset))
            offset += n * length
        first += times
    patterns = spark.createDataFrame(table, "p_length long, low long, high long, first long, n long, base long")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    nth = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = rows.withColumn("nth", nth).join(starts, ["length", "salt"]).withColumn("rank", F.col("ahead") + F.col("nth"))
    placed = ranked.join(F.broadcast(patterns), (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))  # bounded by the capacity
    at = F.col("rank") - F.col("low")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.floor(at / F.col("n")).cast("long")).alias("sequence_id"), (F.col("base") + at % F.col("n") * F.col("length")).alias("offset"))
