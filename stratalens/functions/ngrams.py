"""Runs of words counted within chunks of texts, before anything is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import work

#: Bytes of the texts that are counted together; a longer text goes alone.
CHUNK_BYTES = 8 << 20
IN_WORD = np.zeros(256, bool)
IN_WORD[list(b"abcdefghijklmnopqrstuvwxyz0123456789_")] = True


def counts(df: DataFrame, text: Column, id_column: str, n: int = 1, least: int = 1) -> DataFrame:
    """term, occurrences, documents (distinct ids) of the runs of n words within a text, as `text.word_list` takes words of `least` characters.

    Runs are counted in chunks of texts, so a task shuffles each of its terms once.  Only where several rows have one id are runs
    kept by id until these rows have met.
    """
    ids = work.stored(df.groupBy(F.col(id_column).alias("id")).agg(F.count("*").alias("n")).where("n > 1 AND id IS NOT NULL").select("id", F.lit(True).alias("again")), "ids")
    rows = df.select(F.col(id_column).alias("id"), F.lower(text).alias("text")).where("text IS NOT NULL")
    unique = ids.isEmpty()
    rows = rows.withColumn("again", F.lit(False)) if unique else rows.join(ids, "id", "left")
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                yield from counted(part, n, least)

    found = rows.mapInArrow(run, f"term string, id {kind}, n long, documents long")
    if not unique:
        found = found.groupBy("term", "id").agg(F.sum("n").alias("n"), F.when(F.col("id").isNull(), F.sum("documents")).otherwise(1).alias("documents"))
    return found.groupBy("term").agg(F.sum("n").alias("occurrences"), F.sum("documents").alias("documents"))


def chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    ends, at = np.cumsum(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK_BYTES, "right")))
        yield batch.slice(at, to - at)
        at = to


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of lower-case texts and the row of each."""
    texts = texts.cast(pa.large_string())
    _, bounds, data = texts.buffers()
    bounds = np.frombuffer(bounds, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    inside = IN_WORD[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = bounds[:-1][bounds[:-1] < len(raw)]
    first[heads] = inside[heads]  # no word goes on in the next text
    before = np.concatenate([[0], np.cumsum(first)])
    held = raw[inside]
    starts = np.append(np.flatnonzero(first[inside]), len(held)).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(held))
    return words, np.repeat(np.arange(len(texts)), np.diff(before[bounds]))


def counted(batch: pa.RecordBatch, n: int, least: int) -> Iterator[pa.RecordBatch]:
    """term, id, n, documents of one chunk; id is null but for rows whose id comes again."""
    words, row = split(batch["text"])
    if least > 1:
        long = pc.binary_length(words).to_numpy() >= least
        words, row = words.filter(pa.array(long)), row[long]
    if len(words) < n:
        return
    words = words.dictionary_encode()
    codes, width = words.indices.to_numpy().astype(np.int64), len(words.dictionary)
    size = len(codes) - n + 1
    run = codes[:size]
    for k in range(1, n):
        run = pd.factorize(run * width + codes[k : k + size])[0]
    at = np.flatnonzero(row[:size] == row[n - 1 :])
    term, row = pd.factorize(run[at])[0], row[at]
    if not len(term):
        return
    place = np.empty(term.max() + 1, np.int64)
    place[term[::-1]] = at[::-1]
    each = [words.dictionary.take(pa.array(codes[place + k])) for k in range(n)]
    terms = (each[0] if n == 1 else pc.binary_join_element_wise(*each, pa.scalar(" ", pa.large_string()))).cast(pa.string())
    again, ids = pc.fill_null(batch["again"], False).to_numpy(zero_copy_only=False), batch["id"]
    once, rows = ~again[row], len(batch)

    def out(of: np.ndarray, ids: pa.Array, n: np.ndarray, documents: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([terms.take(pa.array(of)), ids, pa.array(n.astype(np.int64)), pa.array(documents.astype(np.int64))], ["term", "id", "n", "documents"])

    if once.any():
        named = ids.is_valid().to_numpy(zero_copy_only=False)[row]
        times = np.bincount(term[once], minlength=len(terms))
        held = np.bincount(pd.unique(term[once & named] * rows + row[once & named]) // rows, minlength=len(terms))
        of = np.flatnonzero(times)
        yield out(of, pa.nulls(len(of), ids.type), times[of], held[of])
    if not once.all():
        place, pairs = pd.factorize(term[~once] * rows + row[~once])
        times = np.bincount(place)
        yield out(pairs // rows, ids.take(pa.array(pairs % rows)), times, np.ones(len(times)))
