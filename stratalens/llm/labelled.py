"""Bounded samples of labelled texts, and the split into training and held-out rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: A text beyond this is scored but never learned from.
MAX_TEXT_BYTES = 1 << 20
#: All texts of one class that a fit takes.
MAX_CLASS_BYTES = 24 << 20


def remainder(modulus: int) -> Column:
    """crc32 of the id's text modulo `modulus`; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def held_out(modulus: int, value: int) -> Column:
    return F.coalesce(remainder(modulus) == value, F.lit(False))


def per_document(labels: DataFrame, label: str) -> DataFrame:
    """doc_id, y: one label a document; of several the largest counts, a null label or id none."""
    return labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))


def sample(docs: DataFrame, chosen: dict[str, tuple[DataFrame, int]]) -> dict[str, list[str]]:
    """Texts of at most so many documents of each class, by ascending hash of their ids.

    chosen: class -> (table with doc_id, most documents).  Repeated rows of one id count once (least text).
    """
    picks = None
    for name, (ids, most) in chosen.items():
        pick = shared.lowest(ids.select("doc_id", F.xxhash64("doc_id").alias("order")), "order", most, "doc_id").select("doc_id", "order", F.lit(name).alias("part"))
        picks = pick if picks is None else picks.unionByName(pick)
    picks = F.broadcast(shared.stored(picks, "picks"))  # bounded by the numbers above
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.octet_length("text") <= MAX_TEXT_BYTES)
    found = texts.join(picks, "doc_id").groupBy("part", "order", "doc_id").agg(F.min("text").alias("text"))
    found = shared.stored(found.withColumn("size", F.octet_length("text").cast("long")), "sample")
    out = {}
    for name in chosen:
        part = found.where(F.col("part") == name)
        sizes = sorted((r["order"], r["doc_id"], r["size"]) for r in part.select("order", "doc_id", "size").collect())
        total = np.cumsum([x[2] for x in sizes])
        kept = int((total <= MAX_CLASS_BYTES).sum())
        if kept == 0:
            out[name] = []
            continue
        last = sizes[kept - 1][:2]
        found_rows = part.where((F.col("order") < last[0]) | ((F.col("order") == last[0]) & (F.col("doc_id") <= last[1]))).orderBy("order", "doc_id").select("text")
        out[name] = [r["text"] for r in found_rows.toLocalIterator()]
    return out
