"""Toxicity by non-negative positive-unlabelled learning.

A linear model over word features is trained in numpy from confirmed toxic texts and unlabelled texts.  Its
risk is  pi E_P[l(g)] + max(0, E_U[l(-g)] - pi E_P[l(-g)])  with the sigmoid loss and the class prior pi; when
the negative part falls below zero, a step against it is taken instead.  Features are a text's distinct words
and the heads of long words, hashed; those whose excess among the positives could be chance have no weight, and
no weight is negative, so that length alone decides nothing.

Defined cases: a null text is an empty one and gets the score of a text without features; without confirmed
toxic texts nothing is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled

#: Documents for the fit.
POSITIVE_DOCS, UNLABELLED_DOCS = 4000, 12000
BITS = 22
HEAD = 6
#: A feature is kept if its log-likelihood ratio (positives against unlabelled) is at least this.
LEAST_EVIDENCE = 12.0
#: Words whose weight a worker remembers.
CACHE_WORDS = 200_000
MODULUS, HELD_OUT = 5, 0

WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    weights: dict[int, float]
    bias: float


def features(word: str) -> tuple[int, ...]:
    """Hashed features of a lower-case word."""
    mask = (1 << BITS) - 1
    whole = crc32(word.encode("utf-8", "surrogatepass")) & mask
    return (whole, crc32(b"\0" + word[:HEAD].encode("utf-8", "surrogatepass")) & mask) if len(word) > HEAD else (whole,)


def words(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def fit(positive: list[str], unlabelled: list[str], prior: float, rounds: int = 1500, rate: float = 0.1, beta: float = 0.0, gamma: float = 1.0, ridge: float = 1e-4) -> Model:
    """Minimise the non-negative risk by full-batch Adam.  The lists of texts are used up."""
    if not positive:
        return Model({}, -4.0)
    n_p, n_u = len(positive), max(1, len(unlabelled))
    rows = []
    for part in (positive, unlabelled):
        while part:  # each text goes once its features are there
            rows.append(np.unique(np.fromiter((f for w in words(part.pop()) for f in features(w)), np.int32)))
    counts = [np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int32)]
    for i, own in enumerate(rows):
        counts[i >= n_p][own] += 1  # distinct within a row
    seen = np.flatnonzero(counts[0])
    c, in_u = counts[0][seen].astype(float), (counts[1][seen] + 0.5) / n_u
    ratio = np.log(c / n_p / in_u)
    strong = (ratio > 0) & (c * ratio - c + n_p * in_u >= LEAST_EVIDENCE)
    chosen, start = seen[strong], ratio[strong]
    place = np.full(1 << BITS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    held = [x[x >= 0] for x in (place[r] for r in rows)]
    del rows, place, counts
    col = np.concatenate([*held, np.zeros(0, np.int32)])
    row = np.repeat(np.arange(len(held)), [len(x) for x in held])
    is_p = np.arange(len(held)) < n_p
    w, m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    w[:-1], w[-1] = start, np.log(prior / (1 - prior))
    for t in range(1, rounds + 1):
        g = w[-1] + np.bincount(row, w[col], minlength=len(held))
        s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))  # the sigmoid loss of -g; of g it is 1 - s
        slope = s * (1 - s)
        negative = s[~is_p].sum() / n_u - prior * s[is_p].mean()
        on_p, on_n = np.where(is_p, -prior * slope / n_p, 0), np.where(is_p, -prior * slope / n_p, slope / n_u)
        out = on_p + on_n if negative >= -beta else -gamma * on_n
        grad = np.append(np.bincount(col, out[row], minlength=len(chosen)), out.sum()) + ridge * np.append(w[:-1], 0) / max(1, len(chosen)) ** 0.5
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w[:-1] = np.maximum(w[:-1], 0)
    return Model({int(f): float(x) for f, x in zip(chosen, w[:-1], strict=True) if x}, float(w[-1]))


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Positives: toxic rows outside the held-out fold.  Unlabelled: the other rows of these folds, whatever their label."""
    known = labelled.per_document(labels, "toxic").where(~labelled.held_out(MODULUS, HELD_OUT))
    prior = known.agg(F.avg(F.col("y").cast("double")).alias("prior")).first()["prior"] or 0.0
    positive = known.where("y = 1").select("doc_id")
    others = docs.select("doc_id").where(F.col("doc_id").isNotNull() & ~labelled.held_out(MODULUS, HELD_OUT)).distinct()
    others = others.join(positive, "doc_id", "left_anti")
    texts = labelled.sample(docs, {"positive": (positive, POSITIVE_DOCS), "unlabelled": (others, UNLABELLED_DOCS)})
    # the unlabelled lack the confirmed ones, so fewer of them are toxic than of all
    left = max(prior * (1 - _share(known, docs)), 0.01)
    return fit(texts["positive"], texts["unlabelled"], left)


def _share(known: DataFrame, docs: DataFrame) -> float:
    """Of the training folds' documents, the share that has a label."""
    rows = docs.select("doc_id").where(~labelled.held_out(MODULUS, HELD_OUT)).agg(F.approx_count_distinct("doc_id").alias("n")).first()["n"]
    return min(1.0, known.count() / max(1, rows))


class Scorer:
    """Scores of texts; a worker remembers the weights of words."""

    def __init__(self, model: Model) -> None:
        self.model, self.known = model, {}

    def __call__(self, text: str | None) -> float:
        own = words(text)
        new = [w for w in own if w not in self.known]
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known, new = {}, list(own)
        weights = self.model.weights
        self.known.update((w, sum(weights.get(f, 0.0) for f in features(w))) for w in new)
        g = self.model.bias + sum(sorted(map(self.known.__getitem__, own)))  # sorted: the sum must not depend on the set's order
        return float(1 / (1 + np.exp(-np.clip(g, -500, 500))))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, from the whole text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            s = np.array([scorer(t.as_py()) for t in batch.column("text")], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", labelled.held_out(MODULUS, HELD_OUT).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows that the model does not reject, with all their columns; one pass, and only verdicts come back from Python."""

    @F.pandas_udf("boolean")
    def rejected(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model)
        for texts in parts:
            yield pd.Series([scorer(t) >= 0.5 for t in texts], dtype=bool)

    return docs.where(~rejected(F.coalesce(F.col("text").cast("string"), F.lit(""))))
