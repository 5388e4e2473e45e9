"""Compression classifier for text quality.

Two zstandard dictionaries are trained, from good and from bad texts.  A text is compressed with either and
with none; the difference of the two sizes, normalised by the plain compressed size and by the length, is
what is calibrated, together with the plain ratio and the logarithm of the length, on training texts that
the dictionaries have not seen.

Defined cases: a null text is an empty one; an empty text gets the calibrated score of its (zero) features;
without labels of both classes every score is the share of good ones (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled

#: Documents of each class for the fit; half go to the dictionaries, half to the calibration.
CLASS_DOCS = 6000
DICTIONARY_BYTES = 256 << 10
PIECE_BYTES = 1024
#: Of each class for its dictionary, dealt evenly over the pieces.
TRAIN_BYTES = 12 << 20
LEVEL = 3
MODULUS, HELD_OUT = 3, 1


@dataclass
class Model:
    good: bytes
    bad: bytes
    mean: list[float]
    scale: list[float]
    weights: list[float]
    bias: float


def train_dictionary(texts: list[str]) -> bytes:
    """A zstandard dictionary from the texts' pieces; raw content if they are too few to train one."""
    import zstandard

    pieces = [b[k : k + PIECE_BYTES] for t in texts if (b := t.encode()) for k in range(0, len(b), PIECE_BYTES)]
    step = max(1, -(-len(pieces) * PIECE_BYTES // TRAIN_BYTES))
    pieces = pieces[::step]
    room = min(DICTIONARY_BYTES, max(1024, sum(map(len, pieces)) // 4))
    try:
        return zstandard.train_dictionary(room, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-room:] or b" " * 8


class Meter:
    """Features of texts by compressed sizes."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        import zstandard

        dictionaries = [zstandard.ZstdCompressionDict(x) for x in (good, bad)]
        for x in dictionaries:
            x.precompute_compress(level=LEVEL)
        self.coders = [zstandard.ZstdCompressor(level=LEVEL, dict_data=x) for x in dictionaries] + [zstandard.ZstdCompressor(level=LEVEL)]

    def __call__(self, text: str | None) -> tuple[float, float, float, float]:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if not raw:
            return 0.0, 0.0, 0.0, 0.0
        good, bad, plain = (len(x.compress(raw)) for x in self.coders)
        return (bad - good) / plain, (bad - good) / len(raw), plain / len(raw), float(np.log1p(len(raw)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Newton's method; the last weight is the bias."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(good: list[str], bad: list[str]) -> Model:
    if len(good) < 2 or len(bad) < 2:
        share = (len(good) + 0.5) / (len(good) + len(bad) + 1)
        return Model(b" " * 8, b" " * 8, [0.0] * 4, [1.0] * 4, [0.0] * 4, float(np.log(share / (1 - share))))
    dictionaries = [train_dictionary(x[::2]) for x in (good, bad)]
    meter = Meter(*dictionaries)
    x = np.array([meter(t) for t in [*good[1::2], *bad[1::2]]])
    y = np.array([1.0] * len(good[1::2]) + [0.0] * len(bad[1::2]))
    mean, scale = x.mean(0), x.std(0) + 1e-9
    w = logistic((x - mean) / scale, y)
    return Model(*dictionaries, mean.tolist(), scale.tolist(), w[:-1].tolist(), float(w[-1]))


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on labels outside the held-out fold.  Both classes are sampled alike often, then set to their true odds."""
    known = labelled.per_document(labels, "quality").where(~labelled.held_out(MODULUS, HELD_OUT))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    texts = labelled.sample(docs, {"good": (known.where("y = 1"), CLASS_DOCS), "bad": (known.where("y = 0"), CLASS_DOCS)})
    model = fit(texts["good"], texts["bad"])
    if all(len(x) >= 2 for x in texts.values()):
        model.bias += float(np.log(counts[1] / counts[0]) - np.log(len(texts["good"]) / len(texts["bad"])))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, from the whole text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = Meter(model.good, model.bad)
        mean, scale, weights = map(np.array, (model.mean, model.scale, model.weights))
        for batch in batches:
            x = np.array([meter(t.as_py()) for t in batch.column("text")]).reshape(-1, 4)
            z = ((x - mean) / scale) @ weights + model.bias
            scores = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", labelled.held_out(MODULUS, HELD_OUT).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
