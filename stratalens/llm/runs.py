"""Periodic runs of words, by block matching.

A run is a stretch of consecutive words with smallest period q, at least max(6, 4 * q) long, that no neighbouring
word extends.  For the power of two B with B <= q < 2 * B, a run holds a block of B words at a multiple of B within
its first 2 * q words; the same words stand q and 2 * q further on.  So for each B the aligned blocks of a document
are the keys, integer sequences, of a pyahocorasick automaton, the document is searched for them, and occurrences at
a distance from B to 2 * B - 1 (and again at twice that distance) seed an exact extension to both sides.

What keeps the work near n log n: a block is a key only if each of its short word sequences comes again within
2 * B - 1 words (else it cannot lie in such a run); one automaton holds at most SEGMENT_BLOCKS neighbouring blocks and
searches as far as their partners can stand; blocks that are themselves repetitions, of a known run, take their
partners from the borders of known runs instead of a search; pairs inside a known run whose period divides their
distance are left out, as the distance is then no smallest period; a stretch is extended once per distance.

Defined cases: words are what ASCII white space parts; a null or empty text has no words and no runs; equal rows give
equal results, one for each row; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words

#: A run has at least this many words and this many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Longest word sequence whose next occurrence is looked up to choose the keys.
GRAM = 8
#: Aligned blocks in one automaton.
SEGMENT_BLOCKS = 256

RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _next_distance(keys: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """For each position the distance to the next with an equal key, or the largest number."""
    out = np.full(len(keys), np.iinfo(np.int64).max)
    at = np.flatnonzero(valid)
    order = at[np.argsort(keys[at], kind="stable")]
    same = keys[order[1:]] == keys[order[:-1]]
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def candidates(codes: np.ndarray, bounds: np.ndarray) -> dict[int, dict[int, np.ndarray]]:
    """document -> block length -> starts (in the document) of the aligned blocks that may lie in a run.

    codes: the word numbers of all documents; bounds: where each begins.  Hashes may only add candidates.
    """
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    left = np.repeat(bounds[1:], sizes) - np.arange(len(codes))  # words from here to the document's end
    keys = (owner.astype(np.uint64) << np.uint64(32)) + codes.astype(np.uint64)
    out: dict[int, dict[int, np.ndarray]] = {}
    gram, block = 1, 1
    gaps = _next_distance(keys, left >= 1)
    longest = int(sizes.max(initial=0))
    while max(LEAST_WORDS, LEAST_PERIODS * block) <= longest:
        if gram < min(block, GRAM):
            keys[:-gram] = (keys[:-gram] * np.uint64(0x9E3779B97F4A7C15) ^ (keys[:-gram] >> np.uint64(29))) + keys[gram:] * np.uint64(0xC2B2AE3D27D4EB4F)
            gram *= 2
            gaps = _next_distance(keys, left >= gram)
        far = np.concatenate(([0], np.cumsum(gaps > 2 * block - 1)))
        docs = np.flatnonzero(sizes >= max(LEAST_WORDS, LEAST_PERIODS * block))
        each = sizes[docs] // block
        nth = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        doc, start = np.repeat(docs, each), nth * block
        at = bounds[doc] + start
        fine = far[at + block - gram + 1] == far[at]
        doc, start = doc[fine], start[fine]
        cuts = np.flatnonzero(np.diff(doc)) + 1
        for own, starts in zip(doc[np.append(0, cuts)] if len(doc) else (), np.split(start, cuts), strict=False):
            out.setdefault(int(own), {})[block] = starts
        block *= 2
    return out


def _forward(w: np.ndarray, i: int, d: int) -> int:
    """How many words from i on equal those d further on."""
    k, step = 0, 32
    while True:
        far = w[i + d + k : i + d + k + step]
        other = np.flatnonzero(w[i + k : i + k + len(far)] != far)
        if len(other):
            return k + int(other[0])
        k += len(far)
        if len(far) < step:
            return k
        step *= 2


def _backward(w: np.ndarray, i: int, d: int) -> int:
    """How many words before i equal those d further on."""
    k, step = 0, 32
    while True:
        low = max(0, i - k - step)
        near = w[low : i - k]
        other = np.flatnonzero(near != w[low + d : i - k + d])
        if len(other):
            return k + len(near) - 1 - int(other[-1])
        k += len(near)
        if len(near) < step:
            return k
        step *= 2


def _smallest(w: np.ndarray, start: int, d: int) -> bool:
    """Whether the d words from start on are no repetition of fewer."""
    rest, prime = d, 2
    while rest > 1:
        if prime * prime > rest:
            prime = rest
        if rest % prime == 0:
            e = d // prime
            if np.array_equal(w[start : start + d - e], w[start + e : start + d]):
                return False
            while rest % prime == 0:
                rest //= prime
        prime += 1
    return True


def _seeds(w: np.ndarray, block: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (start of an aligned block, distance of an equal one), for blocks of one segment."""
    numbers: dict[tuple, int] = {}
    number = np.array([numbers.setdefault(tuple(w[x : x + block].tolist()), len(numbers)) for x in starts.tolist()])
    machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for key, value in numbers.items():
        machine.add_word(key, value)
    machine.make_automaton()
    low = int(starts[0])
    text = tuple(w[low : int(starts[-1]) + 5 * block].tolist())
    hits = np.array(list(machine.iter(text)), np.int64).reshape(-1, 2)
    place = hits[:, 0] + low - block + 1
    order = np.argsort(hits[:, 1], kind="stable")  # places stay in order within a key
    place, edges = place[order], np.searchsorted(hits[order, 1], np.arange(len(numbers) + 1))
    own = np.argsort(number, kind="stable")
    own_edges = np.searchsorted(number[own], np.arange(len(numbers) + 1))
    xs, ds = [], []
    for k in range(len(numbers)):
        y, x = place[edges[k] : edges[k + 1]], starts[own[own_edges[k] : own_edges[k + 1]]]
        first, last = np.searchsorted(y, x + block), np.searchsorted(y, x + 2 * block)
        pair_x = np.repeat(x, last - first)
        pair_d = words.gather(y, first, last - first) - pair_x
        third = pair_x + 2 * pair_d
        again = np.searchsorted(y, third)
        fine = again < len(y)
        fine[fine] = y[again[fine]] == third[fine]
        xs.append(pair_x[fine])
        ds.append(pair_d[fine])
    return np.concatenate(xs), np.concatenate(ds)


def _repeated(known: np.ndarray, own: np.ndarray, block: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same pairs for blocks inside known runs that are long enough to be runs themselves (own: their rows in known).

    Such a block stands only in runs of that period, all of them known.  A run with distance d as smallest period outreaches the known one
    at its start or its end, and repeats that border d words further on: only the distances of like borders count.
    """
    xs, ds = [starts[:0]], [starts[:0]]
    begin, length, period = known.T
    for q in np.unique(period[own]).tolist():
        same = np.flatnonzero((period == q) & (length >= block))
        mine = np.flatnonzero(period[own] == q)
        for border in (begin, begin + length):
            borders = np.sort(border[same])
            here = border[own[mine]]
            first, last = np.searchsorted(borders, here + block), np.searchsorted(borders, here + 2 * block)
            xs.append(np.repeat(starts[mine], last - first))
            ds.append(words.gather(borders, first, last - first) - np.repeat(here, last - first))
    return np.concatenate(xs), np.concatenate(ds)


def find_runs(w: np.ndarray, blocks: dict[int, np.ndarray]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of one document, by start, then period; blocks: its candidates by length."""
    known = np.zeros((0, 3), np.int64)
    cover = np.full(len(w), -1)  # the known run that reaches furthest from a word
    for block, starts in sorted(blocks.items()):
        run = cover[starts]
        inside = run >= 0
        rows = known[run[inside]]
        inside[inside] = (rows[:, 0] + rows[:, 1] >= starts[inside] + block) & (np.maximum(LEAST_WORDS, LEAST_PERIODS * rows[:, 2]) <= block)
        pairs = [_repeated(known, run[inside], block, starts[inside])] if inside.any() else []
        starts = starts[~inside]
        segment = starts // (SEGMENT_BLOCKS * block)
        for own in np.split(starts, np.flatnonzero(np.diff(segment)) + 1):
            if len(own):
                x, d = _seeds(w, block, own)
                run = cover[x]
                within = run >= 0
                rows = known[run[within]]
                within[within] = (rows[:, 0] + rows[:, 1] >= (x + d)[within] + block) & (d[within] % rows[:, 2] == 0)
                pairs.append((x[~within], d[~within]))
        x, d = (np.concatenate(side) for side in zip(*pairs, strict=True))
        new = []
        distance, end = 0, 0  # of the last stretch
        order = np.lexsort((x, d))
        for at, next_distance in zip(x[order].tolist(), d[order].tolist(), strict=True):
            if next_distance == distance and at < end:
                continue
            distance = next_distance
            start = at - _backward(w, at, distance)
            end = at + _forward(w, at, distance)
            length = end + distance - start
            if length >= max(LEAST_WORDS, LEAST_PERIODS * distance) and _smallest(w, start, distance):
                new.append((start, length, distance))
        if new:
            ends = np.where(cover >= 0, known[cover, 0] + known[cover, 1], 0) if len(known) else np.zeros(len(w), np.int64)
            for k, (start, length, _) in enumerate(new, len(known)):
                longer = ends[start : start + length] < start + length
                cover[start : start + length][longer] = k
                ends[start : start + length][longer] = start + length
            known = np.concatenate([known, np.array(new, np.int64)])
    return sorted(map(tuple, known.tolist()), key=lambda r: (r[0], r[2]))


def _chunk(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Runs and collapsed text of each text."""
    split = pc.ascii_split_whitespace(texts)
    flat = split.flatten()
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    offsets = split.offsets.to_numpy().astype(np.int64)
    bounds = np.append(0, np.cumsum(full))[offsets - offsets[0]]
    flat = flat.filter(pa.array(full))
    codes = flat.dictionary_encode().indices.to_numpy()
    keep = np.ones(len(codes), bool)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
    for doc, blocks in candidates(codes, bounds).items():
        first = int(bounds[doc])
        runs[doc] = find_runs(codes[first : bounds[doc + 1]], blocks)
        for start, length, period in runs[doc]:
            keep[first + start + period : first + start + length] = False
    kept = np.append(0, np.cumsum(keep))[bounds]
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept, pa.int32()), flat.filter(pa.array(keep))), " ")
    counts = np.append(0, np.cumsum([len(r) for r in runs]))
    values = np.array([r for own in runs for r in own], np.int64).reshape(-1, 3)
    fields = pa.StructArray.from_arrays([pa.array(values[:, k]) for k in range(3)], fields=list(RUNS.value_type))
    return pa.ListArray.from_arrays(pa.array(counts, pa.int32()), fields, type=RUNS), collapsed


def find(docs: DataFrame) -> DataFrame:
    """doc_id, runs (start, length, period; by start, then period) and collapsed of every row.

    collapsed: the words, joined by one space, without those that a run contains after its first period.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
            cuts = np.flatnonzero(np.diff(size // words.CHUNK_BYTES)) + 1
            edges = [0, *cuts.tolist(), len(texts)] if len(texts) else [0]
            for a, b in zip(edges, edges[1:], strict=False):
                found, collapsed = _chunk(texts.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), found, collapsed], ["doc_id", "runs", "collapsed"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, runs array<struct<start:long,length:long,period:long>>, collapsed string")
