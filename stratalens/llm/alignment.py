"""Alignment of the tokens of two tokenisers.

A: byte-level BPE of a space and the text.  B: the pieces of a SentencePiece model with byte fallback, which adds that
space itself.  Tokens are nodes; a token of A and one of B are linked if their byte ranges overlap.  Union-find over
these links gives components, which are exactly the minimal groups: the cuts between them are the places where tokens
of both end.  A component's links are expanded, counted in each document, then over the corpus.

Neither tokeniser joins what lies on both sides of a single space between other characters (for B: if no piece has a
space after another character, which is looked up), so texts are cut there and only the distinct parts of an Arrow
chunk are encoded and aligned; a text's tokens are those of its parts in a row.

Defined cases: strings of special tokens in a text are plain text; a text that is null or empty, or that B's pieces do
not spell byte by byte, has no tokens: zeros, and no groups (an empty string).  Equal rows count each on its own.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, shared, words

#: Bytes of a row of the pair counts, to judge whether they may be broadcast.
COUNT_BYTES = 40
#: Salts of a pair where its counts must be shuffled.
SALTS = 32
#: Bytes of the texts whose parts are looked up together.
CHUNK_BYTES = 2 << 20
#: Memory of a worker for aligned parts, and about what one takes besides its links.
MOST_BYTES, PART_BYTES = 200 << 20, 400
# Fixed value: SentencePiece's sign for a space.
SPACE = "▁"


def cuts(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where parts begin: at each text, and before a single space whose neighbours are certainly no white space.

    Characters of ASCII beyond the space, and those of leading byte 0xC3 to 0xDF or from 0xE4 on, are none.
    """
    safe = np.zeros(256, bool)
    safe[0x21:0x7F] = safe[0xC3:0xE0] = safe[0xE4:0xF8] = True
    at = np.flatnonzero(raw[1:-1] == 0x20) + 1
    at = at[safe[raw[at + 1]]]
    tail = raw >> 6 == 2
    before = at - 1
    for _ in range(3):  # back to the leading byte
        before = before - tail[before]
    begins = np.zeros(len(raw), bool)
    begins[at[safe[raw[before]]]] = begins[starts] = True
    return np.flatnonzero(begins)


def union_find(links: tuple[np.ndarray, np.ndarray], nodes: int) -> np.ndarray:
    """The smallest node of each node's component."""
    parent = np.arange(nodes)
    u, v = links
    while True:
        a, b = parent[u], parent[v]
        apart = a != b
        if not apart.any():
            return parent
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up


class Aligner:
    """Two vocabularies: the content of a `tokenizers` JSON file, and of a SentencePiece model.

    Parts that were aligned are remembered, up to MOST_BYTES of them; then all are forgotten.
    """

    def __init__(self, spec: str, model: bytes) -> None:
        import tiktoken
        from sentencepiece import SentencePieceProcessor

        data = json.loads(spec)["model"]
        vocab, symbols = data["vocab"], bpe.byte_symbols()
        byte_of = {s: b for b, s in enumerate(symbols)}
        pairs = [x if isinstance(x, list) else x.split(" ") for x in data["merges"]]
        names_a = [*symbols, *(x + y for x, y in pairs)]  # by rank
        spelled_a = [bytes(byte_of[c] for c in x) for x in names_a]
        ranks = {x: k for k, x in reversed(list(enumerate(spelled_a)))}
        self.encode_a = tiktoken.Encoding("a", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
        self.id_a, self.len_a = np.array([vocab[x] for x in names_a]), np.array([len(x) for x in spelled_a])
        self.b = SentencePieceProcessor(model_proto=model)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        spelled = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace(SPACE, " ").encode() for i, x in enumerate(names)]
        self.separable = not any(SPACE in x.lstrip(SPACE) for x in names)
        self.len_b = np.array([len(x) for x in spelled])
        self.pool_b = np.frombuffer(b"".join(spelled), np.uint8)
        self.at_b = np.cumsum(self.len_b) - self.len_b
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.bytes = 0
        self.whole = np.zeros(0, bool)
        self.counts = np.zeros((4, 0), np.int64)
        self.said: list[str] = []
        self.links = np.zeros(0, np.int64)

    def _spelled(self, b: np.ndarray, n_b: np.ndarray, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Which parts the pieces of B spell byte by byte."""
        sizes = np.diff(bounds)
        like = np.diff(np.append(0, np.cumsum(self.len_b[b]))[np.append(0, np.cumsum(n_b))]) == sizes
        own = b[np.repeat(like, n_b)]
        other = words.gather(self.pool_b, self.at_b[own], self.len_b[own]) != words.gather(raw, bounds[:-1][like], sizes[like])
        whole = like.copy()
        whole[like] = np.diff(np.append(0, np.cumsum(other))[np.append(0, np.cumsum(sizes[like]))]) == 0
        return whole

    def _learn(self, parts: pa.Array) -> None:
        """Encode and align new parts, each with its space."""
        texts = parts.to_pylist()
        ids_b = self.b.encode([t[1:] for t in texts], num_threads=1)
        n_b = np.array([len(x) for x in ids_b], np.int64)
        b = np.fromiter(chain.from_iterable(ids_b), np.int64, int(n_b.sum()))
        whole = self._spelled(b, n_b, *words.content(parts))
        b, n_b = b[np.repeat(whole, n_b)], np.where(whole, n_b, 0)
        ids_a = [self.encode_a(t) if w else [] for t, w in zip(texts, whole.tolist(), strict=True)]
        n_a = np.array([len(x) for x in ids_a], np.int64)
        rank = np.fromiter(chain.from_iterable(ids_a), np.int64, int(n_a.sum()))
        a = self.id_a[rank]
        end_a, end_b = np.cumsum(self.len_a[rank]), np.cumsum(self.len_b[b])
        ending = np.zeros(int(end_a[-1]) + 1 if len(a) else 0, bool)
        ending[end_a] = ending[end_b] = True
        ends = np.flatnonzero(ending)  # between two of them lies one token of each: a link
        link_a, link_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        root = union_find((link_a, link_b + len(a)), len(a) + len(b))
        edge_a = np.flatnonzero(np.diff(root[: len(a)], prepend=-1))  # first token of A in each component, in order of text
        edge_b = np.flatnonzero(np.diff(root[len(a) :], prepend=-1)).tolist()
        say_a, say_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        edges_a, edges_b = [*edge_a.tolist(), len(a)], [*edge_b, len(b)]
        said = [f"{','.join(say_a[i:j])}|{','.join(say_b[k:m])}" for i, j, k, m in zip(edges_a, edges_a[1:], edges_b, edges_b[1:], strict=False)]
        of_part = np.append(0, np.cumsum(n_a))
        first = np.searchsorted(edge_a, of_part)
        new = np.stack([n_a, n_b, np.diff(first), np.diff(np.searchsorted(link_a, of_part))])
        self.known.update(zip(texts, range(len(self.said), len(self.said) + len(texts)), strict=True))
        self.said += [";".join(said[i:j]) for i, j in pairwise(first.tolist())]
        self.whole, self.counts = np.append(self.whole, whole), np.hstack([self.counts, new])
        self.links = np.append(self.links, a[link_a] << 32 | b[link_b])
        self.bytes += PART_BYTES * len(texts) + 16 * len(ends)

    def parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """For distinct parts: whether B spells it; a row each of their tokens of A, of B, groups and links; groups as text; all link pairs (a << 32 | b) in a row."""
        if self.bytes > MOST_BYTES:
            self._forget()
        texts = parts.to_pylist()
        fresh = np.array([t not in self.known for t in texts], bool)
        if fresh.any():
            self._learn(parts.filter(pa.array(fresh)))
        at = np.array([self.known[t] for t in texts], np.int64)
        n_links = self.counts[3]
        links = words.gather(self.links, (np.cumsum(n_links) - n_links)[at], n_links[at])
        return self.whole[at], self.counts[:, at], pa.array([self.said[i] for i in at.tolist()], pa.string()), links

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array, pa.Array]:
        """Texts with the added space (null: no text) -> numbers (a row each of tokens of A, of B, groups, links), groups as text, link pairs, their counts."""
        n = len(texts)
        raw, bounds = words.content(pc.fill_null(texts, b""))
        starts = bounds[:-1][np.diff(bounds) > 0]
        begins = cuts(raw, starts) if self.separable else starts
        coded = pa.StringArray.from_buffers(len(begins), pa.py_buffer(np.append(begins, len(raw)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))).dictionary_encode()
        whole, counts, said, pairs = self.parts(coded.dictionary)
        number = coded.indices.to_numpy()
        edges = np.append(np.searchsorted(begins, bounds[:-1]), len(begins))
        good = np.diff(np.append(0, np.cumsum(~whole[number]))[edges]) == 0
        used = np.repeat(good, np.diff(edges))
        number, edges = number[used], np.append(0, np.cumsum(np.where(good, np.diff(edges), 0)))
        totals = np.stack([np.diff(np.append(0, np.cumsum(c[number]))[edges]) for c in counts])
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), said.take(pa.array(number))), ";")
        distinct, pair = np.unique(pairs, return_inverse=True)
        n_links = counts[-1]
        found = words.gather(pair, (np.cumsum(n_links) - n_links)[number], n_links[number])
        keys, times = np.unique(np.repeat(np.arange(n), totals[-1]) << 32 | found, return_counts=True)
        offsets = pa.array(np.searchsorted(keys >> 32, np.arange(n + 1)), pa.int32())
        return totals, joined, pa.ListArray.from_arrays(offsets, pa.array(distinct[keys & 0xFFFFFFFF])), pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int64)))


@lru_cache(maxsize=1)
def aligner(spec: str, model: bytes) -> Aligner:
    """One for each pair of vocabularies and worker."""
    return Aligner(spec, model)


def groups(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups (`a1,a2|b1;a3|b2,b3`), pairs (a << 32 | b, distinct) and times of every row."""
    spec = bpe.read_spec(path_a)
    with open(path_b, "rb") as file:
        model = file.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = aligner(spec, model)
        for batch in batches:
            texts = batch.column("text")
            size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
            edges = [0, *(np.flatnonzero(np.diff(size // CHUNK_BYTES)) + 1).tolist(), len(texts)] if len(texts) else [0]
            for x, y in zip(edges, edges[1:], strict=False):
                totals, said, pairs, times = here.texts(texts.slice(x, y - x))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(x, y - x), *map(pa.array, totals), said, pairs, times], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])

    text = F.col("text").cast("string")
    rows = docs.select("doc_id", F.when(text != "", F.concat(F.lit(" "), text)).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<long>")


def _links(rows: DataFrame) -> DataFrame:
    return rows.select("row", F.inline(F.arrays_zip("pairs", "times")))


def pair_counts(rows: DataFrame) -> DataFrame:
    """pairs, count and best (the count is the highest of its token of B) from rows of `groups`; counted in part before the shuffle."""
    counts = shared.stored(_links(rows.withColumn("row", F.lit(0))).groupBy("pairs").agg(F.sum("times").alias("count")), "pair_counts")
    b = F.col("pairs").bitwiseAND(0xFFFFFFFF).alias("b")
    highest = counts.groupBy(b).agg(F.max("count").alias("highest"))
    return counts.withColumn("b", b).join(highest, "b").select("pairs", "count", (F.col("count") == F.col("highest")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    n_best: links whose pair has the highest count of its token of B over all documents; count_sum: counts over links.
    """
    found = groups(docs, path_a, path_b).withColumn("groups_sha256", F.when(F.col("n_links") > 0, F.sha2("groups", 256)).otherwise("")).drop("groups")
    rows = shared.stored(found.withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = shared.stored(pair_counts(rows), "pairs")
    if shared.fits(counts, COUNT_BYTES):
        links = _links(rows).join(F.broadcast(counts), "pairs")  # its rows were counted
    else:
        links = shared.spread_join(_links(rows).withColumn("salt", F.pmod(F.col("row"), F.lit(SALTS))), counts, ["pairs"], "salt")
    sums = links.groupBy("row").agg(F.sum(F.col("times") * F.col("count")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")]
    return rows.drop("pairs", "times").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256")
