"""Approximate nearest neighbours by robust-pruned directed graphs, one for each shard.

Equal vectors are one graph node that carries its smallest ids, as many as a result can name.  Distinct vectors
are dealt to shards by their hash.  In a shard, the directions of the vectors make the graph: points are inserted in
batches, a greedy beam search from the entry point proposes neighbours, and relaxed distance pruning keeps a
diverse few; edges run both ways, and lists that grow too long are pruned again.  Nodes that the entry point does not
reach are joined to it by their nearest reached ones.  Since the largest inner product with a direction need not lie
near it where norms vary, each node also gets edges to the largest products with its own direction that a beam search
by inner product finds, begun at its neighbours and at the longest vector.  A query first looks for directions like its
own, then searches by inner product from there over both kinds of edges.  Scores are then computed exactly, in double
precision, on the original vectors.

Every block of queries meets every shard of its dimension.  A block is about as large as a shard, so what is
shuffled for a pair of them is the least for its work.

Defined cases: a null, zero or non-finite vector or one with a null component or without id takes no part; vectors meet
those of their own dimension alone; equal rows count once, other rows with one id are candidates each, and of query
rows with one id the least vector is searched; ties go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import shared

#: Neighbours kept by pruning, and the list length that calls for it again.
DEGREE, MOST_DEGREE = 32, 48
#: Relaxation of the pruning rule.
ALPHA = 1.2
#: Edges of a node to the largest products with its direction.
WINNERS = 32
BUILD_BEAM, DIRECTION_BEAM, SEARCH_BEAM = 64, 32, 128
#: Nodes that one hop expands for each query.
WIDTH = 4
#: Vectors of a shard: so many, and so many bytes of them, at most.
SHARD_ROWS, SHARD_BYTES = 8192, 32 << 20
BLOCK_QUERIES = 8192
#: Queries, or insertions, that go hop by hop together.
BATCH = 256


def beam_search(points: np.ndarray, norms: np.ndarray, graph: np.ndarray, start: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query: the nodes found with the least `norm - 2 product` (ascending), and those expanded.  -1 pads.

    norms: the squared norms for nearness by distance, zeros for the largest inner product.  start: nodes for each query.
    """
    n, rows = len(queries), np.arange(len(queries))[:, None]
    ids, dist, done = np.full((n, beam), -1, np.int32), np.full((n, beam), np.inf, np.float32), np.ones((n, beam), bool)
    seen = np.zeros((n, len(points) + 1), bool)  # the last column takes the padding
    seen[:, -1] = True
    expanded, near = [], start
    while True:
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[seen[rows, near]] = -1
        seen[rows, near] = True
        near = near[:, np.flatnonzero((near >= 0).any(axis=0))]
        d = norms[near] - 2 * np.einsum("ijk,ik->ij", points[near], queries)
        d[near < 0] = np.inf
        ids, dist, done = np.concatenate((ids, near), 1), np.concatenate((dist, d.astype(np.float32)), 1), np.concatenate((done, near < 0), 1)
        order = np.argsort(dist, axis=1, kind="stable")[:, :beam]
        ids, dist, done = ids[rows, order], dist[rows, order], done[rows, order]
        if done.all():
            return ids, np.concatenate(expanded, 1) if expanded else np.zeros((n, 0), np.int32)
        first = np.argsort(done, axis=1, kind="stable")[:, :WIDTH]
        nodes = np.where(done[rows, first], -1, ids[rows, first])
        done[rows, first] = True
        expanded.append(nodes)
        near = np.where(np.repeat(nodes < 0, graph.shape[1], axis=1), -1, graph[nodes].reshape(n, -1))


def robust_prune(points: np.ndarray, own: np.ndarray, candidates: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """For each node of `own`, at most `degree` of its candidates: the nearest is kept, those nearer to it by alpha than to the node go, and so on."""
    rows = np.arange(len(own))
    x = points[candidates]
    norms = np.einsum("ijk,ijk->ij", x, x)
    between = norms[:, :, None] + norms[:, None, :] - 2 * (x @ x.transpose(0, 2, 1))
    p = points[own]
    dist = np.maximum(norms + np.einsum("ij,ij->i", p, p)[:, None] - 2 * np.einsum("ijk,ik->ij", x, p), 0)
    alive = (candidates >= 0) & (candidates != own[:, None])
    out = np.full((len(own), degree), -1, np.int32)
    for r in range(degree):
        d = np.where(alive, dist, np.inf)
        j = d.argmin(axis=1)
        ok = alive[rows, j]
        if not ok.any():
            break
        out[ok, r] = candidates[rows, j][ok]
        alive &= (alpha * alpha * between[rows, j] > dist) | ~ok[:, None]
        alive[rows, j] = False
        alive &= candidates != candidates[rows, j][:, None]
    return out


def build_graph(points: np.ndarray, seed: int = 0) -> tuple[np.ndarray, int]:
    """Neighbour lists (padded by -1) and the entry point."""
    n = len(points)
    graph = np.full((n + 1, MOST_DEGREE), -1, np.int32)  # the last row answers for the padding
    entry = int(((points - points.mean(0)) ** 2).sum(1).argmin())
    order = np.random.default_rng(seed).permutation(n)
    order = order[order != entry]
    norms = np.einsum("ij,ij->i", points, points)
    at, size = 0, 1
    while at < len(order):
        new = order[at : at + size]
        ids, expanded = beam_search(points, norms, graph, np.full((len(new), 1), entry), points[new], BUILD_BEAM)
        kept = robust_prune(points, new, np.concatenate((ids, expanded), 1))
        graph[new, :DEGREE] = kept
        _link_back(points, graph, new, kept)
        at += len(new)
        size = min(BATCH, size * 2)
    _reach_all(points, graph, entry)
    return graph, entry


def _link_back(points: np.ndarray, graph: np.ndarray, new: np.ndarray, kept: np.ndarray) -> None:
    source, target = np.repeat(new, kept.shape[1]), kept.ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nodes, starts, counts = np.unique(target, return_index=True, return_counts=True)
    full = []
    for node, a, c in zip(nodes.tolist(), starts.tolist(), counts.tolist(), strict=True):
        free = np.flatnonzero(graph[node] < 0)
        if c <= len(free):
            graph[node, free[:c]] = source[a : a + c]
        else:
            full.append((node, source[a : a + c]))
    for k in range(0, len(full), BATCH):
        part = full[k : k + BATCH]
        own = np.array([x[0] for x in part])
        wide = np.full((len(part), max(len(x[1]) for x in part)), -1, np.int32)
        for i, (_, more) in enumerate(part):
            wide[i, : len(more)] = more
        out = robust_prune(points, own, np.concatenate((graph[own], wide), 1))
        graph[own] = -1
        graph[own, : out.shape[1]] = out


def _reach_all(points: np.ndarray, graph: np.ndarray, entry: int) -> None:
    """Join what a walk from the entry point misses to its nearest reached node, by an edge more if need be."""
    n = len(points)
    reached = np.zeros(n + 1, bool)
    front = np.array([entry])
    while True:
        reached[front] = True
        while len(front):
            near = np.unique(graph[front])
            front = near[(near >= 0) & ~reached[near]]
            reached[front] = True
        left = np.flatnonzero(~reached[:n])
        if not len(left):
            return
        node = left[0]
        inside = np.flatnonzero(reached[:n])
        d = ((points[inside] - points[node]) ** 2).sum(1)
        for host in inside[np.argsort(d, kind="stable")]:
            free = np.flatnonzero(graph[host] < 0)
            if len(free):
                graph[host, free[0]] = node
                break
        front = np.array([node])


def scaled(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vectors over the largest component, directions), both fit for single precision."""
    own = vectors / np.abs(vectors).max(axis=1, keepdims=True, initial=0)
    directions = own / np.sqrt(np.einsum("ij,ij->i", own, own))[:, None]
    return (vectors / np.abs(vectors).max(initial=0)).astype(np.float32), directions.astype(np.float32)


@dataclass
class Graph:
    """near: neighbours by direction; far: edges to the largest inner products; entry: where a walk begins; longest: the longest vector."""

    near: np.ndarray
    far: np.ndarray
    entry: int
    longest: int


def winners(points: np.ndarray, directions: np.ndarray, near: np.ndarray, longest: int) -> np.ndarray:
    """For each node the nodes with the largest products with its direction that are found.  The lists found so far help those to come."""
    n = len(points)
    far = np.full((n + 1, WINNERS), -1, np.int32)
    zero = np.zeros(n + 1, np.float32)
    for at in range(0, n, BATCH):
        own = np.arange(at, min(n, at + BATCH))
        start = np.c_[own, near[own], np.full(len(own), longest)]
        found, _ = beam_search(points, zero, np.c_[near[:, :DEGREE], far], start, directions[own], BUILD_BEAM)
        far[own] = found[:, :WINNERS]
    return far


def index_shard(vectors: np.ndarray) -> Graph:
    points, directions = scaled(vectors)
    near, entry = build_graph(directions)
    longest = int(np.einsum("ij,ij->i", points, points).argmax())
    return Graph(near, winners(points, directions, near, longest), entry, longest)


def search_shard(vectors: np.ndarray, members: list[np.ndarray], graph: Graph, query_ids: np.ndarray, queries: np.ndarray, k: int, beam: int = SEARCH_BEAM) -> list[tuple[int, int, float]]:
    """(query id, id, score) of the best k of this shard for each query."""
    points, directions = scaled(vectors)
    _, asked = scaled(queries)
    zero, one = np.zeros(len(points) + 1, np.float32), np.ones(len(points) + 1, np.float32)
    edges, out = np.c_[graph.near[:, :DEGREE], graph.far], []
    for at in range(0, len(queries), BATCH):
        q = asked[at : at + BATCH]
        like, _ = beam_search(directions, one, graph.near, np.full((len(q), 1), graph.entry), q, DIRECTION_BEAM)
        ids, _ = beam_search(points, zero, edges, np.c_[like, np.full(len(q), graph.longest)], q, beam)
        for own, query, found in zip(query_ids[at : at + BATCH].tolist(), queries[at : at + BATCH], ids, strict=True):
            found = found[found >= 0]
            scores = vectors[found] @ query
            best = sorted((-s, m) for f, s in zip(found.tolist(), scores.tolist(), strict=True) for m in members[f].tolist() if m != own)[:k]
            out += [(own, m, -s) for s, m in best]
    return out


@dataclass
class Index:
    """rows: the vec_id, vector that take part; shards: one row per shard with its vectors, ids and graph; k: the most neighbours that it can name."""

    rows: DataFrame
    shards: DataFrame
    k: int


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """vec_id and its vector (array<double>) of the rows that take part."""
    v = F.col("vector")
    rows = rows.select("vec_id", F.col(vector).cast("array<double>").alias("vector")).where("vec_id IS NOT NULL AND vector IS NOT NULL")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return rows.where(fine)


def _dealt(rows: DataFrame, name: str, most: DataFrame, key: str) -> DataFrame:
    """rows with their dimension d, the number of parts of it, and the part by the hash of `key`; most: d, parts."""
    rows = rows.withColumn("d", F.size("vector")).join(shared.small(most, 16), "d")
    return rows.withColumn(name, F.pmod(F.xxhash64(key), F.col("parts")).cast("int"))


def build(rows: DataFrame, vector: str = "embedding", k: int = 20, shard_rows: int = SHARD_ROWS) -> Index:
    """The index of all usable rows, fit for results of up to k neighbours."""
    spark = rows.sparkSession
    rows = shared.stored(usable(rows, vector), "vectors")
    salted = rows.withColumn("salt", shared.bucket_of("vec_id", shared.shuffle_partitions(spark)))
    salted = salted.dropDuplicates(["vector", "salt", "vec_id"])
    for keys in (["vector", "salt"], ["vector"]):  # a query's own id and k others
        salted = salted.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("vec_id"))).where(F.col("nth") <= k + 1).drop("nth")
    nodes = salted.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))  # at most k + 1 each
    nodes = shared.stored(nodes, "nodes")
    room = F.least(F.lit(shard_rows), F.greatest(F.lit(1), F.floor(F.lit(SHARD_BYTES) / (8 * F.col("d")))))
    parts = nodes.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).select("d", F.ceil(F.col("n") / room).alias("parts"))

    def graph(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.iloc[np.argsort([x[0] for x in pdf["ids"]], kind="stable")]
        vectors = np.array(pdf["vector"].tolist(), np.float64)
        made = index_shard(vectors)
        ids = [np.asarray(x, np.int64) for x in pdf["ids"]]
        counts = np.array([len(x) for x in ids], np.int32)
        return pd.DataFrame({"d": [vectors.shape[1]], "shard": [pdf["shard"].iloc[0]], "vectors": [vectors.tobytes()], "counts": [counts.tobytes()], "ids": [np.concatenate(ids).tobytes()], "near": [made.near.tobytes()], "far": [made.far.tobytes()], "entry": [made.entry], "longest": [made.longest]})

    dealt = _dealt(nodes, "shard", shared.stored(parts, "dimensions"), "vector").select("d", "shard", "vector", "ids")
    schema = "d int, shard int, vectors binary, counts binary, ids binary, near binary, far binary, entry int, longest int"
    return Index(rows, shared.stored(dealt.groupBy("d", "shard").applyInPandas(graph, schema), "index"), k)


def search(index: Index, queries: DataFrame, k: int = 20, block_queries: int = BLOCK_QUERIES, beam: int = SEARCH_BEAM) -> DataFrame:
    """queries: vec_id, vector (usable ones).  Returns query_id, rank, vec_id, score of the k nearest found for each."""
    if k > index.k:
        raise ValueError(f"the index names {index.k} neighbours of a vector at most, not {k}")
    queries = shared.stored(queries.groupBy("vec_id").agg(F.min("vector").alias("vector")), "queries")
    blocks = queries.groupBy(F.size("vector").alias("d")).agg(F.ceil(F.count("*") / block_queries).alias("parts"))
    blocks = shared.stored(blocks, "blocks")
    packed = _dealt(queries, "block", blocks, "vec_id").groupBy("d", "block").agg(F.sort_array(F.collect_list(F.struct("vec_id", "vector"))).alias("block_queries"))
    pairs = index.shards.select("d").join(blocks, "d").agg(F.sum("parts").alias("n")).first()["n"] or 1
    met = index.shards.join(shared.small(blocks, 16), "d").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1))).drop("parts").join(packed, ["d", "block"])
    met = met.repartition(max(1, int(pairs)), "d", "shard", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {x: batch.column(x)[i] for x in batch.schema.names}
                raw = {x: (lambda kind, x=x: np.frombuffer(row[x].as_buffer(), kind)) for x in ("vectors", "counts", "ids", "near", "far")}
                counts = raw["counts"](np.int32)
                members = np.split(raw["ids"](np.int64), np.cumsum(counts)[:-1])
                vectors = raw["vectors"](np.float64).reshape(len(counts), -1)
                near, far = (raw[x](np.int32).reshape(len(counts) + 1, -1) for x in ("near", "far"))
                asked = row["block_queries"].values
                q = asked.field("vector").flatten().to_numpy(zero_copy_only=False).reshape(len(asked), -1)
                graph = Graph(near, far, row["entry"].as_py(), row["longest"].as_py())
                found = search_shard(vectors, members, graph, asked.field("vec_id").cast(pa.int64()).to_numpy(zero_copy_only=False), q, k, beam)
                yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in found], t) for n, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    found = met.mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
