import struct
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest
import zstandard
from pyspark.sql.types import ArrayType, FloatType, LongType, StringType, StructField, StructType

from stratalens.llm import ann, shared, sharding, warc

from .conftest import ODD, clashing

PAGES = StructType([StructField("page_id", LongType()), StructField("url", StringType()), StructField("html", StringType())])
BIG = "<p>" + "same payload " * 20
ROWS = [(1, "http://a", BIG), (2, "http://b\r\nX: y", BIG), (3, None, BIG), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (None, "n", BIG), (None, "n", "no id at all " * 20), (8, "ü", "é" * 50 + "\r\n\r\n"), (9, "u", "x" * 300_000), (9, "u", "x" * 300_000)]


def expected(rows):
    heads = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            heads[h] = min(i, heads.get(h, i))
    out = []
    for i, _, h in rows:
        raw, head = (h or "").encode(), heads.get(h)
        out.append((i, len(raw), sha256(raw).hexdigest(), "response" if head is None or head == i else "revisit", None if head == i else head))
    return sorted(out, key=str)


@pytest.mark.parametrize("archive_bytes", [1000, 16 << 20])
def test_archives_round_trip(spark, tmp_path, archive_bytes):
    path = str(tmp_path / "warc")
    warc.write(clashing(spark.createDataFrame(ROWS, PAGES)), path, archive_bytes)
    found = warc.read(spark, path).collect()
    assert not [r.error for r in found if r.error]
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=str) == expected(ROWS)
    by_id = {r[0]: r[2] for r in ROWS}
    assert all(bytes(r.payload).decode() == (by_id[r.page_id] or "") for r in found if r.record_type == "response" and r.page_id)
    for file in (tmp_path / "warc").glob("part-*"):
        raw = file.read_bytes()
        if raw:
            assert raw[:4] == struct.pack("<I", 0x184D2A5D)


def test_empty_table(spark, tmp_path):
    warc.write(spark.createDataFrame([], PAGES), str(tmp_path / "none"))
    assert warc.read(spark, str(tmp_path / "none")).count() == 0


def test_broken_archives_are_reported():
    good = warc.record(1, "u", b"payload", sha256(b"payload").hexdigest(), None)
    pack = zstandard.ZstdCompressor(write_checksum=True).compress
    assert [x["type"] for x in warc.records(pack(good) + warc.SEPARATOR + pack(good))] == ["response", "response"]
    broken = [good.replace(b"WARC/1.1", b"WARC/9.9"), good.replace(b"WARC-Date", b"X-Date"), good.replace(b"payload\r\n", b"payloads\r\n"), good.replace(b"payload\r\n\r\n", b"pay1oad\r\n\r\n"), good[:-2], good.replace(b"WARC-Type: response", b"WARC-Type: other"), b"nothing"]
    found = list(warc.records(b"".join(map(pack, [*broken, good]))))
    assert [isinstance(x, warc.Invalid) for x in found] == [True] * len(broken) + [False]
    cut = list(warc.records(pack(good) + pack(good)[:-3]))
    assert len(cut) == 2 and isinstance(cut[1], warc.Invalid)
    assert isinstance(next(warc.records(b"\0" * 40)), warc.Invalid)
    flipped = bytearray(pack(good))
    flipped[-1] ^= 1
    assert isinstance(next(warc.records(bytes(flipped))), warc.Invalid)


@pytest.mark.parametrize(("limit", "broadcast"), [(60, True), (1000, True), (10**9, True), (60, False), (1000, False)])
def test_shards_split_only_where_too_large(spark, docs, monkeypatch, limit, broadcast):
    if not broadcast:
        monkeypatch.setattr(shared, "BROADCAST_BYTES", -1)
    rows = [*ODD, *((100 + i, "x" * (i * 7 % 90)) for i in range(300)), *[(5000, "again")] * 40]
    hashes = [tuple(r) for r in sharding.hashed(docs(rows)).collect()]
    found = sharding.assign(clashing(docs(rows)), limit).collect()
    assert len(found) == len(rows)

    def split(own, depth, bucket):
        if sum(b for *_, b in own) <= limit or len({h for _, h, _ in own}) == 1:
            return {(depth, bucket): own}
        out = {}
        for bit in (0, 1):
            part = [x for x in own if (x[1] & (1 << 64) - 1) >> (63 - depth) & 1 == bit]
            if part:
                out |= split(part, depth + 1, bucket * 2 + bit)
        return out

    want = split(hashes, 0, 0)
    got = defaultdict(list)
    pages = defaultdict(list)
    for r in found:
        got[r.depth, r.bucket].append((r.doc_id, r.bytes))
        pages[r.shard].append(r)
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(((i, b) for i, _, b in v), key=str) for k, v in want.items()}
    for own in pages.values():
        total = sum(r.bytes for r in own)
        assert {r.shard_bytes for r in own} == {total} and (total <= limit or len(own) == 1)
    assert sharding.assign(docs([]), limit).count() == 0


VECTORS = StructType([StructField("vec_id", LongType()), StructField("embedding", ArrayType(FloatType())), StructField("label", LongType())])


def brute_nearest(rows, k):
    usable = {i: np.array(v, np.float64) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    out = {}
    for q in usable:
        if q % 20 == 0:
            scored = sorted((-float(v @ usable[q]), i) for i, v in usable.items() if i != q)[:k]
            out[q] = [(i, -s) for s, i in scored]
    return out


def search(spark, rows, **parameters):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], VECTORS)
    index = ann.build(clashing(df), **parameters)
    out = defaultdict(list)
    for r in sorted(ann.search(index, index.rows.where("vec_id % 20 = 0"), block_queries=8).collect(), key=lambda r: (r.query_id, r.rank)):
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_nearest_recall_and_exact_scores(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(8, 16))
    vectors = (centres[rng.integers(0, 8, 1500)] + rng.normal(size=(1500, 16)) * 0.7) * rng.uniform(0.5, 2, (1500, 1))
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vectors)]
    found, want = search(spark, rows, shard_rows=400), brute_nearest(rows, 20)
    assert found.keys() == want.keys()
    hits = [len({i for i, _ in found[q]} & {i for i, _ in want[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.97
    exact = {q: dict(brute_nearest(rows, len(rows))[q]) for q in list(want)[:10]}
    for q, own in exact.items():
        assert [s for _, s in found[q]] == sorted((s for _, s in found[q]), reverse=True)
        assert all(abs(own[i] - s) < 1e-12 for i, s in found[q])


def test_nearest_with_odd_vectors_and_copies(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=4)]) for i in range(1, 40)]
    rows += [(100 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(60)]
    rows += [(200, None), (201, [0.0] * 4), (202, [None, 1.0, 1.0, 1.0]), (220, [float("nan"), 1.0, 1.0, 1.0]), (240, [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0] * 4)]
    found, want = search(spark, rows, shard_rows=30), brute_nearest(rows, 20)
    assert {q: [i for i, _ in v] for q, v in found.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert search(spark, [(200, None)]) == {}
    assert [i for i, _ in search(spark, [(20, [1.0, 0.0]), (21, [1.0, 1.0]), (21, [1.0, 1.0])])[20]] == [21]


def test_every_node_is_reached():
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.normal(size=(300, 8)) * 0.01 + 100 * c for c in np.eye(8)[:4]]).astype(np.float32)
    graph, entry = ann.build_graph(points)
    seen, front = {entry}, [entry]
    while front:
        front = [x for y in front for x in graph[y].tolist() if x >= 0 and x not in seen and not seen.add(x)]
    assert len(seen) == len(points)


def norms_of(kind, n, rng):
    """Factors of directions: alike, log-normal, spread by ten."""
    return {"unit": np.ones(n), "log": np.exp(0.3 * rng.normal(size=n)), "wide": np.exp(rng.normal(size=n)), "ten": rng.uniform(1, 10, n)}[kind]


@pytest.mark.parametrize("kind", ["unit", "log", "wide", "ten"])
def test_recall_where_norms_vary(kind):
    rng = np.random.default_rng(4)
    n, k = 4000, 20
    vectors = rng.normal(size=(n, 64))
    vectors *= (norms_of(kind, n, rng) / np.linalg.norm(vectors, axis=1))[:, None]
    own = np.arange(0, n, 20)
    found = ann.search_shard(vectors, [np.array([i]) for i in range(n)], ann.index_shard(vectors), own, vectors[own], k)
    scores = vectors @ vectors[own].T
    scores[own, np.arange(len(own))] = -np.inf
    want = np.argsort(-scores, axis=0)[:k].T
    got = defaultdict(set)
    for q, i, s in found:
        got[q].add(i)
        assert abs(s - vectors[q] @ vectors[i]) < 1e-9
    assert np.mean([len(got[q] & set(w.tolist())) / k for q, w in zip(own.tolist(), want, strict=True)]) >= 0.97


def test_other_dimensions_repeated_ids_and_more_neighbours(spark):
    rng = np.random.default_rng(6)
    vector = lambda d: [float(np.float32(x)) for x in rng.normal(size=d)]
    rows = [*((i, vector(4)) for i in range(1, 60)), *((100 + i, vector(3)) for i in range(40)), (7, vector(4)), (120, [1e30, 0.0, 0.0])]
    found = search(spark, rows, shard_rows=16)
    for q in (20, 40, 100, 120):
        own = min(v for i, v in rows if i == q and v)
        scored = sorted((-float(np.dot(v, own)), i) for i, v in rows if i != q and len(v) == len(own))[:20]
        assert [i for i, _ in found[q]] == [i for _, i in scored]
    index = ann.build(spark.createDataFrame([(i, v, 1) for i, v in rows], VECTORS), k=30)
    assert ann.search(index, index.rows.where("vec_id = 20"), k=30).count() == 30
    with pytest.raises(ValueError, match="30"):
        ann.search(index, index.rows, k=31)
