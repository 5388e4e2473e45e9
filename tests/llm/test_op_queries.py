"""Each registered query of the ten operators over whole tables, against brute force, SQL or the library."""

from collections import Counter, defaultdict
from hashlib import sha256
from pathlib import Path
from zlib import crc32

import duckdb
import numpy as np
import pytest

from stratalens.llm import packing, pii, queries, sharding

from .test_dedup import brute_components, brute_fingerprint
from .test_stores import brute_nearest
from .test_text import BYTE, WORD, brute_spans, library

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, SF).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)


@pytest.mark.parametrize(("name", "modulus", "value"), [("op1_quality", 3, 1), ("op7_toxicity", 5, 0)])
def test_scores(spark, documents, name, modulus, value):
    rows = queries.QUERIES[name](spark, SF).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in documents)
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % modulus == value) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_pii(spark, documents):
    found = {r.doc_id: r for r in queries.op3_pii(spark, SF).collect()}
    assert found.keys() == {i for i, _ in documents}
    for i, text in documents:
        base, r = brute_spans(text), found[i]
        counts = Counter(k for *_, k in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(counts[k] for k in range(4))
        assert r.base_sha256 == sha256(pii.written(base).encode()).hexdigest()
        assert set(filter(None, pii.written(base).split(","))) <= set(r.spans.split(","))


def test_simhash(spark, documents):
    ids = [i for i, _ in documents]
    fps = [brute_fingerprint(t) for _, t in documents]
    want = {i: (f"{fp & (1 << 64) - 1:016x}", c) for i, fp, c in zip(ids, fps, brute_components(ids, fps), strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op4_simhash(spark, SF).collect()} == want


def test_packing(spark, documents):
    tok, want = library(WORD), Counter()
    for i, t in documents:
        ids = [*tok.encode(t, add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            want[i, k // 2048, k, len(ids[k : k + 2048]), crc32(np.array(ids[k : k + 2048], "<u4").tobytes())] += 1
    found = queries.op5_packing(spark, SF).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    bins = defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        own.sort()
        assert [a for a, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= packing.CAPACITY
    assert len(bins) <= -(-sum(r.length for r in found) // packing.CAPACITY) + 1


def test_sharding(spark, documents):
    found = queries.op6_sharding(spark, SF).collect()
    assert sorted((r.doc_id, r.bytes) for r in found) == sorted((i, len(t.encode()) + sharding.ROW_BYTES) for i, t in documents)
    total = Counter()
    for r in found:
        total[r.shard] += r.bytes
    assert all(r.shard_bytes == total[r.shard] <= sharding.SHARD_BYTES for r in found)


def test_bpe(spark, documents):
    tok = library(BYTE)
    found = {r.doc_id: r for r in queries.op8_bpe(spark, SF).collect()}
    assert found.keys() == {i for i, _ in documents}
    for i, t in documents:
        ids = tok.encode(t, add_special_tokens=False).ids
        want = (len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert (found[i].n_tokens, found[i].ids_sha256, found[i].decoded_sha256) == want


def test_nearest(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want, found = brute_nearest(rows, 20), defaultdict(list)
    for r in sorted(queries.op10_ann(spark, SF).collect(), key=lambda r: (r.query_id, r.rank)):
        found[r.query_id].append((r.vec_id, r.score))
    assert found.keys() == want.keys() and all(len(found[q]) == 20 for q in want)
    assert np.mean([len({i for i, _ in found[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.97
    vectors = {i: np.array(v, np.float64) for i, v in rows}
    assert all(abs(vectors[q] @ vectors[i] - s) < 1e-12 for q, own in found.items() for i, s in own)
