import re
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.llm import components, exact_dedup, simhash

from .conftest import ODD, clashing

SF = "/root/testdata/sf0.001"


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, first = (min(known) if known else None), True
        for i in sorted(ids, key=lambda x: (x is None, x)):
            kept = i == keep and first
            first = first and not kept
            out.append((i, keep, len(ids), kept, sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.unhex(F.lit("00")), lambda t: F.unhex(F.substring(F.sha2(t, 256), 1, 2))])
def test_exact_groups_under_any_digest(spark, docs, digest):
    rows = ODD + [(100 + i, f"text {i % 7}") for i in range(40)]
    found = exact_dedup.groups(clashing(docs(rows)), memtable_rows=5, digest=digest).collect()
    want = brute_exact(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in found), key=str) == sorted((w[:4] for w in want), key=str)
    if digest is exact_dedup.sha256:
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest).hex()) for r in found), key=str) == want


def test_exact_drop_keeps_one_row_and_all_columns(spark, docs):
    df = clashing(docs(ODD))
    kept = exact_dedup.drop_duplicates(df)
    assert kept.columns == df.columns
    want = sorted((w[0] for w in brute_exact(ODD) if w[3]), key=str)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == want
    assert exact_dedup.drop_duplicates(docs([])).count() == 0
    assert exact_dedup.groups(docs([])).count() == 0


def test_runs_are_sorted_and_answer_lookups(spark, docs):
    entries = exact_dedup.flush(docs([(i, f"t{i % 9}") for i in range(50)]), 4)
    for part in entries.rdd.mapPartitions(lambda it: [[(r.run, bytes(r.digest), r.doc_id) for r in it]]).collect():
        assert part == sorted(part)
    assert exact_dedup.lookup(entries, [sha256(b"t3").digest()]).count() == 6


def brute_fingerprint(text):
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(ids, fps, distance=4):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(x, least.get(find(i), x))
    return [least.get(find(i)) for i in range(len(ids))]


@pytest.mark.parametrize("bucket_rows", [4096, 2])
def test_simhash_matches_brute_force(spark, docs, bucket_rows):
    base = "the quick brown fox jumps over the lazy dog and then it runs far away from here to there " * 12
    words = base.split()
    rows = [(500 + i, " ".join([*words[:i], "changed", *words[i + 1 :]])) for i in range(0, 60, 2)]
    rows += [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = [(i + 1000, t) for i, t in rows] + ODD
    found = sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(clashing(docs(rows)), bucket_rows=bucket_rows).collect()), key=str)
    fps = [brute_fingerprint(t) for _, t in rows]
    want = list(zip([i for i, _ in rows], fps, brute_components([i for i, _ in rows], fps), strict=True))
    assert found == sorted(want, key=str)


def test_links_connect_all_close_fingerprints(spark):
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 1 << 63, 30)
    fps = {int(c) for c in centres}
    for c in centres:
        x = int(c)
        for _ in range(40):
            for b in rng.choice(63, rng.integers(1, 4), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    got = {r.node: r.root for r in components.components(simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), bucket_rows=16)).collect()}
    want = brute_components(fps, fps)
    roots = {x: min(y for y, w in zip(fps, want, strict=True) if w == c) for x, c in zip(fps, want, strict=True)}
    assert {x: got.get(x, x) for x in fps} == roots


def test_more_blocks_for_more_fingerprints():
    for n in (10, 10**5, 10**8, 10**12):
        masks = simhash.block_masks(n)
        assert min((m & (1 << 64) - 1).bit_count() for m in masks) >= min(40, np.log2(n))
        assert len(masks) < 1100


def test_simhash_drop(spark, docs):
    text = " ".join(f"w{i}" for i in range(300))
    kept = simhash.drop_near_duplicates(clashing(docs([(3, text), (2, text + " more"), (9, "something else entirely here"), (None, text)])))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 9]
    assert simhash.drop_near_duplicates(docs([])).count() == 0


def test_simhash_drop_keeps_one_row_of_each_component(spark, docs):
    def text(k):
        return " ".join(f"{k}x{i}" for i in range(300))

    near = {k: text(k) + " more" for k in "abcd"}
    assert all(0 <= bin((simhash.fingerprint(text(k)) ^ simhash.fingerprint(near[k])) & (1 << 64) - 1).count("1") <= 4 for k in "abcd")
    rows = [(3, text("a")), (None, near["a"]), (None, text("e")), (None, text("f"))]  # unrelated texts with null ids stay
    rows += [(2, text("b")), (7, near["b"]), (7, text("g"))]  # two texts under one id: only the near copy goes
    rows += [(None, text("c")), (None, near["c"]), (None, text("c"))]  # all ids null: one row stays
    rows += [(5, text("d")), (5, near["d"]), (5, text("d"))]
    kept = [(r.doc_id, r.text) for r in simhash.drop_near_duplicates(clashing(docs(rows))).collect()]
    sole = {(3, text("a")), (None, text("e")), (None, text("f")), (2, text("b")), (7, text("g"))}
    assert sole <= set(kept) and len(kept) == 7
    assert sorted(((i, t[0]) for i, t in set(kept) - sole), key=str) == [(5, "d"), (None, "c")]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100)}


def test_a_run_is_one_file(spark, docs):
    entries = exact_dedup.flush(docs([(i, f"text {i % 50}") for i in range(300)]), 7)
    per_file = entries.groupBy(F.input_file_name().alias("file")).agg(F.countDistinct("run").alias("runs")).collect()
    assert [r.runs for r in per_file] == [1] * 7 and entries.select("run").distinct().count() == 7
