"""Periodic runs, licence scans and tokeniser alignment against brute force, on hard texts and on whole tables."""

import random
import re
import time
from collections import Counter, defaultdict
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratalens.llm import alignment, bpe, licenses, queries, runs

from .conftest import ODD, clashing
from .test_text import STRANGE

SF = "/root/testdata/sf0.001"
A, B = queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


# periodic runs


def brute_runs(w):
    """Every period from 1 on, one scan each."""
    w = np.unique(np.array(w, object), return_inverse=True)[1] if len(w) else np.zeros(0, int)
    found = []
    for q in range(1, len(w) // 4 + 1):
        same = np.concatenate(([False], w[:-q] == w[q:], [False]))
        edges = np.flatnonzero(np.diff(same.astype(int)))
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            length = end + q - start
            if length >= max(6, 4 * q) and not any(q % p == 0 and np.array_equal(w[start : end + q - p], w[start + p : end + q]) for p in range(1, q)):
                found.append((start, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(w, found):
    gone = {i for start, length, q in found for i in range(start + q, start + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def repetitive(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        letters, words = rng.choice([1, 2, 2, 3, 5, 50]), []
        while len(words) < rng.randint(0, 150):
            part = [rng.randrange(letters) for _ in range(rng.randint(1, 14))]
            words += (part * rng.randint(1, 8))[: rng.randint(1, 90)]
        yield [f"w{x}" for x in words]


def test_runs_of_repetitive_texts():
    texts = list(repetitive(1, 2500))
    found, collapsed = runs._chunk(pa.array([" ".join(w) for w in texts]))
    total = 0
    for w, got, rest in zip(texts, found.to_pylist(), collapsed.to_pylist(), strict=True):
        want = brute_runs(w)
        total += len(want)
        assert [(r["start"], r["length"], r["period"]) for r in got] == want
        assert rest == collapse(w, want)
    assert total > 1000


def test_runs_of_long_texts_take_no_square():
    fib = [["0"], ["0", "1"]]
    while len(fib[-1]) < 30_000:
        fib.append(fib[-1] + fib[-2])
    rng = random.Random(2)
    cases = [["a"] * 100_000, ["a", "b"] * 50_000, (["a"] * 3000 + ["b"]) * 12, [str(i // 6) for i in range(60_000)], fib[-1], [str(rng.randrange(2000)) for _ in range(12_000)] * 8]
    began = time.perf_counter()
    found, _ = runs._chunk(pa.array([" ".join(w) for w in cases]))
    assert time.perf_counter() - began < 60
    assert [len(x) for x in found.to_pylist()] == [1, 1, 13, 10_000, 0, 1]


def test_runs_odd_rows(spark, docs):
    got = Counter((r.doc_id, tuple(map(tuple, r.runs)), r.collapsed) for r in runs.find(clashing(docs(ODD))).collect())
    assert got == Counter((i, tuple(brute_runs(split(t or ""))), collapse(split(t or ""), brute_runs(split(t or "")))) for i, t in ODD if len(t or "") < 1000) + Counter(
        [(7, ((0, 30_000, 1),), "word"), (8, ((0, 30_000, 1),), "word end")]
    )
    assert runs.find(docs([])).collect() == []


def test_runs_query(spark, documents):
    found = {r.doc_id: r for r in queries.op11_runs(spark, SF).collect()}
    assert found.keys() == {i for i, _ in documents}
    planted = 0
    for i, text in documents:
        w = split(text)
        h, n = crc32(str(i).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (k - a) % p] if k >= a else w[k] for k in range(n)]
        own = brute_runs(w)
        planted += bool(own)
        top = max(own, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        want = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
        r = found[i]
        assert (r.n_runs, (r.start, r.length, r.period, r.exponent_milli)) == (len(own), want)
        assert r.runs_sha256 == sha256("".join(f"{s},{k},{q}\n" for s, k, q in own).encode()).hexdigest()
        assert r.collapsed_sha256 == sha256(collapse(w, own).encode()).hexdigest()
    assert planted > 10


def test_planted_null_ids(spark, docs):
    assert [r.text for r in queries.planted(docs([(None, "a b c"), (None, None)])).collect()] == ["a b c", None]


# licence scans


def license_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))


def brute_places(text):
    w = license_words(text)
    return sorted((k, label) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())


def test_matching_statistics():
    rng = random.Random(3)
    for _ in range(200):
        sequences = [[rng.randrange(3) for _ in range(rng.randint(1, 12))] for _ in range(rng.randint(1, 4))]
        machine, pieces = licenses.Automaton(sequences), defaultdict(set)
        for nth, s in enumerate(sequences):
            for i in range(len(s)):
                for j in range(i + 1, len(s) + 1):
                    pieces[tuple(s[i:j])].add((nth, j))
        text = [rng.randrange(4) for _ in range(40)]
        state = length = 0
        for k, word in enumerate(text):
            while state and word not in machine.next[state]:
                state = machine.link[state]
                length = machine.length[state]
            if word in machine.next[state]:
                state, length = machine.next[state][word], length + 1
            want = max((n for n in range(k + 2) if n == 0 or tuple(text[k + 1 - n : k + 1]) in pieces))
            assert length == want
            if length:
                assert set(machine.places[state]) == pieces[tuple(text[k + 1 - length : k + 1])]


def test_phrases_of_hard_texts():
    rng = random.Random(4)
    parts = ["cc", "by", "CC BY", "general", "public", "license", "All Rights", "reserved", "GNU General Public License", "all", "rights", " ", "-", "é", "cc by", "\x00", "by4", "the", "released under", "K"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", "\n", ", "]) for _ in range(rng.randint(0, 25))) for _ in range(2000)]
    scanner = licenses.Scanner(tuple(licenses.TEMPLATES), tuple(licenses.PHRASES.items()))
    n, places, _, score = scanner.scan(pa.array(texts))
    for text, count, own, s in zip(texts, n.tolist(), places, score, strict=True):
        assert count == len(license_words(text))
        assert [(p["word"], p["label"]) for p in own] == brute_places(text)
        assert (s == 1) >= bool(own) and 0 <= s <= 1


def labels_of(spark, docs, texts):
    rows = licenses.scan(docs(list(enumerate(texts)))).collect()
    return {r.doc_id: ({x.label for x in r.spans}, r.score) for r in rows}


def test_templates_with_changes(spark, docs):
    grant = dict(licenses.TEMPLATES[::-1])["isc"].split()
    texts = [
        "Some words. " + dict(licenses.TEMPLATES)["mit"] + " More.",
        " ".join(w for k, w in enumerate(grant) if k % 9 != 5),  # words left out
        " ".join(grant[:20]),  # too little of it
        "the name of the public and the software of this license is in the version",
        "Licensed under CC BY-NC 4.0. Later: released under the MIT License.",
    ]
    got = labels_of(spark, docs, texts)
    assert got[0][0] == {"mit"} and got[0][1] == 1
    assert got[1][0] == {"isc"} and 0.75 <= got[1][1] < 1
    assert got[2][0] == set() and 0.4 < got[2][1] < 0.75
    assert got[3][0] == set() and got[3][1] < 0.2
    assert got[4][0] == {"cc-by-nc-4.0", "mit"}


def test_each_template_is_found_whole():
    scanner = licenses.Scanner(tuple(licenses.TEMPLATES), tuple(licenses.PHRASES.items()))
    _, _, spans, score = scanner.scan(pa.array([f"before this {x}, after that" for _, x in licenses.TEMPLATES]))
    for (label, _), own, s in zip(licenses.TEMPLATES, spans, score, strict=True):
        assert label in {x["label"] for x in own} and s == 1


def test_repeated_notices_stay_linear():
    scanner = licenses.Scanner(tuple(licenses.TEMPLATES), tuple(licenses.PHRASES.items()))
    began = time.perf_counter()
    _, places, spans, _ = scanner.scan(pa.array(["All rights reserved. Released under the MIT License. " * 20_000]))
    assert len(places[0]) == len(spans[0]) == 20_000 and time.perf_counter() - began < 20


def test_licenses_odd_rows(spark, docs):
    rows = licenses.scan(clashing(docs(ODD))).collect()
    assert Counter((r.doc_id, r.n_words) for r in rows) == Counter((i, len(license_words(t or ""))) for i, t in ODD)
    assert all(r.places == r.spans == [] and r.score == 0 for r in rows)
    assert licenses.scan(docs([])).collect() == []


def test_licenses_query(spark, documents):
    found = {r.doc_id: r for r in queries.op12_licenses(spark, SF).collect()}
    assert found.keys() == {i for i, _ in documents}
    for i, text in documents:
        own, r = brute_places(text), found[i]
        base = sorted({label for _, label in own})
        assert (r.n_words, r.n_base, r.base_labels) == (len(license_words(text)), len(own), ",".join(base))
        assert (r.first_word, r.last_word) == ((own[0][0], own[-1][0]) if own else (None, None))
        assert r.labels.split(",") == sorted(set(r.labels.split(","))) and set(base) <= set(r.labels.split(",")) | {""}


# tokeniser alignment


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B)


def brute_alignment(libraries, text):
    """ids, minimal groups and links, all pairs of overlapping ranges; None where there are no tokens."""
    a, b = libraries
    of_symbol = {c: i for i, c in enumerate(bpe.byte_symbols())}
    if not text:
        return None
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(of_symbol[c] for c in a.id_to_token(i)) for i in ids_a]
    names = [b.id_to_piece(i) for i in ids_b]
    bytes_b = [bytes([int(x[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", x) else x.replace("▁", " ").encode() for x in names]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return None
    ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]), np.cumsum([len(x) for x in bytes_b])
    cuts = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
    of = lambda ids, ends, low, high: ",".join(str(i) for i, e in zip(ids, ends.tolist(), strict=True) if low < e <= high)
    said = ";".join(f"{of(ids_a, ends_a, x, y)}|{of(ids_b, ends_b, x, y)}" for x, y in zip([0, *cuts], cuts, strict=False))
    starts_a, starts_b = np.append(0, ends_a[:-1]), np.append(0, ends_b[:-1])
    linked = np.maximum(starts_a[:, None], starts_b) < np.minimum(ends_a[:, None], ends_b)
    return len(ids_a), len(ids_b), len(cuts), said, [(ids_a[x], ids_b[y]) for x, y in np.argwhere(linked)]


def brute_rows(libraries, rows):
    own = [brute_alignment(libraries, t) for _, t in rows]
    count, highest = Counter(p for x in own if x for p in x[4]), Counter()
    for (_, b), n in count.items():
        highest[b] = max(highest[b], n)
    out = []
    for (i, _), x in zip(rows, own, strict=True):
        if x is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            links = x[4]
            out.append((i, *x[:3], len(links), sum(count[p] == highest[p[1]] for p in links), sum(count[p] for p in links), sha256(x[3].encode()).hexdigest()))
    return Counter(out)


def hard(n, seed):
    rng = random.Random(seed)
    more = [*STRANGE, "<s>", "</s>", "<unk>", "▁", " a", " b ", " the", " é", " 日", "\x00", "<0x0A>", "é a", " ", "ﬁ"]
    return ["".join(rng.choice(more) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_alignment_of_hard_texts(spark, docs, libraries):
    rows = [(i, t) for i, t in ODD if len(t or "") < 1000] + [(1000 + i, t) for i, t in enumerate(hard(800, 5))]
    assert Counter(map(tuple, alignment.align(clashing(docs(rows)), A, B).collect())) == brute_rows(libraries, rows)


def test_alignment_without_broadcast(spark, docs, libraries, monkeypatch):
    monkeypatch.setattr(alignment.shared, "BROADCAST_BYTES", 0)
    rows = [(i, t) for i, t in enumerate(hard(200, 6))]
    assert Counter(map(tuple, alignment.align(docs(rows), A, B).collect())) == brute_rows(libraries, rows)


def test_alignment_forgets_and_long_texts(monkeypatch, libraries):
    monkeypatch.setattr(alignment, "MOST_BYTES", 2000)
    with open(B, "rb") as file:
        here = alignment.Aligner(bpe.read_spec(A), file.read())
    texts = [*hard(150, 7), "x" * 20_000, "ab é" * 3000]
    for text in texts:
        totals, said, *_ = here.texts(pa.array([(" " + text).encode() if text else None], pa.binary()))
        want = brute_alignment(libraries, text) if len(text) < 1000 else None
        if want:
            assert (*totals[:3, 0].tolist(), said[0].as_py()) == want[:4]
    assert totals[0, 0] > 3000


def test_union_find():
    rng = np.random.default_rng(8)
    for n in (1, 5, 50, 500):
        u, v = rng.integers(0, n, (2, n))
        got, label = alignment.union_find((u, v), n), np.arange(n)
        for _ in range(n):
            for x, y in zip(u, v, strict=True):
                label[label == max(label[x], label[y])] = min(label[x], label[y])
        assert np.array_equal(got, label)
    chain = np.arange(100_000)
    assert not alignment.union_find((chain[:-1], chain[1:]), 100_000).any()


def test_alignment_empty(spark, docs):
    assert alignment.align(docs([]), A, B).collect() == []


def test_alignment_query(spark, documents, libraries):
    assert Counter(map(tuple, queries.op13_alignment(spark, SF).collect())) == brute_rows(libraries, documents)


def test_groups_are_the_texts_tokens(spark, docs):
    r = alignment.groups(docs([(1, "tokenisation of words")]), A, B).select("groups", F.size("pairs").alias("n")).first()
    assert r.groups.count(";") >= 2 and r.n > 2
