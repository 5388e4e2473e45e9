import random
import re
import time
from collections import Counter, defaultdict
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from stratalens.llm import bpe, packing, pii, quality, queries, toxicity, words

from .conftest import ODD, clashing

SF = "/root/testdata/sf0.01"
BYTE, WORD = queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("word_bpe_49k.json")
STRANGE = [*"abcAÉ \n\t\r\x0b\x1c\x85  　'stdvml012²½٣日éÀ×_-$<|>́​\U0001F600ΣσİǅÅ", "<|endoftext|>", "'s", "'re", "   ", "aaaa"]


def strange(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(STRANGE) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


# byte-level BPE


def test_bpe_equals_the_library(spark, docs):
    rows = [*ODD, *((1000 + i, t) for i, t in enumerate(strange(1500)))]
    tok = library(BYTE)
    want = []
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    df = clashing(docs(rows))
    assert sorted(map(tuple, bpe.round_trip(df, BYTE).collect()), key=str) == sorted(want, key=str)
    encoded = bpe.encode(df, BYTE)
    assert sorted((r.doc_id, len(r.ids)) for r in encoded.where("doc_id is not null").collect()) == sorted(w[:2] for w in want if w[0] is not None)
    back = {r.doc_id: r.text for r in bpe.decode(encoded, BYTE).collect() if r.doc_id is not None}
    assert back == {i: t or "" for i, t in rows if i is not None}
    assert bpe.round_trip(docs([]), BYTE).count() == 0


def test_bpe_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 50)
    monkeypatch.setattr(bpe, "BATCH_CHARS", 100)
    codec, tok, texts = bpe.Codec(bpe.read_spec(BYTE)), library(BYTE), strange(400, 2) + ["x" * 500]
    assert list(codec.encode(texts)) == [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert all(len(w) <= bpe.CACHE_CHARS for w in codec.known)


def test_bpe_ranks_ascend_where_products_rank_below_their_parts():
    vocab = {s: i for i, s in enumerate(bpe.byte_symbols())} | {"ab": 256, "bc": 257, "abc": 258, "abab": 259}
    import json

    spec = json.dumps({"model": {"vocab": vocab, "merges": [["ab", "ab"], ["a", "b"], ["b", "c"], ["ab", "c"]]}, "added_tokens": []})
    assert bpe.Codec(spec).encode_words(["ababc", "abc", "bc", "aab"]) == [[259, vocab["c"]], [258], [257], [vocab["a"], 256]]


# packing


@pytest.mark.parametrize("known", [True, False])
def test_word_ids_equal_the_library(monkeypatch, known):
    monkeypatch.setattr(words, "CHUNK_BYTES", 300)
    monkeypatch.setattr(words, "LOOK_UP_WORDS", 7)
    own, tok = words.Tokens(bpe.read_spec(WORD)), library(WORD)
    if not known:
        own.merges = None  # as for a vocabulary with another split: the library alone
    texts = [*strange(3000, 3), "Don't STOP ertzge,&&&\x0bx" * 5, "y" * 999, None, "", "ÀÉÞß×÷ÿ ÀÉ'S ab12cd <|endoftext|>x", " \t\n"]
    found = [ids[a:b].tolist() for ids, bounds in own.encode(pa.array(texts)) for a, b in zip(bounds, bounds[1:], strict=False)]
    assert found == [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert list(own.encode(pa.array([], pa.string()))) == []


def test_word_ids_of_slices_and_bytes_that_are_no_text():
    own, tok = words.Tokens(bpe.read_spec(WORD)), library(WORD)
    whole = pa.array(["one two", "drei ß vier", None, "x" * 70, "five"])
    (ids, bounds), = own.encode(whole.slice(1, 3))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [tok.encode(t or "", add_special_tokens=False).ids for t in whole.slice(1, 3).to_pylist()]
    broken = [b"ab\xc3 \x97x", b"\xff\xfe a", b"\xc3"]
    (ids, bounds), = own.encode(pa.array(broken))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [tok.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids for t in broken]


def brute_best(lengths, counts, room):
    best = {0}
    for length in lengths:
        for _ in range(counts[length]):
            best |= {b + length for b in best if b + length <= room}
    return max(best)


def test_fullest_is_the_fullest():
    rng = random.Random(0)
    for _ in range(300):
        counts = {rng.randint(1, 40): rng.randint(1, 4) for _ in range(rng.randint(0, 7))}
        lengths, room = sorted(counts, reverse=True), rng.randint(0, 70)
        chosen = packing.fullest(lengths, counts, room)
        assert all(0 < n <= counts[k] for k, n in chosen.items())
        assert sum(k * n for k, n in chosen.items()) == brute_best(lengths, counts, room)


def test_plan_uses_every_piece_once():
    rng = random.Random(5)
    for capacity in (1, 10, 64):
        histogram = {rng.randint(1, capacity): rng.randint(1, 50) for _ in range(12)}
        used = Counter()
        for pattern, times in packing.plan(histogram, capacity):
            assert sum(k * n for k, n in pattern.items()) <= capacity
            used.update({k: n * times for k, n in pattern.items()})
        assert used == Counter(histogram)
    assert packing.plan({}) == []


@pytest.mark.parametrize("capacity", [7, 2048])
def test_packing_places_all_tokens(spark, docs, capacity):
    rows = [*ODD, *((1000 + i, f"some words {'here ' * (i % 11)}") for i in range(200))]
    tok = library(WORD)
    found = packing.pack(clashing(docs(rows)), WORD, capacity).collect()
    want = Counter()
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            want[i, k // capacity, k, len(part), crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    bins = defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) <= -(-sum(r.length for r in found) // capacity) * 1.15 + 1
    assert packing.pack(docs([]), WORD).count() == 0


# personal data

EMAIL, IP, CARD, PHONE = (re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"))


def brute_spans(t):
    out = [(m.start(), m.end(), 0) for m in EMAIL.finditer(t)]
    out += [(m.start(), m.end(), 1) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), m.end(), 2))
    out += [(m.start(), m.end(), 3) for m in PHONE.finditer(t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_plain_spans_equal_the_patterns():
    rng = random.Random(3)
    pool = [*"ab.%+-@@0123456789  ()é-..+", "@x.y", "1.2.3.4", "4111 1111 1111 1111", "+1 (555) 123-4567"]
    for _ in range(8000):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 40)))
        assert pii.plain_spans(text) == brute_spans(text), text


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("mail john (at) mail (dot) com now", "email", "john (at) mail (dot) com"),
        ("to bob at mail dot example dot org!", "email", "bob at mail dot example dot org"),
        ("jo[at]mail7.example.com", "email", "jo[at]mail7.example.com"),
        ("see jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("j​o@ma​il.com", "email", "j​o@ma​il.com"),
        ("card ４１１１ 1111 1111 1111 x", "card", "４１１１ 1111 1111 1111"),
        ("pay four one one one one one one one one one one one one one one one end", "card", "four one one one one one one one one one one one one one one one"),
        ("call plus one five five five one two three four five six seven ok", "phone", "plus one five five five one two three four five six seven"),
        ("ip one nine two dot one six eight dot zero dot one.", "ip", "one nine two dot one six eight dot zero dot one"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, span):
    base, found = pii.spans(text)
    assert set(base) <= set(found)
    assert (text.index(span), text.index(span) + len(span), pii.KINDS.index(kind)) in found
    assert pii.masked(text) == text.replace(span, f"<{kind.upper()}>")


def test_clean_texts_stay_and_hard_ones_end(spark):
    for t in ("", "One two three and four.", "Meet at noon. The dot is red (at last).", "éß ñandú Ærø 3 x 4", "x" * 10_000):
        assert pii.spans(t) == ([], [])
    for t in ("a" * 200_000 + "@", "1" * 200_000 + " @", "+1" + "(" * 200_000, "zero " * 40_000, "a at " * 40_000 + " dot ", "a." * 100_000 + " dot @"):
        pii.spans(t)


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("to bob at example [dot] com now", "email", "bob at example [dot] com"),
        ("to bob at mail.example (dot) com now", "email", "bob at mail.example (dot) com"),
        ("to bob at example。com now", "email", "bob at example。com"),
        ("to bob@mail.example dot com now", "email", "bob@mail.example dot com"),
        ("to bob@example punkt de now", "email", "bob@example punkt de"),
        ("to bob (at) example punto com now", "email", "bob (at) example punto com"),
        ("to bob at example dot com dot now", "email", "bob at example dot com"),
        ("host 192 dot 168 dot 0 dot 1 is up", "ip", "192 dot 168 dot 0 dot 1"),
        ("host 192.168.zero.one is up", "ip", "192.168.zero.one"),
        ("host 192.168.0.¹ is up", "ip", "192.168.0.¹"),
        ("call +1 555 123 45 six seven today", "phone", "+1 555 123 45 six seven"),
        ("call +1 (555) one two three 4567 today", "phone", "+1 (555) one two three 4567"),
        ("pay 4111 1111 1111 one one one one end", "card", "4111 1111 1111 one one one one"),
        ("item 7, four one one one one one one one one one one one one one one one end", "card", "four one one one one one one one one one one one one one one one"),
    ],
)
def test_mixed_disguises_are_found(text, kind, span):
    assert (text.index(span), text.index(span) + len(span), pii.KINDS.index(kind)) in pii.spans(text)[1]
    assert pii.masked(text) == text.replace(span, f"<{kind.upper()}>")


def test_mixed_runs_leave_prose_alone_and_end():
    for t in ("look at example.com (today)", "In 2019 two of 12, one dot.", "1 2 3 4 5 6 7 8 9 10 11 12 13", "see º and ª, m² at noon"):
        assert pii.spans(t) == ([], [])
    for t in ("1 " * 100_000 + "one", "12 dot " * 40_000, "+" * 200_000, "a at b." * 40_000 + " dot ", "plus " * 50_000, "1(" * 100_000, "1" * 200_000):
        pii.spans(t)
    assert all(pii.STRANGE.match(c) for c in map(chr, range(256)) if pii.plain_char(c) != c)


PROSE = """
Look at this point in time and you will see. | We arrived at that point and left. | Stop at mile point two. | They met at noon and parted at dusk.
She pointed at the dot on the map. | He laughed at every dot com joke. | Look at the dot com boom. | At one point we had two of them. | The train stops at platform nine at seven.
Meet me at the point where the rivers join. | I looked at point four and point five. | In 1999 the dot com bubble grew. | They were at war for ten years. | Aim at the red dot on the wall.
At some point in the story he leaves. | Call at six or at seven. | The house at number one is old. | We are at a low point of the year. | He was good at maths and at music.
The answer is three point one four. | It costs nine point five dollars. | Look at example.com for more. | The meeting is at 10.30 in room 2.1. | Version 1.2.3 came out in 2019.
One two three four, said the child. | Seven eight nine ten, ready or not. | Two plus two is four. | Add one plus one plus one. | The score was three to one at half time.
Die Uhr steht auf Punkt zwölf. | Er kam Punkt acht an. | Auf den Punkt gebracht ist es gut. | Der Punkt am Ende fehlt. | Sie hat null Punkte bekommen.
Eins zwei drei vier, alles muss versteckt sein. | Das Spiel endete drei zu eins. | An diesem Punkt ist Schluss. | Um Punkt drei beginnt der Film. | Ein Punkt und ein Komma.
Er wohnt im Haus Nummer sieben. | Die acht Kinder und neun Hunde schlafen. | Wir sind um sechs da. | Zwei plus zwei ist vier. | Es war einmal ein König.
Das kostet 12,50 Euro und mehr. | Am 24.12.2020 war es kalt. | Seite 3 von 10 ist leer. | Er sagte nein und ging. | Die Straße ist lang.
À ce point il part. | Le point de départ est ici. | Un point commun entre nous. | Il est sept heures et quart. | Un deux trois soleil.
Le chat a neuf vies. | Huit plus un font neuf. | Il habite au numéro sept. | À quel point est-ce vrai ? | Le score est de trois à un.
Point de salut hors de là. | Mettre les points sur les i. | Au point du jour il se lève. | Elle a six ans et demi. | Le prix est de 12,50 euros.
C'est le 14.07.1789 que tout commence. | La page 4 sur 12 manque. | Il pleut sur la ville. | Le zéro et le un suffisent. | Quatre fois cinq font vingt.
En este punto se detiene. | Un punto de vista distinto. | A las ocho en punto. | El punto y la coma. | Uno dos tres cuatro, dijo.
Siete más uno son ocho. | Tiene nueve gatos y seis perros. | El partido acabó tres a uno. | Vive en el número cinco. | Punto por punto lo explicó.
Hasta cierto punto es verdad. | Cuesta 12,50 euros y nada más. | El 12.10.1492 fue viernes. | La página 5 de 20 está rota. | Cero y uno bastan.
Look (at last) at the sky. | See [1] and [2] for details. | f(x) = {a, b} and <at> most. | The list [at] the end is short. | A dot (.) ends it.
"""


def test_ordinary_sentences_hold_nothing():
    sentences = [x.strip() for line in PROSE.strip().splitlines() for x in line.split("|")]
    assert len(sentences) >= 85
    assert [x for x in [*sentences, " ".join(sentences)] if pii.spans(x) != ([], [])] == []


@pytest.mark.parametrize("text", ["(" + " " * 200_000 + "x", "[at" + " \t" * 100_000, " " * 200_000 + "(dot)", "( " * 100_000, "(at)" + " " * 200_000 + "(dot)"])
def test_long_blanks_take_linear_time(text):
    began = time.perf_counter()
    pii.spans(text)
    assert time.perf_counter() - began < 1


def test_pii_tables(spark, docs):
    rows = [*ODD, (50, "a@b.co, +1 (555) 123-4567 and 10.0.0.1"), (51, "x (at) y (dot) org")]
    found = {r.doc_id: r for r in pii.find(clashing(docs(rows))).where("doc_id is not null").collect()}
    assert found[50].spans == "email:0:6,phone:8:25,ip:30:38" and (found[50].n_email, found[50].n_ip, found[50].n_card, found[50].n_phone) == (1, 1, 0, 1)
    assert found[51].spans == "email:0:18" and found[51].n_email == 0 and found[51].base_sha256 == sha256(b"").hexdigest()
    masked = pii.mask(clashing(docs(rows)))
    assert masked.columns == clashing(docs(rows)).columns and masked.count() == len(rows)
    assert {r.doc_id: (r.text, r.n_chars) for r in masked.where("doc_id in (1, 2, 51)").collect()} == {1: (None, None), 2: ("", 0), 51: ("<EMAIL>", 7)}


# classifiers


def auc(pairs):
    ranked = sorted(pairs)
    positive = sum(y for _, y in ranked)
    return (sum(i for i, (_, y) in enumerate(ranked) if y) - positive * (positive - 1) / 2) / (positive * (len(ranked) - positive))


@pytest.mark.parametrize(("module", "label", "least"), [(quality, "quality", 0.9), (toxicity, "toxic", 0.85)])
def test_held_out_ranking_and_odd_rows(spark, docs, module, label, least):
    sf = SF.replace("0.01", "0.1")
    table, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = module.learn(table, labels)
    found = module.score(table.drop("lang", "source"), model).join(labels, "doc_id").where("held_out").select("doc_id", "score", "predicted", label).collect()
    assert auc([(r.score, r[label]) for r in found]) > least
    assert np.mean([r.predicted == r[label] for r in found]) > 0.94
    for r in found[:200]:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert crc32(str(r.doc_id).encode()) % module.MODULUS == module.HELD_OUT
    odd = module.score(clashing(docs(ODD)), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    assert len({r.score for r in odd if r.doc_id in (1, 2)}) == 1


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_held_out_labels_are_never_used(spark, docs, module, label):
    rows = [(i, f"good text number {i} with words" if i % 2 else f"bad idiot &&& {i} ###") for i in range(120)]
    good = [(i, i % 2 if label == "quality" else 1 - i % 2) for i in range(120)]
    flipped = [(i, 1 - y if crc32(str(i).encode()) % module.MODULUS == module.HELD_OUT else y) for i, y in good]
    schema = f"doc_id long, {label} int"
    models = [module.learn(docs(rows), spark.createDataFrame([*x, (None, 1), (5, None)], schema)) for x in (good, flipped)]
    assert models[0] == models[1]


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_without_labels(spark, docs, module, label):
    model = module.learn(docs(ODD), spark.createDataFrame([], f"doc_id long, {label} int"))
    found = module.score(docs(ODD), model).collect()
    assert len(found) == len(ODD)
    if module is toxicity:
        assert not any(r.predicted for r in found)
        assert toxicity.drop_toxic(clashing(docs(ODD)), model).count() == len(ODD)
    assert module.score(docs([]), model).count() == 0


def test_non_negative_risk_finds_the_words():
    rng = random.Random(0)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    text = lambda toxic: " ".join([*rng.choices(vocabulary, k=40), *(["vile"] if toxic else [])])
    positive, unlabelled = [text(True) for _ in range(60)], [text(i % 10 == 0) for i in range(400)]
    model = toxicity.fit(positive, unlabelled, 0.1)
    score = lambda t: model.bias + sum(model.weights.get(f, 0) for w in toxicity.words(t) for f in toxicity.features(w))
    assert score(text(True)) > 0 > score(text(False))


@pytest.mark.parametrize("text", ["one two three four. five. six. seven. eight", "Look at example dot com for more", "add plus one two three four five six seven eight nine ten", "two plus one two three four five six seven eight nine", "Er sah eins. Zwei. Drei. Vier kamen", "uno. dos. tres. cuatro. cinco", "un deux trois. quatre. cinq. six", "We saw one two three. Four five. Six seven. Eight nine came"])
def test_prose_with_number_words_has_no_spans(text):
    assert pii.spans(text)[1] == []


@pytest.mark.parametrize(("text", "want"), [("call plus four nine one two three four five six seven eight", "phone:5:59"), ("bob at example dot com", "email:0:22"), ("one nine two . one six eight . zero . one", "ip:0:41"), ("one nine two.one six eight.zero.one", "ip:0:35"), ("plus 49 30 one two three four five", "phone:0:34")])
def test_disguises_are_still_found(text, want):
    assert pii.written(pii.spans(text)[1]) == want


def test_texts_without_number_words_need_no_transducer(monkeypatch):
    monkeypatch.setattr(pii, "STRETCH", 5)
    rng = random.Random(12)
    parts = ["one", "two", "nine", "dot", "plus", "at", "1", "22", "192", ".", " ", ", ", "-", "bob", "com", "Dreı", "six", "ſix", " . ", "+", "x", "eins", "un"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) + rng.choice(["", " ", "."]) for _ in range(rng.randint(1, 14)))
        assert pii._has_words(text) or not (pii._digits(text) or pii._mixed(text))
