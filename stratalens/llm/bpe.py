"""Byte-level BPE encoding and decoding with a pair occurrence index.

The distinct words of a batch that the worker does not yet know form one partition of symbols.  Each mergeable
pair is mapped to all its positions; the active ranks are applied in ascending order, each to its positions
from left to right, and the lists of the pairs that a merge makes are extended.  A position whose pair has
gone is passed over.  The ids of known words are remembered, within a bound; whole texts are then the join of
their words' ids.

The vocabulary is a file in the `tokenizers` JSON format (byte-level model); the driver reads it and ships its
content.  Defined cases: a null text is an empty one and has no ids; strings of added tokens in a text become
those tokens, as in the library; ids without a token are left out in decoding; decoding replaces bytes that
are no UTF-8.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from hashlib import sha256
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words whose ids a worker remembers, and the longest of them.
CACHE_WORDS, CACHE_CHARS = 500_000, 64
#: Characters of the texts whose new words are encoded together.
BATCH_CHARS = 2 << 20

# The word pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of ASCII and Latin-1 letters only, where the standard library's faster engine will do.
_L, _S = "A-Za-zÀ-ÖØ-öø-ÿ", r"\t-\r "
LATIN_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[0-9]+| ?[^{_S}{_L}0-9]+|[{_S}]+(?![^{_S}])|[{_S}]+"
NOT_LATIN = re.compile("[^\x00-\x7fÀ-ÖØ-öø-ÿ]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself, or the next free one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, spec: str) -> None:
        import regex

        data = json.loads(spec)
        vocab = data["model"]["vocab"]
        symbols = byte_symbols()
        self.of_byte = [vocab[s] for s in symbols]
        byte_of = {s: b for b, s in enumerate(symbols)}
        self.merges = {}
        for rank, pair in enumerate(data["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.by_rank = [(a, b, new) for (a, b), (_, new) in self.merges.items()]
        self.rank_of = {pair: rank for pair, (rank, _) in self.merges.items()}
        self.added = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *self.added.values()]))
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token)
        for token, i in self.added.items():
            self.bytes_of[i] = token.encode()
        names = sorted(self.added, key=len, reverse=True)
        self.split_added = re.compile("(" + "|".join(map(re.escape, names)) + ")").split if names else lambda x: [x]
        self.words_any, self.words_latin = regex.compile(PATTERN).findall, re.compile(LATIN_PATTERN).findall
        self.known: dict[str, bytes] = {}

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The pair occurrence index over one partition of words."""
        rank_of, by_rank, of_byte = self.rank_of, self.by_rank, self.of_byte
        symbol: list[int] = []
        starts = []
        for word in words:
            starts.append(len(symbol))
            symbol += [of_byte[b] for b in word.encode("utf-8", "surrogatepass")]
            symbol.append(-1)  # no merge goes beyond a word
        size = len(symbol)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        places: dict[int, list[int]] = {}
        get = rank_of.get
        for p, pair in enumerate(zip(symbol, symbol[1:], strict=False)):
            if (rank := get(pair)) is not None:
                if rank in places:
                    places[rank].append(p)
                else:
                    places[rank] = [p]
        active = list(places)
        heapify(active)
        while active:
            rank = heappop(active)
            a, b, new = by_rank[rank]
            at = places.pop(rank)
            at.sort()
            for p in at:
                if symbol[p] != a:
                    continue
                q = after[p]
                if symbol[q] != b:
                    continue
                symbol[p], symbol[q] = new, -2
                r = after[p] = after[q]
                before[r] = p
                left = before[p]
                if left >= 0 and (k := get((symbol[left], new))) is not None:
                    if k in places:
                        places[k].append(left)
                    else:
                        places[k] = [left]
                        heappush(active, k)
                if (k := get((new, symbol[r]))) is not None:
                    if k in places:
                        places[k].append(p)
                    else:
                        places[k] = [p]
                        heappush(active, k)
        out = []
        for p in starts:
            ids = []
            while (x := symbol[p]) >= 0:
                ids.append(x)
                p = after[p]
            out.append(ids)
        return out

    def words(self, text: str) -> list[str]:
        return self.words_any(text) if NOT_LATIN.search(text) else self.words_latin(text)

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """For each text its ids, as little-endian unsigned 32-bit integers."""
        held: list[list] = []
        chars = 0
        for text in texts:
            text = text or ""
            parts = self.split_added(text) if any(x in text for x in self.added) else [text]
            held.append([p if i % 2 else self.words(p) for i, p in enumerate(parts)])
            chars += len(text)
            if chars >= BATCH_CHARS:
                yield from self._join(held)
                held, chars = [], 0
        yield from self._join(held)

    def _join(self, held: list[list]) -> Iterator[bytes]:
        wanted = set(chain.from_iterable(p for parts in held for p in parts[::2]))
        new = [w for w in wanted if w not in self.known]
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known, new = {}, list(wanted)
        found = dict(zip(new, (np.array(x, "<u4").tobytes() for x in self.encode_words(new)), strict=True))
        long = {w: found.pop(w) for w in new if len(w) > CACHE_CHARS}
        self.known.update(found)
        get = self.known.__getitem__
        if long:
            get = lambda w: long[w] if w in long else self.known[w]
        for parts in held:
            if len(parts) == 1:
                yield b"".join(map(get, parts[0]))
            else:
                yield b"".join(self.added[p].to_bytes(4, "little") if i % 2 else b"".join(map(get, p)) for i, p in enumerate(parts))

    def decode(self, ids: Iterable[int]) -> str:
        table = self.bytes_of
        return b"".join([table[i] for i in ids if i < len(table)]).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(spec: str) -> Codec:
    """One codec for each vocabulary and worker, which keeps its words from task to task."""
    name = sha256(spec.encode()).hexdigest()
    if name not in _codecs:
        _codecs.clear()
        _codecs[name] = Codec(spec)
    return _codecs[name]


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("string").alias("text"))


def _id_type(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array<int>) of every row."""
    spec = read_spec(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in codec(spec).encode(t.as_py() for t in batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _texts(docs).mapInArrow(run, f"doc_id {_id_type(docs)}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every row of doc_id, ids."""
    spec = read_spec(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [codec(spec).decode(x.as_py() or ()) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {_id_type(encoded)}, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes and decodes every whole text in one pass."""
    spec = read_spec(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            here = codec(spec)
            n, of_ids, of_text = [], [], []
            for raw in here.encode(t.as_py() for t in batch.column("text")):
                n.append(len(raw) // 4)
                of_ids.append(sha256(raw).hexdigest())
                of_text.append(sha256(here.decode(np.frombuffer(raw, "<u4").tolist()).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _texts(docs).mapInArrow(run, f"doc_id {_id_type(docs)}, n_tokens long, ids_sha256 string, decoded_sha256 string")
