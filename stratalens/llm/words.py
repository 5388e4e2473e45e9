"""Ids of texts by a vocabulary of the `tokenizers` library, a whole Arrow array at a time.

For vocabularies whose pre-tokeniser never joins what ASCII white space parts (and drops it), a text's ids are its
words' ids in a row.  Arrow splits the texts and numbers their distinct words; only those are encoded, and the texts'
ids are gathered by number.  Where the vocabulary splits words by SPLIT_PATTERN and lower-cases them, distinct words
of printable ASCII and Latin-1 letters are cut into parts and merged in numpy, all parts of one length together: each
round applies to every part its lowest-ranked pair, the leftmost of equals, as the library does.  All other words go
to the library itself.  Nothing is remembered from one array to the next, so memory follows CHUNK_BYTES.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of the texts that are encoded together; a longer text goes alone.
CHUNK_BYTES = 4 << 20
#: Words beyond it are left to the library.
MOST_WORD = 64
#: Words that the library gets in one call.
LOOK_UP_WORDS = 2000

# Fixed value: the pre-tokeniser pattern under which words can be cut here.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LETTER, NUMBER, OTHER = 0, 1, 2
NO_RANK = np.int32(2**31 - 1)


def gather(pool: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The slices pool[start : start + len], one after another."""
    ends = np.cumsum(lens)
    return pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lens), lens)]


def content(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string array without nulls, and the bounds of its items."""
    _, bounds, data = words.buffers()
    bounds = np.frombuffer(bounds, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64) if len(words) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0]


class Merges:
    """Byte-pair merges with word ends, of many short words at once."""

    def __init__(self, vocab: dict[str, int], merges: list, symbols: list[str], end: str) -> None:
        self.inner = np.array([vocab[s] for s in symbols], np.int32)
        self.last = np.array([vocab[s + end] for s in symbols], np.int32)
        self.size = max(vocab.values()) + 1
        pairs = [x if isinstance(x, list) else x.split(" ") for x in merges]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.rank = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = keys[self.rank]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NO_RANK)

    def merge(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of equally many symbols -> (ids, their number in each row); a row's ids stand at its left."""
        out, counts = symbols.copy(), np.ones(len(symbols), np.int64)
        live, width = np.arange(len(symbols)), symbols.shape[1]
        rank = self.ranks(symbols[:, :-1], symbols[:, 1:])
        while width > 1 and len(live):
            j = rank.argmin(axis=1)
            best = rank[np.arange(len(live)), j]
            go = best != NO_RANK
            if not go.all():
                ended = live[~go]
                out[ended, :width], counts[ended] = symbols[~go], width
                live, symbols, rank, j, best = live[go], symbols[go], rank[go], j[go], best[go]
            rows, at = np.arange(len(live)), j[:, None]
            symbols[rows, j] = self.made[best]
            width -= 1
            place = np.arange(width)
            symbols = np.take_along_axis(symbols, place + (place > at), axis=1)
            place = place[:-1]
            rank = np.take_along_axis(rank, place + (place >= at), axis=1)
            for rest, k in ((j > 0, j - 1), (j < width - 1, j)):
                r, k = rows[rest], k[rest]
                rank[r, k] = self.ranks(symbols[r, k], symbols[r, k + 1])
        out[live, :width], counts[live] = symbols, width
        return out, counts

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, their number in each word); no word is empty."""
        raw, bounds = content(words)
        lens = np.diff(bounds)
        counts = np.zeros(len(words), np.int64)
        found = []
        for length in np.unique(lens).tolist():
            rows = np.flatnonzero(lens == length)
            own = raw[bounds[rows][:, None] + np.arange(length)]
            symbols = self.inner[own]
            symbols[:, -1] = self.last[own[:, -1]]
            ids, counts[rows] = self.merge(symbols)
            found.append((rows, ids))
        starts = np.cumsum(counts) - counts
        flat = np.zeros(int(counts.sum()), np.int32)
        for rows, ids in found:
            place = np.arange(ids.shape[1])
            used = place < counts[rows][:, None]
            flat[(starts[rows][:, None] + place)[used]] = ids[used]
        return flat, counts


class Tokens:
    """Ids of texts."""

    def __init__(self, spec: str) -> None:
        from tokenizers import Tokenizer

        from .bpe import byte_symbols

        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        data = json.loads(spec)
        model = data["model"]
        self.added = [x["content"] for x in data["added_tokens"]]
        known = f'"{json.dumps(SPLIT_PATTERN)[1:-1]}"' in spec and '"Lowercase"' in spec and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout")
        self.merges = Merges(model["vocab"], model["merges"], byte_symbols(), "</w>") if known else None

    def _strange(self, words: pa.Array, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Which words must go to the library."""
        first = np.zeros(len(raw) + 1, bool)
        first[bounds] = True
        lead = raw == 0xC3  # of a Latin-1 letter, unless what follows is a sign
        trail = np.zeros(len(raw), bool)
        trail[1:] = lead[:-1] & ~first[1:-1] & (raw[1:] >> 6 == 2) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
        fine = (raw > 0x20) & (raw < 0x7F) & (raw != 0x27) | trail
        fine[:-1] |= trail[1:]
        bad = np.concatenate(([0], np.cumsum(~fine)))
        out = (bad[bounds[1:]] > bad[bounds[:-1]]) | (np.diff(bounds) > MOST_WORD)
        for token in self.added:
            out |= pc.match_substring(words, token).to_numpy(zero_copy_only=False)
        return out

    def _look_up(self, words: list[str]) -> list[np.ndarray]:
        out = []
        for at in range(0, len(words), LOOK_UP_WORDS):
            out += [np.array(x.ids, np.int32) for x in self.library.encode_batch_fast(words[at : at + LOOK_UP_WORDS], add_special_tokens=False)]
        return out

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pool of ids, where each word's ids begin in it, and their number)."""
        raw, bounds = content(words)
        odd = self._strange(words, raw, bounds) if self.merges else np.ones(len(words), bool)
        lens = np.diff(bounds)
        starts, counts = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        plain = np.flatnonzero(~odd & (lens > 0))
        pool = np.zeros(0, np.int32)
        if len(plain):
            raw = gather(raw, bounds[plain], lens[plain])
            begins = np.cumsum(lens[plain]) - lens[plain]
            high = raw >= 0x80
            raw[(raw >= 0x41) & (raw <= 0x5A) | (raw >= 0x80) & (raw <= 0x9E)] += 0x20  # lower case; U+00DF is beyond
            kind = np.full(len(raw), OTHER, np.int8)
            kind[high | (raw >= 0x61) & (raw <= 0x7A)] = LETTER
            kind[(raw >= 0x30) & (raw <= 0x39)] = NUMBER
            cut = kind == NUMBER
            cut[1:] |= kind[1:] != kind[:-1]
            cut[begins] = True
            cuts = np.flatnonzero(cut)
            parts = pa.StringArray.from_buffers(len(cuts), pa.py_buffer(np.append(cuts, len(raw)).astype(np.int32)), pa.py_buffer(raw)).dictionary_encode()
            ids, each = self.merges.encode(parts.dictionary)
            number = parts.indices.to_numpy()
            pool = gather(ids, (np.cumsum(each) - each)[number], each[number])
            ends = np.append(0, np.cumsum(each[number]))[np.append(np.searchsorted(cuts, begins), len(cuts))]
            starts[plain], counts[plain] = ends[:-1], np.diff(ends)
        odd = np.flatnonzero(odd)
        if len(odd):
            own = self._look_up([bytes(x).decode("utf-8", "replace") for x in words.take(pa.array(odd)).cast(pa.binary()).to_pylist()])
            counts[odd] = [len(x) for x in own]
            starts[odd] = len(pool) + np.cumsum(counts[odd]) - counts[odd]
            pool = np.concatenate([pool, *own])
        return pool, starts, counts

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For chunks of texts, in order: ids (unsigned 32-bit) of all their texts in a row, and the bounds of each text."""
        texts = pc.fill_null(texts.cast(pa.binary()), b"")
        sizes = np.diff(content(texts)[1])
        chunk = np.cumsum(sizes) // CHUNK_BYTES
        edges = np.concatenate(([0], np.flatnonzero(np.diff(chunk)) + 1, [len(texts)])) if len(texts) else [0]
        for a, b in zip(edges, edges[1:], strict=False):
            split = pc.ascii_split_whitespace(texts.slice(int(a), int(b - a)).view(pa.string()))
            bounds = split.offsets.to_numpy().astype(np.int64)
            coded = split.flatten().dictionary_encode()
            pool, starts, counts = self.words(coded.dictionary)
            number = coded.indices.to_numpy()
            each = counts[number]
            yield gather(pool, starts[number], each).astype("<u4"), np.append(0, np.cumsum(each))[bounds - bounds[0]]


_tokens: dict[str, Tokens] = {}


def tokens(spec: str) -> Tokens:
    """One tokeniser for each vocabulary and worker."""
    name = sha256(spec.encode()).hexdigest()
    if name not in _tokens:
        _tokens.clear()
        _tokens[name] = Tokens(spec)
    return _tokens[name]
