"""Personal data with offset-preserving deobfuscation.

Plain identifiers (email, ip, card, phone) are found first.  Transducers then rewrite the text piece by piece
into a normal form: look-alike letters and digits to ASCII, invisible characters to nothing, disguised "at"
and "dot" to their signs, spelled digits to digits; each character of the normal form knows which source
characters it stands for.  The same detectors search the normal form, and their spans are mapped back.  A
mapped span counts unless a plain one of its kind covers it.  Runs that mix number words, digits and words for
"dot" have a second normal form, since a number beside a spelled one may or may not belong to it.  Texts that
no transducer would change are not searched again.

A bare "at" counts only if a dot of its domain is disguised too: "look at example.com" is prose.  A domain with a bare
word for "dot" must end in a known top-level label and must not begin with an article or the like; after a bare
"at" that word must be "dot" itself: "look at this point in time" is prose as well.

Every detector is linear in the text.  Offsets are code points, ends exclusive.  Defined cases: a null text is an
empty one without spans (and stays null when masked).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

Span = tuple[int, int, int]  # start, end, position in KINDS

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A digit run is taken whole or not at all, so that a search from inside one finds nothing new.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")

# Look-alikes of ASCII letters, and number words.
LOOKALIKES = dict(zip("авеікмнорстухјѕһԁԛԝӏАВЕІКМНОРСТУХЈЅαεικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "abeikmhopctyxjshdqwlABEIKMHOPCTYXJSaeikvoptuxABEZHIKMNOPTYX", strict=True))
SIGNS = dict.fromkeys("‐‑‒–—−", "-") | dict.fromkeys("。․·", ".") | dict.fromkeys("              　", " ")
INVISIBLE = frozenset("­​‌‍‎‏⁠﻿")
NUMBERS = (
    "zero oh null cero zéro",
    "one eins uno",
    "two zwei dos deux",
    "three drei tres trois",
    "four vier cuatro quatre",
    "five fünf cinco cinq",
    "six sechs seis",
    "seven sieben siete sept",
    "eight acht ocho huit",
    "nine neun nueve neuf",
)
NUMBER_OF = {word: str(i) for i, words in enumerate(NUMBERS) for word in words.split()}
AT_WORDS, DOT_WORDS, PLUS_WORDS = "at", "dot|punkt|punto|point", "plus|más|mas"
# Last labels of a domain that are no common word of prose, and words before "dot" that are no label.
TOP_LABELS = frozenset("com org net edu gov mil info biz int dev app xyz uk eu de fr es ch nl pl ru jp cn ca au br mx pt se dk fi cz gr ie nz kr ar cl".split())
NO_LABELS = frozenset("the a an this that these those his her its our your my their every each some any no one what which der die das dem den ein eine le la les un une el los las una".split())

# Words before a bare "at" that are no mailbox, and words before "plus" that make it a sum.
NO_LOCALS = frozenset("look looking looks see find found visit meet meets here there us me you him them it is are was were be been located available hosted".split())
NO_PLUS = frozenset("add adds adding added and is equals makes sum of a the".split())

_NUMBER = "|".join(sorted(NUMBER_OF, key=len, reverse=True))
#: Characters that a transducer may change.
STRANGE = re.compile("[^\x00-\x7f¡-©«¬®-±´-¶¸»-ÿ]")
BRACKETED = re.compile(rf"[(\[{{<][ \t]*+(?:(?P<at>{AT_WORDS}|@)|{DOT_WORDS}|\.)[ \t]*+[)\]}}>][ \t]*+", re.I)
BARE = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+(?P<at> (?:{AT_WORDS}) |@)[A-Za-z0-9-]++(?:(?: (?:{DOT_WORDS}) |\.)[A-Za-z0-9-]++)++", re.I)
BARE_DOT = re.compile(rf" (?:{DOT_WORDS}) ", re.I)
SPELLED = re.compile(rf"(?<!\w)(?:(?:{PLUS_WORDS}|\+)[ \t]*)?(?:{_NUMBER})(?:[ \t.,-]{{1,3}}(?:{_NUMBER}|{DOT_WORDS}|[0-9]+)(?!\w)){{3,}}", re.I)
#: Number words, digits and words for "dot" in any order.
MIXED = re.compile(rf"(?:(?<!\w)(?:{PLUS_WORDS})[ \t]{{0,3}}|\+[ \t]{{0,3}})?(?:(?<![0-9])[0-9]++|(?<!\w)(?:{_NUMBER})(?![^\W\d]))(?:[ \t.,()-]{{0,4}}(?:[0-9]++|(?:{_NUMBER}|{DOT_WORDS})(?![^\W\d])))++", re.I)
#: What MIXED and SPELLED are made of; two such pieces, one of them a word, must stand side by side.
PIECE = re.compile(r"[^\W\d_]+|[0-9]+")
PIECE_WORDS = frozenset([*NUMBER_OF, *DOT_WORDS.split("|"), *PLUS_WORDS.split("|")])
#: Characters that are looked through at once, and where they may end.
STRETCH, BREAK = 1 << 16, re.compile(r"\W")
#: Letters that ignoring case takes for others.
FOLDED = re.compile("[\u0131\u0130\u017f\u212a]")
SENTENCE_END = re.compile(r"(?<![ \t])\.[ \t]")
LAST_WORD = re.compile(r"(\w+)\W*\Z")
LABEL = re.compile("[A-Za-z0-9-]+")
LETTER = re.compile(r"[^\W\d]")
PART = re.compile(rf"(?P<number>{_NUMBER})|(?P<dot>{DOT_WORDS})|(?P<plus>{PLUS_WORDS}|\+)|(?P<digits>[0-9]+)|(?P<gap>[ \t.,()-]+)", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def plain_spans(text: str) -> list[Span]:
    """Identifiers as they stand, sorted by start, then kind."""
    out: list[Span] = []
    at, end = text.find("@"), 0
    while at >= 0:
        if m := DOMAIN.match(text, at):
            start = at
            while start > end and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                out.append((start, m.end(), 0))
                end = m.end()
        at = text.find("@", max(at + 1, end))
    if DIGIT.search(text):
        out += [(m.start(), m.end(), 1) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(digits := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
        if "+" in text:
            out += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m.group())) <= 15]
    return sorted(out, key=lambda x: (x[0], x[2], x[1]))


def plain_char(c: str) -> str:
    """The ASCII character that `c` looks like, `c` itself, or nothing for an invisible one."""
    if c in INVISIBLE:
        return ""
    if (x := LOOKALIKES.get(c) or SIGNS.get(c)) is not None:
        return x
    if (d := unicodedata.decimal(c, None)) is not None:
        return str(d)
    x = unicodedata.normalize("NFKC", c)
    return x if len(x) == 1 and x.isascii() else c


class Traced:
    """A text whose characters know the source characters they stand for."""

    def __init__(self, text: str) -> None:
        self.text, self.starts, self.ends = text, list(range(len(text))), list(range(1, len(text) + 1))

    def copy(self) -> Traced:
        out = Traced("")
        out.text, out.starts, out.ends = self.text, self.starts, self.ends
        return out

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace ranges (ascending, apart) of the present text; each new character stands for its whole range."""
        if not edits:
            return
        text, starts, ends, at = [], [], [], 0
        for a, b, new in edits:
            text.append(self.text[at:a])
            starts += self.starts[at:a]
            ends += self.ends[at:a]
            if b > a:
                text.append(new)
                starts += [self.starts[a]] * len(new)
                ends += [self.ends[b - 1]] * len(new)
            at = b
        text.append(self.text[at:])
        self.text, self.starts, self.ends = "".join(text), starts + self.starts[at:], ends + self.ends[at:]


def _has_words(text: str) -> bool:
    """Whether a number word, or one for dot or plus, stands beside another such word or digits: else no run can be there.

    A stretch of the text at a time, so that a very long one makes no long list.
    """
    if FOLDED.search(text):
        return True
    at, last = 0, ""
    while at < len(text):
        end = at + STRETCH
        if end < len(text):
            cut = BREAK.search(text, end)
            end = cut.start() if cut else len(text)
        pieces = [last, *PIECE.findall(text[at:end].lower()), ""]
        for i in [i for i, p in enumerate(pieces) if p in PIECE_WORDS]:
            if any(p in PIECE_WORDS or p.isdigit() for p in (pieces[max(0, i - 1)] if i else "", pieces[i + 1])):
                return True
        at, last = end, pieces[-2]
    return False


def _sum(text: str, at: int) -> bool:
    """Whether the word "plus" at this place adds: after a number or a word that says so."""
    before = LAST_WORD.search(text, max(0, at - 40), at)
    return bool(before) and ((word := before.group(1).lower()) in NO_PLUS or word in NUMBER_OF or word.isdigit())


def _spelled(m: re.Match) -> list[tuple[int, int, str]]:
    """Edits that turn a run of number words into digits; what parts two of them goes, unless it is a dot.  A full stop that ends a sentence stays."""
    out = []
    for p in PART.finditer(m.group()):
        a, b = m.start() + p.start(), m.start() + p.end()
        if p["number"]:
            out.append((a, b, NUMBER_OF[p["number"].lower()]))
        elif p["dot"]:
            out.append((a, b, "."))
        elif p["plus"]:
            if p["plus"] == "+" or not _sum(m.string, a):
                out.append((a, b, "+"))
        elif p["gap"] and not SENTENCE_END.search(p["gap"]):
            out.append((a, b, "." if "." in p["gap"] else ""))
    return out


def _mixed(text: str) -> list[tuple[int, int, str]]:
    """Edits of runs that mix words and digits; what parts two digit runs stays, if the run begins with digits."""
    out = []
    for m in MIXED.finditer(text):
        if not LETTER.search(m.group()):
            continue
        parts = list(PART.finditer(m.group()))
        loose = next(p.lastgroup for p in parts if p.lastgroup in ("number", "digits")) == "digits"
        kept = {m.start() + y.start() for x, y, z in zip(parts, parts[1:], parts[2:], strict=False) if loose and x["digits"] and y["gap"] and z["digits"]}
        out += [e for e in _spelled(m) if e[0] not in kept]
    return out


def deobfuscated(text: str) -> list[Traced]:
    """The normal forms; none if the text is its own."""
    traced = None
    if STRANGE.search(text):
        edits = [(i, i + 1, x) for m in STRANGE.finditer(text) if (x := plain_char(c := text[i := m.start()])) != c]
        if edits:
            traced = Traced(text)
            traced.rewrite(edits)
    source = text
    for find in (_brackets, _bare):
        if edits := find(traced.text if traced else text, source, traced):
            traced = traced or Traced(text)
            traced.rewrite(edits)
    text = traced.text if traced else text
    spelled, mixed = (_digits(text), _mixed(text)) if _has_words(text) else ([], [])
    if not spelled and not mixed:
        return [traced] if traced else []
    out = []
    for edits in [spelled] if spelled == mixed else [spelled, mixed]:
        if edits or traced:
            form = traced.copy() if traced else Traced(text)
            form.rewrite(edits)
            out.append(form)
    return out


def _brackets(text: str, source: str, traced: Traced | None) -> list[tuple[int, int, str]]:
    """Bracketed words for "at" and "dot", with the blanks around them."""
    out: list[tuple[int, int, str]] = []
    end = 0
    for m in BRACKETED.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in " \t":
            start -= 1
        end = m.end()
        out.append((start, end, "@" if m["at"] else "."))
    return out


def _bare(text: str, source: str, traced: Traced | None) -> list[tuple[int, int, str]]:
    if not traced and not BARE_DOT.search(text):
        return []
    out = []
    for m in BARE.finditer(text):
        bare = m["at"] != "@"
        if bare and text[m.start() : m.start("at")].lower() in NO_LOCALS:
            continue
        start, end = m.end("at"), m.end()
        dots = list(BARE_DOT.finditer(text, start, end))
        if dots:  # the domain ends with the last label that can end one
            end = max((x.end() for x in LABEL.finditer(text, dots[0].end(), end) if x.group().lower() in TOP_LABELS), default=0)
            dots = [x for x in dots if x.end() < end]
            prose = LABEL.match(text, start)
            if not dots or prose and prose.group().lower() in NO_LABELS or bare and any(x.group().strip().lower() != "dot" for x in dots):
                continue
        if bare and (dots or traced and any(text[i] == "." and source[traced.starts[i] : traced.ends[i]] != "." for i in range(start, end))):
            out.append((m.start("at"), m.end("at"), "@"))
        out += [(x.start(), x.end(), ".") for x in dots]
    return out


def _digits(text: str) -> list[tuple[int, int, str]]:
    return [e for m in SPELLED.finditer(text) for e in _spelled(m)]


def spans(text: str | None) -> tuple[list[Span], list[Span]]:
    """Plain spans, and all spans, each sorted by start, then kind."""
    text = text or ""
    base = plain_spans(text)
    out = list(base)
    for traced in deobfuscated(text):
        more = [(traced.starts[a], traced.ends[b - 1], k) for a, b, k in plain_spans(traced.text)]
        covered: dict[int, list[Span]] = {k: [x for x in out if x[2] == k] for k in range(len(KINDS))}
        at = [0] * len(KINDS)
        for a, b, k in more:  # both ascend, so one pass over the spans of each kind does
            own = covered[k]
            while at[k] < len(own) and own[at[k]][1] <= a:
                at[k] += 1
            if not (at[k] < len(own) and own[at[k]][0] <= a and b <= own[at[k]][1]):
                out.append((a, b, k))
        out = sorted(set(out), key=lambda x: (x[0], x[2], x[1]))
    return base, out


def written(found: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in found)


def masked(text: str | None) -> str | None:
    """The text with each span, overlapping ones together, replaced by the kind of the first."""
    if text is None:
        return None
    out, at = [], 0
    for a, b, k in spans(text)[1]:
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def find(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, counts of plain identifiers, digest of the plain spans, and all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, every = [[] for _ in KINDS], [], []
            for t in batch.column("text"):
                base, found = spans(t.as_py())
                for k, c in enumerate(counts):
                    c.append(sum(x[2] == k for x in base))
                digests.append(sha256(written(base).encode()).hexdigest())
                every.append(written(found))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(every, pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def mask(docs: DataFrame) -> DataFrame:
    """All rows and columns, with personal data in text masked; n_chars, if there, follows a changed text.  Only changed texts come back from Python."""

    @F.pandas_udf("string")
    def changed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([None if (new := masked(t)) == t else new for t in texts], dtype=object)

    name = "__stratalens_masked"  # a column that no input has
    out = docs.withColumn(name, changed(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    columns = {"text": F.coalesce(name, "text")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col(name).isNull(), F.col("n_chars")).otherwise(F.length(name).cast(docs.schema["n_chars"].dataType))
    return out.withColumns(columns).drop(name)
