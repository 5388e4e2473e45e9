"""WARC archives in Zstandard: one frame per record, and a dictionary in the leading skippable frame.

Writing: equal payloads of at least MIN_REVISIT bytes are stored once, as the response with the smallest page id,
and revisited by the others.  Spark's own file writer and commit protocol put each partition into one archive:
a row is a frame, and the row separator is an empty skippable frame, which every decoder passes over.  So a
lost executor leaves no half archive, and any file system that Spark knows will do.

Reading: each archive gives its dictionary and then its records one by one; frame bounds come from the block
headers, without copies of the rest.  Version, mandatory headers, block and payload lengths, the end of the
record and the payload digest are validated; what fails is a row with `error` set.

Defined cases: a null html is an empty payload; a null url is written as a urn of the page id; a null page id is
written without one and read as null, and is a response only if no equal payload has an id; rows with equal
id and payload are all responses (none can refer to itself); an empty table makes no records.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator
from hashlib import sha256
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: Payloads of fewer bytes are always stored.
MIN_REVISIT = 100
#: Payload bytes of one archive, about; a single larger payload has an archive that is larger.
ARCHIVE_BYTES = 16 << 20
#: Pages from which the dictionary is trained, their longest payload, and the dictionary's size.
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 1500, 64 << 10, 64 << 10
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

# Frame magic numbers of the Zstandard format, and the skippable one that holds a dictionary.
FRAME, SKIPPABLE, DICTIONARY = 0xFD2FB528, 0x184D2A50, 0x184D2A5D
SEPARATOR = struct.pack("<II", SKIPPABLE, 0)
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")
END = b"\r\n\r\n"

SCHEMA = "page_id {id}, url string, record_type string, payload_bytes long, payload_digest string, refers_to {id}, payload binary, error string"


class Invalid(ValueError):
    """A frame or record that breaks the format."""


def train(payloads: list[bytes]) -> bytes:
    import zstandard

    payloads = [x for x in payloads if x]
    room = min(DICTIONARY_BYTES, max(512, sum(map(len, payloads)) // 4))
    try:
        return zstandard.train_dictionary(room, payloads).as_bytes()
    except zstandard.ZstdError:
        return b"".join(payloads)[:room]


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest}')}>"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """The bytes of one record; a revisit if refers_to is set."""
    size = len(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"X-Payload-Length: {size}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
        payload = b""
    block = http + payload
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode("utf-8", "replace") + END + block + END


def parse(raw: bytes) -> dict:
    """One record, validated."""
    head, found, rest = raw.partition(END)
    if not found:
        raise Invalid("the headers do not end")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise Invalid(f"unknown version {lines[0][:20]!r}")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise Invalid(f"not a header: {line[:40]!r}")
        headers[name.strip().lower()] = value.strip()
    for name in MANDATORY:
        if name not in headers:
            raise Invalid(f"{name} is missing")
    if not headers["content-length"].isdecimal():
        raise Invalid("content-length is no number")
    size = int(headers["content-length"])
    if len(rest) != size + len(END) or rest[size:] != END:
        raise Invalid(f"content-length is {size}, the block has {len(rest) - len(END)} bytes")
    http, found, payload = rest[:size].partition(END)
    if not found or not http.startswith(b"HTTP/"):
        raise Invalid("the block is no HTTP message")
    length = re.search(rb"(?mi)^content-length:[ \t]*(\d+)[ \t\r]*$", http)
    kind, digest = headers["warc-type"], headers.get("warc-payload-digest", "").removeprefix("sha256:")
    if kind == "response":
        if length and int(length[1]) != len(payload):
            raise Invalid(f"the payload has {len(payload)} bytes, not {int(length[1])}")
        if digest and sha256(payload).hexdigest() != digest:
            raise Invalid("the payload does not match its digest")
        digest = digest or sha256(payload).hexdigest()
    elif kind == "revisit":
        if payload:
            raise Invalid("a revisit has a payload")
        if "warc-refers-to" not in headers or not digest:
            raise Invalid("a revisit names no record or digest")
    else:
        raise Invalid(f"unknown type {kind[:20]!r}")
    return {"headers": headers, "type": kind, "digest": digest, "size": int(headers.get("x-payload-length", len(payload))), "payload": payload if kind == "response" else None}


def frame_end(data: memoryview, at: int) -> int:
    """The end of the frame that starts at `at`, from its headers alone."""
    total = len(data)
    if at + 8 > total:
        raise Invalid("a frame is cut off")
    magic = int.from_bytes(data[at : at + 4], "little")
    if magic & 0xFFFFFFF0 == SKIPPABLE:
        end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
    elif magic == FRAME:
        flags = data[at + 4]
        single = flags >> 5 & 1
        end = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
        last = 0
        while not last:
            if end + 3 > total:
                raise Invalid("a frame is cut off")
            block = int.from_bytes(data[end : end + 3], "little")
            last, kind, size = block & 1, block >> 1 & 3, block >> 3
            if kind == 3:
                raise Invalid("a reserved block type")
            end += 3 + (1 if kind == 1 else size)
        end += 4 * (flags >> 2 & 1)
    else:
        raise Invalid(f"no frame at byte {at}")
    if end > total:
        raise Invalid("a frame is cut off")
    return end


def records(data: bytes) -> Iterator[dict | Invalid]:
    """The records of an archive; an invalid one in its place, and the end where frames can no longer be told apart."""
    import zstandard

    view, at, coder = memoryview(data), 0, zstandard.ZstdDecompressor()
    while at < len(view):
        try:
            end = frame_end(view, at)
        except Invalid as e:
            yield e
            return
        magic = int.from_bytes(view[at : at + 4], "little")
        if magic == DICTIONARY and at == 0:
            content = bytes(view[8:end])
            if content[:4] == FRAME.to_bytes(4, "little"):
                content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
            if content:
                coder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
        elif magic == FRAME:
            try:
                raw = coder.decompressobj().decompress(view[at:end])
                size = zstandard.frame_content_size(view[at:end])
                if size >= 0 and size != len(raw):
                    raise Invalid(f"the frame holds {len(raw)} bytes, not {size}")
                yield parse(raw)
            except zstandard.ZstdError as e:
                yield Invalid(str(e))
            except Invalid as e:
                yield e
        at = end


def _dictionary(pages: DataFrame) -> bytes:
    """Trained from a bounded sample, by ascending hash of the page ids."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.xxhash64("page_id", "url").alias("order"), html.alias("html")).where(F.octet_length("html").between(1, SAMPLE_BYTES))
    picks = shared.lowest(rows.select("order"), "order", SAMPLE_PAGES).distinct()
    rows = rows.join(F.broadcast(picks), "order").groupBy("order").agg(F.min("html").alias("html")).orderBy("order").collect()  # SAMPLE_PAGES at most
    return train([r["html"].encode("utf-8", "replace") for r in rows])


def _deduplicated(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, refers_to."""
    spark = pages.sparkSession
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "salt": shared.bucket_of("page_id", shared.shuffle_partitions(spark))})
    slim = shared.stored(rows.where(F.octet_length("payload") >= MIN_REVISIT).groupBy("digest", "salt").agg(F.min("page_id").alias("head"), F.count("*").alias("n")), "digests")
    heads = slim.groupBy("digest").agg(F.min("head").alias("head"), F.sum("n").alias("n")).where("n > 1")
    heads = shared.stored(slim.select("digest", "salt").join(heads, "digest").select("digest", "salt", "head"), "heads")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("head")), F.col("head"))
    return rows.join(shared.small(heads, 100), ["digest", "salt"], "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Archives of all pages under `path`."""
    size = pages.agg(F.sum(F.coalesce(F.octet_length(F.col("html").cast("string")), F.lit(0)).cast("long")).alias("n")).first()["n"] or 0
    dictionary = _dictionary(pages)
    rows = _deduplicated(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        coder = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True, write_content_size=True)
        frames = [struct.pack("<II", DICTIONARY, len(dictionary)) + dictionary]
        held = 0
        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(batch.column(x) for x in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                frames.append(coder.compress(record(page_id.as_py(), url.as_py(), payload.as_buffer().to_pybytes(), digest.as_py(), refers_to.as_py())))
                held += len(frames[-1])
                if held > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], ["value"])
                    frames, held = [], 0
        if frames:
            yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], ["value"])

    dealt = rows.repartition(max(1, ceil(size / archive_bytes)), F.xxhash64("page_id", "digest"))
    frames = dealt.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    frames.write.option("lineSep", SEPARATOR.decode("latin-1")).text(path)


def read(spark: SparkSession, path: str, id_type: str = "long", payloads: bool = True) -> DataFrame:
    """All records of the archives under `path`, in the columns of SCHEMA; payload is null for revisits, or if not asked for."""
    schema = SCHEMA.format(id=id_type)
    names = [x.split()[0] for x in schema.split(", ")]
    number = id_type in ("long", "bigint", "int", "integer", "smallint", "tinyint")
    arrow = {"bigint": pa.int64(), "long": pa.int64(), "int": pa.int32(), "integer": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}.get(id_type, pa.string())
    types = [arrow, pa.string(), pa.string(), pa.int64(), pa.string(), arrow, pa.binary(), pa.string()]

    def row(x: dict | Invalid) -> tuple:
        if isinstance(x, Invalid):
            return (None,) * 7 + (str(x),)
        h = x["headers"]
        own, other = h.get("x-page-id"), h.get("x-refers-to-page-id")
        if number:
            own, other = (None if v is None else int(v) for v in (own, other))
        return own, h.get("warc-target-uri"), x["type"], x["size"], x["digest"], other, x["payload"] if payloads else None, None

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                for x in records(content.as_buffer().to_pybytes()):
                    rows.append(row(x))
                    held += len(rows[-1][6] or b"") + 200
                    if held > 4 << 20:
                        yield table(rows)
                        rows, held = [], 0
                if rows:
                    yield table(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)
