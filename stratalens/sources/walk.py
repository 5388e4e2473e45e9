"""Directory trees as tables, listed level by level on the executors; hidden names included.

A level is a table of directories; its tasks list them, each directory on its own, and their entries are the next level.
Excluded entries are dropped where they are met, so an excluded directory is never listed.  The root is a path that all
machines see, or a URI that Arrow's file systems open (file, hdfs, s3, gs).  Symbolic links to directories are not entered.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import work

#: Rows and bytes of one Arrow batch, and bytes of files read by one task.
BATCH_ROWS, BATCH_BYTES, TASK_BYTES = 10_000, 8 << 20, 128 << 20
ENTRY = "path string, is_file boolean, size long, modified timestamp"
_ENTRY = pa.schema([("path", pa.string()), ("is_file", pa.bool_()), ("size", pa.int64()), ("modified", pa.timestamp("us", "UTC"))])


def opened(root: str) -> tuple[pafs.FileSystem | None, str] | None:
    """The file system (None: this machine's) and the root's path in it; None for a kind of URI that Arrow does not know."""
    if "://" not in root and not root.startswith("file:"):
        return None, os.path.abspath(root)
    try:
        fs, path = pafs.FileSystem.from_uri(root)
    except (pa.ArrowInvalid, NotImplementedError):
        return None
    return (None, path) if isinstance(fs, pafs.LocalFileSystem) else (fs, path)


def _listed(fs: pafs.FileSystem | None, base: str, directory: str) -> Iterator[tuple[str, bool, int | None, datetime]]:
    where = f"{base}/{directory}" if directory else base
    if fs is None:
        with os.scandir(where) as found:
            for entry in found:
                is_directory = entry.is_dir(follow_symlinks=False)
                if is_directory or entry.is_file():
                    stat = entry.stat()
                    yield entry.name, not is_directory, None if is_directory else stat.st_size, datetime.fromtimestamp(stat.st_mtime, UTC)
    else:
        for info in fs.get_file_info(pafs.FileSelector(where)):
            if info.type in (pafs.FileType.File, pafs.FileType.Directory):
                yield info.base_name, info.type == pafs.FileType.File, info.size, info.mtime


def entries(spark: SparkSession, root: str, exclude: tuple[str, ...] | list[str] = (), max_depth: int | None = None, listings: Accumulator | None = None) -> DataFrame:
    """path (relative to the root), is_file, size, modified of all files and directories without excluded parts of names.

    max_depth: files this many directories below the root at most.  listings counts the directories that are listed.
    """
    place = opened(root)
    if place is None:
        raise ValueError(f"no file system for {root}")
    fs, base = place
    names = tuple(exclude)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for directory in batch.column("path").to_pylist():
                if listings is not None:
                    listings.add(1)
                for name, is_file, size, modified in _listed(fs, base, directory):
                    if not any(x in name for x in names):
                        held.append((f"{directory}/{name}" if directory else name, is_file, size, modified))
                    if len(held) == BATCH_ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _ENTRY.types, strict=True)], schema=_ENTRY)
                        held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _ENTRY.types, strict=True)], schema=_ENTRY)

    level = spark.createDataFrame([("",)], "path string")
    found, depth = None, 0
    while max_depth is None or depth <= max_depth:
        own = work.stored(level.mapInArrow(run, ENTRY), "entries")
        found = own if found is None else found.unionByName(own)
        level = own.where("NOT is_file").select("path")
        many = level.count()
        if not many:
            break
        if many > 1:
            level = level.repartition(min(many, 4 * spark.sparkContext.defaultParallelism), "path")
        depth += 1
    return found


def named(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """The entries of some paths; those that are not there have no row."""
    place = opened(root)
    if place is None:
        raise ValueError(f"no file system for {root}")
    fs, base = place
    fs = fs or pafs.LocalFileSystem()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("path").to_pylist()
            found = [(p, i) for p, i in zip(own, fs.get_file_info([f"{base}/{p}" for p in own]), strict=True) if i.type == pafs.FileType.File]
            columns = [[p for p, _ in found], [True] * len(found), [i.size for _, i in found], [i.mtime for _, i in found]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ENTRY.types, strict=True)], schema=_ENTRY)

    return spark.createDataFrame([(p,) for p in dict.fromkeys(paths)], "path string").mapInArrow(run, ENTRY)


def contents(files: DataFrame, root: str) -> DataFrame:
    """The files' rows with content: UTF-8, what is none replaced."""
    fs, base = opened(root)

    def read(path: str) -> str:
        where = f"{base}/{path}"
        if fs is None:
            with open(where, "rb") as file:
                data = file.read()
        else:
            with fs.open_input_stream(where) as file:
                data = file.read()
        return data.decode("utf-8", "replace")

    schema = pa.schema([*_ENTRY, pa.field("content", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, first, held = [], 0, 0
            for k, (path, size) in enumerate(zip(batch.column("path").to_pylist(), batch.column("size").to_pylist(), strict=True)):
                texts.append(read(path))
                held += size or 0
                if held >= BATCH_BYTES or k + 1 == batch.num_rows:
                    part = batch.slice(first, len(texts))
                    yield pa.RecordBatch.from_arrays([*(part.column(c).cast(t) for c, t in zip(_ENTRY.names, _ENTRY.types, strict=True)), pa.array(texts, pa.string())], schema=schema)
                    texts, first, held = [], k + 1, 0

    size = files.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count("*").alias("n")).first()
    tasks = max(1, min(size["n"], max(size["bytes"] // TASK_BYTES, files.sparkSession.sparkContext.defaultParallelism)))
    return files.select(*_ENTRY.names).repartition(tasks, "path").mapInArrow(run, f"{ENTRY}, content string")
