"""A vector store on disk, retrieval by type of question, and answers by an injected provider."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import work
from . import diff, responses, search
from .cache import ContentCache

#: Items of a part and requests of a block, which meet in one task, and requests of one product of matrices.
ITEMS, BLOCK, REQUESTS = 16384, 4096, 512
#: The largest limit of any type.
MOST_FOUND = max(limit for limit, *_ in search.CONTEXT.values())
#: What a product of matrices may differ from the exact cosine, with room for what rounding to six places makes equal.
NEAR = 2e-6
#: What a request gets for which nothing is found.
NOTHING = "(no relevant context)"


def item_id(identifier: Column, name: Column, path: Column) -> Column:
    """The given id, else name:path, else both with all other signs replaced."""
    given = lambda c: F.coalesce(c.cast("string"), F.lit("")) != ""
    rest = F.concat(F.lit("item_name_"), F.coalesce(name, F.lit("")), F.lit("_filePath_"), F.coalesce(path, F.lit("")))
    return F.when(given(identifier), identifier.cast("string")).when(given(name) & given(path), F.concat_ws(":", name, path)).otherwise(F.regexp_replace(rest, "[^a-zA-Z0-9_]", "_"))


class VectorStore:
    """A table of vectors in a folder; each change writes a new version, readers keep theirs while it is among the last `keep`."""

    def __init__(self, spark: SparkSession, root: str, key: str = "id", vector: str = "vector", keep: int = 5) -> None:
        self.spark, self.root, self.key, self.vector, self.keep = spark, root.rstrip("/"), key, vector, max(2, keep)

    def _versions(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        done = (s.getPath() for s in fs.listStatus(path))
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(p.getName()[1:]) for p in done if p.getName().startswith("v") and fs.exists(hadoop(p, "_SUCCESS")))

    def read(self) -> DataFrame:
        versions = self._versions()
        if not versions:
            raise ValueError(f"no vectors under {self.root}")
        return self.spark.read.parquet(f"{self.root}/v{versions[-1]}")

    def _write(self, rows: DataFrame) -> DataFrame:
        """A new version.  Its number is claimed by making its folder's mark, which only one writer can; a writer that comes late fails."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = hadoop(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())
        versions = self._versions()
        new = versions[-1] + 1 if versions else 0
        mark = hadoop(f"{self.root}/claim-{new}")
        if not fs.createNewFile(mark):
            raise RuntimeError(f"another writer makes version {new} of {self.root}")
        try:
            search.checked_dimension(rows, self.vector).write.mode("overwrite").parquet(f"{self.root}/v{new}")
        except BaseException:
            fs.delete(mark, False)
            raise
        for old in versions[: max(0, len(versions) + 1 - self.keep)]:
            fs.delete(hadoop(f"{self.root}/v{old}"), True)
            fs.delete(hadoop(f"{self.root}/claim-{old}"), False)
        return self.read()

    def upsert(self, items: DataFrame) -> DataFrame:
        return self._write(diff.upsert(self.read(), items, self.key) if self._versions() else items)

    def delete(self, keys: DataFrame) -> DataFrame:
        return self._write(without(self.read(), keys, self.key))

    def search(self, query: list[float], **options) -> DataFrame:
        return search.search(self.read(), query, self.key, self.vector, **options)


def without(items: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return items.join(keys.select(key).distinct(), key, "left_anti")


def parameters(kind: Column) -> tuple[Column, Column]:
    """(limit, least score) by type of question."""
    of = lambda i: F.create_map(*[F.lit(x) for name, v in search.CONTEXT.items() for x in (name, v[i])])[search.retrieval_type(kind)]
    return F.coalesce(of(0), F.lit(search.CONTEXT["explanation"][0])), F.coalesce(of(1), F.lit(search.CONTEXT["explanation"][1]))


def retrieve(items: DataFrame, requests: DataFrame, key: str, vector: str, least: Column | None = None) -> DataFrame:
    """request, rank, key, score: the nearest items of each request within its type's limit and least score.

    requests: request, kind, query.  Items and requests are dealt by their counted rows, and each part meets each block as matrices, so
    no task grows with either.  Of a part only what may be among a request's nearest, give or take NEAR, is scored
    exactly, term by term as `vectors.cosine`.  least: in place of the type's score.
    """
    limit, score = parameters(F.col("kind"))
    whole = lambda v: F.col(v).isNotNull() & ~F.exists(v, lambda x: x.isNull())
    given = F.col("query").cast("array<double>").alias("query")
    asked = work.stored(requests.where(whole("query")).select("request", given, limit.cast("int").alias("limit"), (score if least is None else least).cast("double").alias("least")), "requests")
    own = items.where(whole(vector)).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    parts, blocks = (max(1, -(-df.count() // size)) for df, size in ((own, ITEMS), (asked, BLOCK)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = own.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int")).withColumn("block", every(blocks))
    right = asked.withColumn("block", F.pmod(F.xxhash64("request"), F.lit(blocks)).cast("int")).withColumn("part", every(parts))
    kinds = f"key {items.schema[key].dataType.simpleString()}, request {requests.schema['request'].dataType.simpleString()}, limit int, least double, score double"
    found = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(_near, kinds).withColumn("score", F.round("score", 6)).where("score >= least")
    place = F.row_number().over(Window.partitionBy("request").orderBy(F.desc("score"), "key"))
    return found.withColumn("rank", place).where(F.col("rank") <= MOST_FOUND).where("rank <= limit").select("request", "rank", F.col("key").alias(key), "score")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = pa.concat_arrays(column.chunks)
    sizes = np.unique(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    if len(sizes) != 1:
        raise ValueError("vectors differ in length")
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), int(sizes[0]))


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows, summed term by term from the first, as `vectors.dot`."""
    out = np.zeros(len(a))
    for x, y in zip(a.T, b.T, strict=True):
        out += x * y
    return out


def _near(items: pa.Table, asked: pa.Table) -> pa.Table:
    """key, request, limit, least, cosine: of each request the items that may be among its nearest MOST_FOUND here."""
    if not len(items) or not len(asked):
        rows, at = np.zeros(0, np.int64), np.zeros(0, np.int64)
        exact = np.zeros(0)
    else:
        a, b, least = _matrix(items["vector"]), _matrix(asked["query"]), asked["least"].to_numpy()
        if a.shape[1] != b.shape[1]:
            raise ValueError("vectors differ in length")
        with np.errstate(all="ignore"):
            na, nb = np.sqrt(_dots(a, a)), np.sqrt(_dots(b, b))
            found = []
            for start in range(0, len(b), REQUESTS):
                part = slice(start, start + REQUESTS)
                norms = nb[part, None] * na
                score = np.where(norms == 0, 0.0, b[part] @ a.T / norms)
                score[np.isnan(score)] = np.inf  # greater than any number for Spark too
                last = max(0, len(a) - MOST_FOUND)
                floor = np.maximum(np.partition(score, last, axis=1)[:, last], least[part])
                i, j = np.nonzero(score >= floor[:, None] - NEAR)
                found.append((j, i + start))
            rows, at = (np.concatenate(x) for x in zip(*found, strict=True))
            norms = na[rows] * nb[at]
            exact = np.where(norms == 0, 0.0, _dots(a[rows], b[at]) / norms)
    told = asked.select(["request", "limit", "least"]).take(pa.array(at))
    return pa.table({"key": items["key"].take(pa.array(rows)), "request": told["request"], "limit": told["limit"], "least": told["least"], "score": exact})


def answers(requests: DataFrame, items: DataFrame, provider: Callable[[list[str]], list[str]], key: str = "id", vector: str = "vector", budget: float = 4000, cache: ContentCache | None = None) -> DataFrame:
    """request, prompt, answer, files: retrieval, packing, prompt and the injected provider (list of prompts -> list of answers).

    requests: request, question, query; items: key, vector, file_path, start_line, content.  A request with an empty question keeps
    its row, without prompt and answer.  With a cache (of strings) equal prompts are asked once, known ones not at all, and a
    prompt for which the provider fails has no answer.
    """
    asked = requests.where(F.trim("question") != "").withColumn("kind", search.question_type(F.col("question")))
    found = retrieve(items, asked, key, vector).join(items.drop(vector), key)
    packed = search.pack_context(found.select("request", "rank", "file_path", "start_line", "content"), budget)
    rows = asked.join(packed, "request", "left").select("request", responses.prompt(F.col("question"), F.col("kind"), F.coalesce("context", F.lit(NOTHING))).alias("prompt"))

    def run(parts):
        for pdf in parts:
            pdf["answer"] = provider(pdf["prompt"].tolist())
            yield pdf

    kind = requests.schema["request"].dataType.simpleString()
    if cache is None:
        done = rows.mapInPandas(run, f"request {kind}, prompt string, answer string")
    else:
        rows = work.stored(rows, "prompts")
        done = rows.join(cache.through(rows, "request", "prompt", provider).select("request", F.col("value").alias("answer")), "request", "left")
    empty = requests.where("question IS NULL OR trim(question) = ''").select("request", F.lit(None).cast("string").alias("prompt"), F.lit(None).cast("string").alias("answer"))
    return done.unionByName(empty).withColumn("files", responses.files(F.col("answer")))


def _context(asked: DataFrame, items: DataFrame, key: str, vector: str, budget: float) -> DataFrame:
    """asked (request, kind, query and more) with the packed context of each."""
    found = retrieve(items, asked.select("request", "kind", "query"), key, vector).join(items.drop(vector), key)
    packed = search.pack_context(found.select("request", "rank", "file_path", "start_line", "content"), budget)
    return asked.join(packed, "request", "left")


def _answered(rows: DataFrame, provider: Callable[[list[str]], list[str]], cache: ContentCache) -> DataFrame:
    """rows with the answer to their prompt; null where the provider fails."""
    rows = work.stored(rows, "prompts")
    return rows.join(cache.through(rows, "request", "prompt", provider).select("request", F.col("value").alias("answer")), "request", "left")


def aspects(requests: DataFrame, items: DataFrame, provider: Callable[[list[str]], list[str]], cache: ContentCache, key: str = "id", vector: str = "vector", budget: float = 6000) -> DataFrame:
    """request, prompt, analysis, recommendations: an analysis of an aspect of the code.

    requests: request, aspect (architecture, patterns, conventions, dependencies), depth, focus, query.  Equal prompts are asked once,
    known ones not at all; where the provider fails, the analysis says so and recommends nothing.
    """
    asked = requests.withColumn("kind", F.when(F.col("aspect").isin("architecture", "patterns"), "architecture").otherwise("explanation"))
    rows = _context(asked, items, key, vector, budget).select("request", "aspect", responses.aspect_prompt(F.col("aspect"), F.col("depth"), F.col("focus"), F.col("context")).alias("prompt"))
    failed = F.concat(F.lit("Failed to analyze "), "aspect")
    listed = F.coalesce(responses.recommended(F.col("answer")), F.array().cast("array<string>"))
    return _answered(rows, provider, cache).select("request", "prompt", F.coalesce("answer", failed).alias("analysis"), listed.alias("recommendations"))


def standards(requests: DataFrame, items: DataFrame, patterns: DataFrame, provider: Callable[[list[str]], list[str]], cache: ContentCache, key: str = "id", vector: str = "vector", budget: float = 5000) -> DataFrame:
    """request, prompt, standards: the standards that the code follows, from context and the five best patterns of confidence .8 or more.

    requests: request, category (null: all), query; patterns: name, frequency, confidence, description.  Known prompts are not asked again.
    """
    best = patterns.where("confidence >= 0.8").orderBy(F.desc("frequency"), F.desc("confidence"), "name").limit(5)
    told = best.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("frequency")).alias("f"), "name", "description"))), lambda x: F.concat_ws(": ", x["name"], x["description"])), "\n").alias("known"))  # five rows
    asked = requests.withColumn("kind", F.lit("explanation")).crossJoin(F.broadcast(told))  # one row
    rows = _context(asked, items, key, vector, budget).select("request", responses.standards_prompt(F.col("category"), F.nullif(F.col("known"), F.lit("")), F.col("context")).alias("prompt"))
    return _answered(rows, provider, cache).select("request", "prompt", F.coalesce("answer", F.lit("Failed to generate living standards documentation")).alias("standards"))


def relations(edges: DataFrame, component: str, kinds: list[str] | None = None, depth: int = 1) -> DataFrame:
    """Edges of the given types within `depth` steps of a component, in either direction, with their distance."""
    own = edges if kinds is None else edges.where(F.col("type").isin(*kinds))
    seen = edges.sparkSession.createDataFrame([(component, 0)], "node string, distance int")
    out = None
    for step in range(1, depth + 1):
        ends = own.select("type", "source_id", "target_id", F.explode(F.array("source_id", "target_id")).alias("node"))
        touched = ends.join(seen.select("node"), "node", "left_semi").select("type", "source_id", "target_id").distinct().withColumn("distance", F.lit(step))
        out = touched if out is None else out.unionByName(touched)
        reached = touched.select(F.explode(F.array("source_id", "target_id")).alias("node")).withColumn("distance", F.lit(step))
        seen = seen.unionByName(reached).groupBy("node").agg(F.min("distance").alias("distance"))
    return out.groupBy("type", "source_id", "target_id").agg(F.min("distance").alias("distance"))


def preceding_comments(lines: Column, start: Column, most: int = 10) -> Column:
    """The comment lines right before line `start` (1-based), at most `most`, in order."""
    before = F.slice(lines, F.greatest(F.lit(1), start - most), F.least(F.lit(most), start - 1))
    comment = lambda x: F.trim(x).rlike(r"^(//|#|\*|/\*|\"\"\"|''')")
    last = F.array_max(F.transform(before, lambda x, i: F.when(~comment(x), i + 1).otherwise(0)))
    return F.slice(before, F.coalesce(last, F.lit(0)) + 1, F.size(before))
