"""Vector search, filters, and context packing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors

# Result limit and least score by type of question.
CONTEXT = {"explanation": (8, 0.75), "implementation": (5, 0.8), "architecture": (15, 0.65), "bug": (12, 0.6)}
# Words that tell the type of a question, in order.
QUESTION_WORDS = (
    ("pattern", ("pattern", "architecture", "design", "structure")),
    ("relationship", ("relationship", "connect", "between", "interact", "depends")),
    ("implementation", ("implement", "add feature", "create", "extend", "write code")),
    ("bug", ("bug", "fix", "error", "issue", "problem")),
    ("standard", ("standard", "convention", "best practice", "guideline")),
)
RETRIEVAL = {"standard": "implementation", "pattern": "architecture", "relationship": "architecture"}
OMITTED = "(further content of this file omitted)"


def condition(spec: dict[str, Any]) -> Column:
    """A Column from a nested filter document ($eq $ne $gt $gte $lt $lte $in $nin $and $or)."""
    compare = {"$eq": lambda c, v: c == v, "$ne": lambda c, v: c != v, "$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v, "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v, "$in": lambda c, v: c.isin(*v), "$nin": lambda c, v: ~c.isin(*v)}
    out = []
    for key, value in spec.items():
        if key in ("$and", "$or"):
            out.append(reduce((lambda a, b: a & b) if key == "$and" else (lambda a, b: a | b), map(condition, value)))
        elif isinstance(value, dict):
            out += [compare[op](F.col(key), v) for op, v in value.items()]
        else:
            out.append(F.col(key) == value)
    return reduce(lambda a, b: a & b, out) if out else F.lit(True)


def scored(items: DataFrame, query: list[float], vector: str) -> DataFrame:
    return items.withColumn("score", vectors.cosine(F.col(vector), F.array(*map(F.lit, map(float, query)))))


def search(items: DataFrame, query: list[float], key: str, vector: str, limit: int = 5, min_score: float = 0.7, where: dict[str, Any] | None = None) -> DataFrame:
    """Filter, score, threshold, then the best `limit`."""
    rows = scored(items.where(condition(where or {})), query, vector)
    return rows.where(F.col("score") >= min_score).orderBy(F.desc("score"), key).limit(limit)


def similar(items: DataFrame, query: list[float], key: str, vector: str, limit: int = 10, min_score: float = 0.8) -> DataFrame:
    """The best `limit`, then the threshold."""
    return scored(items, query, vector).orderBy(F.desc("score"), key).limit(limit).where(F.col("score") >= min_score)


def checked_dimension(items: DataFrame, vector: str) -> DataFrame:
    """The items; an error if their vectors differ in length."""
    sizes = items.agg(F.min(F.size(vector)).alias("low"), F.max(F.size(vector)).alias("high")).first()
    if sizes["low"] != sizes["high"]:
        raise ValueError(f"vectors of {sizes['low']} and {sizes['high']} dimensions")
    return items


def question_type(text: Column) -> Column:
    from ..functions.names import any_contains, first_of

    low = F.lower(text)
    return first_of([(any_contains(low, words), kind) for kind, words in QUESTION_WORDS], "explanation")


def retrieval_type(kind: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in RETRIEVAL.items() for x in kv])[kind], kind)


def pack_context(results: DataFrame, budget: float) -> DataFrame:
    """Per request: the context text of its results within a token budget (a quarter of a token per character).

    results: request, rank, file_path, start_line, content.  Files in order of their best rank, snippets by line; a
    file's header always counts; a snippet beyond the budget ends its file with a note, and the next file is tried
    unless the budget is exceeded already.  The results of one request are bounded by its search limit.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        total, out = 0.0, []
        for path, own in sorted(pdf.groupby("file_path", sort=False), key=lambda x: x[1]["rank"].min()):
            if total > budget:
                break
            header = f"File: {path}\n"
            out.append(header)
            total += len(header) * 0.25
            for row in own.sort_values(["start_line", "rank"]).itertuples():
                cost = len(row.content) * 0.25
                if total + cost > budget:
                    out.append(OMITTED + "\n")
                    break
                out.append(row.content + "\n")
                total += cost
        return pd.DataFrame({"request": [pdf["request"].iloc[0]], "context": ["".join(out)], "tokens": [total]})

    return results.groupBy("request").applyInPandas(run, f"request {results.schema['request'].dataType.simpleString()}, context string, tokens double")


def content_slice(content: Column, start: Column, end: Column) -> Column:
    """Lines start..end (1-based, clamped)."""
    lines = F.split(content, "\n")
    low = F.greatest(start, F.lit(1))
    return F.array_join(F.slice(lines, low, F.greatest(F.least(end, F.size(lines)) - low + 1, F.lit(0))), "\n")


def embed(items: DataFrame, provider, key: str, text: str, batch: int = 20, longest: int = 8000) -> DataFrame:
    """Vectors of non-empty texts by an injected provider (list of texts -> list of vectors), in batches."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                yield pd.DataFrame({key: part[key], "vector": provider([t[:longest] for t in part[text]])})

    rows = items.where(F.length(F.trim(text)) > 0).select(key, text)
    return rows.mapInPandas(run, f"{key} {items.schema[key].dataType.simpleString()}, vector array<double>")
