"""Naming, structure and architecture patterns over code nodes and files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names, paths, scores
from . import aggregates

PATTERN = ("type", "name", "frequency", "confidence", "importance")
COMMON_DIRECTORIES = ("src", "source", "lib", "app")
# Folders by technical concern, which tell no feature, and the three of one architecture.
TECHNICAL = ("src", "lib", "app", "components", "utils", "helpers", "services", "models", "views", "controllers", "config", "docs", "test", "tests", "specs", "__tests__", "public", "static", "assets", "images", "styles", "css")
MVC = ("models", "views", "controllers")


def _pattern(df: DataFrame, kind: str, name, frequency, confidence, importance) -> DataFrame:
    return df.select(F.lit(kind).alias("type"), name.alias("name"), frequency.cast("long").alias("frequency"), F.round(confidence, 6).alias("confidence"), F.round(importance, 6).alias("importance"))


def structure(nodes: DataFrame, least: int = 3) -> DataFrame:
    counts = aggregates.frequent(nodes, F.col("type"), "node_type", least)
    return _pattern(counts, "structure", F.col("node_type"), F.col("n"), F.lit(0.6), scores.pattern_importance(F.col("node_type"), F.col("n")))


def conventions(nodes: DataFrame, share: float = 0.5, least: int = 3) -> DataFrame:
    """The dominant casing of each node type."""
    styled = nodes.select("type", names.casing(F.col("name")).alias("casing"))
    found = aggregates.dominant(styled, ["type"], "casing").where((F.col("share") > share) & (F.col("total") >= least) & (F.col("dominant") != "unknown"))
    return _pattern(found, "naming", F.concat_ws(":", "type", "dominant"), F.col("n"), F.col("share"), scores.pattern_importance(F.col("type"), F.col("n")))


def affix_patterns(nodes: DataFrame, suffix: bool = False) -> DataFrame:
    """Affixes with enough names (3, or a tenth), and the dominant node type of each."""
    excluded = ("ing", "ed", "ion", "er") if suffix else ("the", "and", "for")
    long = aggregates.affixes(nodes, "name", 8 if suffix else 6, suffix=suffix, keep=["type"]).where(~F.col("affix").isin(*excluded))
    whole = nodes.agg(F.count("*").alias("all"))
    found = aggregates.dominant(long, ["affix"], "type").crossJoin(F.broadcast(whole))  # one row
    found = found.where(F.col("total") >= F.greatest(F.lit(3), F.ceil(F.col("all") * 0.1)))
    return _pattern(found, "suffix" if suffix else "prefix", F.concat_ws(":", "affix", "dominant"), F.col("total"), F.col("share"), scores.pattern_importance(F.col("dominant"), F.col("total")))


def role_names(nodes: DataFrame) -> DataFrame:
    """Class suffixes (from 2) and function prefixes (from 3)."""
    out = None
    for kind, types, label, least, base in (("class_suffix", ("class",), names.class_suffix(F.col("name")), 2, 0.7), ("function_prefix", ("function", "method"), names.function_prefix(F.col("name")), 3, 0.6)):
        own = nodes.where(F.col("type").isin(*types))
        whole = own.agg(F.count("*").alias("all"))
        found = aggregates.frequent(own, label, "label", least).crossJoin(F.broadcast(whole))  # one row
        share = F.col("n") / F.col("all")
        part = _pattern(found, kind, F.col("label"), F.col("n"), share, base + 0.1 * F.least(share, F.lit(0.5)))
        out = part if out is None else out.unionByName(part)
    return out


def directories(files: DataFrame, least: int = 3) -> DataFrame:
    parts = files.select(F.explode(F.array_distinct(F.slice(F.split("path", "/"), F.lit(1), F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0))))).alias("dir"), "path")
    found = aggregates.frequent(parts.where(~F.col("dir").isin(*COMMON_DIRECTORIES)), F.col("dir"), "dir", least)
    return _pattern(found, "directory", F.col("dir"), F.col("n"), F.lit(0.7), scores.least(0.9, 0.5 + 0.02 * F.col("n")))


def architecture(files: DataFrame) -> DataFrame:
    """Rules over counts of roles in file names, in one pass."""
    stem = F.lower(paths.stem(F.col("path")))
    roles = ("model", "view", "viewmodel", "controller", "service")
    counts = files.agg(*[F.count_if(F.endswith(stem, F.lit(r))).alias(r) for r in roles])
    rules = F.array(
        F.when((F.col("model") > 0) & (F.col("view") > 0) & (F.col("controller") > 0), F.struct(F.lit("mvc").alias("name"), (F.col("model") + F.col("view") + F.col("controller")).alias("n"))),
        F.when((F.col("model") > 0) & (F.col("viewmodel") > 0), F.struct(F.lit("mvvm").alias("name"), (F.col("model") + F.col("viewmodel")).alias("n"))),
        F.when(F.col("service") >= 2, F.struct(F.lit("service-oriented").alias("name"), F.col("service").alias("n"))),
    )
    found = counts.select(F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("r")).select("r.*")
    return _pattern(found, "architecture", F.col("name"), F.col("n"), F.lit(0.7), F.lit(0.9))


def organisation(files: DataFrame, least: int = 3) -> DataFrame:
    """How folders are cut: by feature (folders of other than technical names that hold several entries, a folder among them) or by MVC."""
    parts = F.split("path", "/")
    entry = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.struct(F.array_join(F.slice(parts, F.lit(1), k), "/").alias("dir"), F.array_join(F.slice(parts, F.lit(1), k + 1), "/").alias("child"), (k < F.size(parts) - 1).alias("folder")))
    children = files.where(F.contains("path", F.lit("/"))).select(F.explode(entry).alias("e")).select("e.*").distinct()
    held = children.groupBy("dir").agg(F.count("*").alias("entries"), F.max("folder").alias("folders")).withColumn("name", F.lower(paths.basename(F.col("dir"))))
    feature = (F.col("entries") > 1) & F.col("folders") & ~F.col("name").isin(*TECHNICAL)
    counts = held.agg(F.count_if(feature).alias("features"), *[F.count_if(F.col("name") == n).alias(n) for n in MVC])
    row = lambda name, n, confidence, importance: F.struct(F.lit(name).alias("name"), n.cast("long").alias("n"), F.lit(confidence).alias("c"), F.lit(importance).alias("i"))
    rules = F.array(F.when(F.col("features") >= least, row("feature-based", F.col("features"), 0.7, 0.8)), F.when((F.col("models") > 0) & (F.col("views") > 0) & (F.col("controllers") > 0), row("mvc folders", F.lit(3), 0.9, 0.9)))
    found = counts.select(F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("r")).select("r.*")
    return _pattern(found, "organisation", F.col("name"), F.col("n"), F.col("c"), F.col("i"))


def dependency_architecture(found: DataFrame) -> DataFrame:
    """Rows of dependencies.architecture as patterns."""
    return _pattern(found, "dependency", F.col("name"), F.col("n"), F.col("confidence"), F.lit(0.8))


def file_names(files: DataFrame, least: int = 3) -> DataFrame:
    labels = files.select(F.explode(names.file_labels(paths.stem(F.col("path")))).alias("label"))
    found = aggregates.frequent(labels, F.col("label"), "label", least)
    return _pattern(found, "file_naming", F.col("label"), F.col("n"), F.lit(0.7), scores.least(0.9, 0.5 + 0.02 * F.col("n")))


def discover(nodes: DataFrame, files: DataFrame) -> DataFrame:
    out = structure(nodes)
    for part in (conventions(nodes), affix_patterns(nodes), affix_patterns(nodes, True), role_names(nodes), directories(files), architecture(files), file_names(files)):
        out = out.unionByName(part)
    return out


def ordered(patterns: DataFrame) -> DataFrame:
    return patterns.orderBy(F.desc("frequency"), F.desc("confidence"), "name")


def select(patterns: DataFrame, confidence: float = 0.7, limit: int = 10) -> DataFrame:
    return ordered(patterns.where(F.col("confidence") >= confidence)).limit(limit)
