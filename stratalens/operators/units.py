"""Semantic units of directories and clusters, and what names tell of a group.

members: group, id, name.  Names within a group are compared by counts of words and affixes, never pair by pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import names, text


def affix_score(length: Column) -> Column:
    """A common prefix or suffix beyond two characters counts an eighth a character, one at most."""
    return F.when(length > 2, F.least(F.lit(1.0), length / 8)).otherwise(0.0)


def name_similarity(members: DataFrame, group: str) -> DataFrame:
    """group, similarity of its names by their common prefix and suffix; a tenth at least, a half for a lone name."""
    own = members.groupBy(group).agg(F.count("*").alias("n"), F.min("name").alias("low"), F.max("name").alias("high"), F.min(F.reverse("name")).alias("rlow"), F.max(F.reverse("name")).alias("rhigh"))
    prefix, suffix = F.length(names.common_prefix(F.array("low", "high"))), F.length(names.common_prefix(F.array("rlow", "rhigh")))
    score = F.greatest(affix_score(prefix), affix_score(suffix), F.lit(0.1))
    return own.select(group, F.round(F.when(F.col("n") < 2, 0.5).otherwise(score), 6).alias("similarity"))


def coverage(members: DataFrame, concepts: DataFrame, group: str, most: int = 3) -> DataFrame:
    """group, coverage: the share of its members that have one of its `most` most frequent concepts.  concepts: id, concept."""
    own = members.select(group, "id").join(concepts.distinct(), "id")
    counts = own.groupBy(group, "concept").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "concept"))
    top = counts.withColumn("place", place).where(F.col("place") <= most).select(group, "concept")
    covered = own.join(top, [group, "concept"], "left_semi").groupBy(group).agg(F.count_distinct("id").alias("covered"))
    sizes = members.groupBy(group).agg(F.count_distinct("id").alias("n"))
    return sizes.join(covered, group, "left").select(group, "n", F.round(F.coalesce("covered", F.lit(0)) / F.col("n"), 6).alias("coverage"))


def density(members: DataFrame, edges: DataFrame, group: str) -> DataFrame:
    """group, inner: its members' distinct undirected edges among themselves.  edges: source_id, target_id."""
    a, b = members.select(F.col("id").alias("a"), F.col(group).alias("ga")), members.select(F.col("id").alias("b"), F.col(group).alias("gb"))
    pairs = edges.select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).where("a <> b").distinct()
    return pairs.join(a, "a").join(b, "b").where("ga = gb").groupBy(F.col("ga").alias(group)).agg(F.count("*").alias("inner"))


def directory_units(members: DataFrame, concepts: DataFrame, edges: DataFrame, group: str, least: int = 3, coherent: float = 0.4) -> DataFrame:
    """group, n, coherence, confidence of the groups of enough members whose coherence exceeds the threshold.

    Coherence: half the coverage by the three main concepts, a fifth name similarity, three tenths edge density.
    """
    found = coverage(members, concepts, group).where(F.col("n") >= least).join(name_similarity(members, group), group).join(density(members, edges, group), group, "left")
    dense = F.least(F.lit(1.0), F.coalesce("inner", F.lit(0)) / (F.col("n") * (F.col("n") - 1) / 2))
    found = found.withColumn("coherence", F.round(0.5 * F.col("coverage") + 0.2 * F.col("similarity") + 0.3 * dense, 6)).where(F.col("coherence") > coherent)
    return found.select(group, "n", "coherence", F.round(F.least(F.lit(0.9), 0.6 + 0.3 * F.col("coherence")), 6).alias("confidence"))


def naming_patterns(members: DataFrame, group: str, affix: float = 0.5, convention: float = 0.7) -> DataFrame:
    """group, kind, value, share: prefixes and suffixes of at least half of a group's names, a casing of seven tenths."""
    kinds = (("prefix", names.name_prefix(F.col("name")), affix), ("suffix", names.name_suffix(F.col("name")), affix), ("casing", names.casing(F.col("name")), convention))
    each = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value"), F.lit(share).alias("least")) for k, v, share in kinds])
    sizes = members.groupBy(group).agg(F.count("*").alias("size"))
    counts = members.select(group, F.explode(each).alias("p")).where("p.value IS NOT NULL").groupBy(group, "p.kind", "p.value", "p.least").agg(F.count("*").alias("n"))
    return counts.join(sizes, group).where(F.col("n") / F.col("size") >= F.col("least")).select(group, "kind", "value", F.round(F.col("n") / F.col("size"), 6).alias("share"))


def cluster_patterns(members: DataFrame, group: str, least: int = 3, affix: float = 0.5, convention: float = 0.7) -> DataFrame:
    """Naming patterns of the groups of at least three members: value, kind, groups, members."""
    sizes = members.groupBy(group).agg(F.count("*").alias("size")).where(F.col("size") >= least)
    return naming_patterns(members, group, affix, convention).join(sizes, group).groupBy("kind", "value").agg(F.count("*").alias("groups"), F.sum("size").alias("members"))


def mean_word_overlap(members: DataFrame, group: str) -> DataFrame:
    """group, overlap: the mean Jaccard of the words of all pairs of its names, through the inverted index of words.

    Names with the same words are one with a count, so that a group costs the square of its distinct word sets that share a word.
    """
    sets = members.select(group, F.array_sort(F.array_distinct(names.words(F.col("name")))).alias("w")).groupBy(group, "w").agg(F.count("*").alias("c"))
    sizes = members.groupBy(group).agg(F.count("*").alias("n"))
    same = sets.groupBy(group).agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("s"))
    index = sets.select(group, "w", "c", F.explode("w").alias("x"))
    a, b = index.select(group, "x", F.col("w").alias("wa"), F.col("c").alias("ca")), index.select(group, "x", F.col("w").alias("wb"), F.col("c").alias("cb"))
    met = a.join(b, [group, "x"]).where("wa < wb").groupBy(group, "wa", "wb", "ca", "cb").agg(F.count("*").alias("k"))
    other = met.groupBy(group).agg(F.sum(F.col("ca") * F.col("cb") * F.col("k") / (F.size("wa") + F.size("wb") - F.col("k"))).alias("o"))
    total = F.coalesce("s", F.lit(0.0)) + F.coalesce("o", F.lit(0.0))
    return sizes.where("n > 1").join(same, group).join(other, group, "left").select(group, F.round(total / (F.col("n") * (F.col("n") - 1) / 2), 6).alias("overlap"))


def group_name(members: DataFrame, group: str) -> DataFrame:
    """group, title: its most frequent word of three characters or more, if a third (two at least) of the names have it; else the common prefix; else the first name.  Common words of code name nothing."""
    sizes = members.groupBy(group).agg(F.count("*").alias("n"), F.min("name").alias("low"), F.max("name").alias("high"))
    words = members.select(group, F.explode(names.words(F.col("name"))).alias("word")).where((F.length("word") > 2) & ~text.is_common(F.lower("word")))
    best = words.groupBy(group, "word").agg(F.count("*").alias("c")).groupBy(group).agg(F.min(F.struct((-F.col("c")).alias("m"), "word")).alias("b"))
    prefix = names.common_prefix(F.array("low", "high"))
    title = names.first_of([(-F.col("b.m") >= F.greatest(F.lit(2), F.col("n") / 3), F.col("b.word")), ((F.length(prefix) >= 3) & ~text.is_common(F.lower(prefix)), prefix)], F.col("low"))
    return sizes.join(best, group, "left").select(group, names.capitalised(title).alias("title"))


def tags(members: DataFrame, labels: DataFrame) -> DataFrame:
    """id, tags: the labels (id, label) of each member, sorted; none gives an empty list."""
    own = labels.distinct().groupBy("id").agg(F.array_sort(F.collect_set("label")).alias("tags"))
    return members.select("id").distinct().join(own, "id", "left").select("id", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))
