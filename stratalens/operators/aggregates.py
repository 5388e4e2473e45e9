"""Counts, dominant values, shares and ranks per group.  Ties go to the smaller value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def totals(df: DataFrame, keys: list[str], size: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("files"), F.sum(size).cast("long").alias("total_size"))


def value_counts(df: DataFrame, group: list[str], value: str) -> DataFrame:
    return df.groupBy(*group, value).agg(F.count("*").alias("n"))


def dominant(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """The most frequent value of each group, its count and its share.  The rows are counted first; what is ranked is one row per value."""
    counted = value_counts(df, group, value)
    best = F.min(F.struct((-F.col("n")).alias("minus"), F.col(value).alias("value"))).alias("best")
    found = counted.groupBy(*group).agg(best, F.sum("n").alias("total"))
    return found.select(*group, F.col("best.value").alias("dominant"), (-F.col("best.minus")).alias("n"), "total", F.round(-F.col("best.minus") / F.col("total"), 6).alias("share"))


def shares(df: DataFrame, group: list[str], value: str) -> DataFrame:
    counted = value_counts(df, group, value)
    return counted.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(*group)), 6))


def share_of_all(df: DataFrame, value: str) -> DataFrame:
    counted = df.groupBy(value).agg(F.count("*").alias("n"))
    whole = counted.agg(F.sum("n").alias("total"))
    return counted.crossJoin(F.broadcast(whole)).select(value, "n", F.round(100 * F.col("n") / F.col("total"), 6).alias("percent"))  # one row of totals


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def frequent(df: DataFrame, key: Column, name: str, least: int) -> DataFrame:
    """Groups with at least `least` rows; null keys are none."""
    return df.select(key.alias(name)).where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def affixes(df: DataFrame, name: str, longest: int, shortest: int = 3, suffix: bool = False, keep: list[str] | None = None) -> DataFrame:
    """One row per prefix (or suffix) of each name, up to half its length."""
    most = F.least(F.floor(F.length(name) / 2), F.lit(longest)).cast("int")
    rows = df.where(most >= shortest).select(*(keep or []), name, F.explode(F.sequence(F.lit(shortest), most)).alias("k"))
    text = F.col(name)
    return rows.withColumn("affix", F.lower(F.right(text, F.col("k")) if suffix else F.left(text, F.col("k"))))


def reference_sample(df: DataFrame, group: str, key: str, share: float, least: int, most: int) -> DataFrame:
    """A deterministic sample per group, by the order of the keys' MD5: the sampling operator's share, within its bounds.

    Rows are counted by group and slice of the hash; the counts tell where the sample ends, and rows are ranked within one
    slice only, so that a group of any size is never sorted in one task.
    """
    own = df.withColumn("__hash", F.md5(F.col(key).cast("string"))).withColumn("__slice", F.left("__hash", F.lit(3)))
    counts = own.groupBy(F.col(group).alias("__group"), F.col("__slice").alias("__at")).agg(F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy("__group"))
    so_far = F.sum("n").over(Window.partitionBy("__group").orderBy(F.asc_nulls_last("__at")))
    taken = F.least(F.greatest(F.ceil(F.col("n_group") * share), F.lit(least)), F.lit(most))
    ends = counts.withColumns({"n_group": whole, "__before": so_far - F.col("n")}).where(F.col("__before") < taken)
    met = own.join(ends.drop("n"), F.col(group).eqNullSafe(F.col("__group")) & F.col("__slice").eqNullSafe(F.col("__at")))
    nth = F.col("__before") + F.row_number().over(Window.partitionBy("__group", "__at").orderBy("__hash", key))
    return met.withColumn("nth", nth).where(F.col("nth") <= taken).drop("__hash", "__slice", "__group", "__at", "__before")
