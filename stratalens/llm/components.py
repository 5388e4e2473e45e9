"""Connected components of an edge table, by alternating large and small stars.

Every round is written to the shared folder, so neither edges nor components reach the driver and a lost
executor costs one round's tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b) with a > b.  Large: links larger neighbours to the least one; small: the smaller ones."""
    if large:
        ends = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        ends = edges
    least = shared.stored(ends.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("a", "least")), "least")
    met = ends.join(least, "a")
    if large:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        out = met.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
    return shared.stored(out.where("a <> b").distinct(), "edges")


def components(edges: DataFrame) -> DataFrame:
    """edges: two columns of one ordered type, in any direction.  Returns node, root (least node); nodes without a link to another are left out."""
    a, b = edges.columns
    edges = shared.stored(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct(), "edges")
    before = None
    while (now := _state(edges)) != before:
        before = now
        edges = _star(_star(edges, True), False)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
