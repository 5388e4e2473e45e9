"""Snapshot differences, incremental plans, merges and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import work
from pyspark.sql.window import Window

#: Stages by what their inputs come from; a change reaches all that follow.
CASCADE = {"files": ["languages", "code_nodes"], "code_nodes": ["patterns", "relationships", "dependencies"], "relationships": ["semantics", "data_flow", "clusters"], "patterns": ["semantics"]}


def diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """key, status (added, modified, deleted, unchanged) of every key of either snapshot."""
    a, b = old.select(key, F.col(digest).alias("was"), F.lit(True).alias("old")), new.select(key, F.col(digest).alias("now"), F.lit(True).alias("new"))
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("was").eqNullSafe(F.col("now")), "unchanged").otherwise("modified")
    return a.join(b, key, "full").select(key, status.alias("status"))


def collections_diff(collections: dict[str, tuple[DataFrame, DataFrame]], key: str, digest: str) -> DataFrame:
    """key, status over several collections in one pass; a key is prefixed by its collection's name and a colon."""
    sides = []
    for side in (0, 1):
        own = [pair[side].select(F.concat(F.lit(f"{name}:"), F.col(key).cast("string")).alias(key), digest) for name, pair in collections.items()]
        sides.append(reduce(DataFrame.unionByName, own))
    return diff(*sides, key, digest)


def stages_to_run(changed: set[str]) -> list[str]:
    """All stages that follow from changed collections, in order of discovery."""
    out, queue = [], sorted(changed)
    while queue:
        for stage in CASCADE.get(queue.pop(0), []):
            if stage not in out:
                out.append(stage)
                queue.append(stage)
    return out


def merge(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """New rows; where the digest is unchanged the old row stays; has_changed tells which."""
    columns = [c for c in new.columns if c != key]
    joined = new.alias("n").join(old.alias("o"), key, "left")
    same = F.col(f"o.{digest}").isNotNull() & (F.col(f"o.{digest}") == F.col(f"n.{digest}"))
    return joined.select(key, *(F.when(same, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in columns), (~same).alias("has_changed"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def misses(wanted: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    return wanted.join(cache.select(key), key, "left_anti")


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first in the given order.  Aggregated map-side, not ranked."""
    rest = [c for c in df.columns if c not in [*keys, *order]]
    best = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("best"))
    return best.select(*keys, *(F.col(f"best.{c}").alias(c) for c in [*order, *rest]))


def evict(cache: DataFrame, created: str, key: str, most: int) -> DataFrame:
    """The newest entries of a cache table, at most `most`."""
    return cache.orderBy(F.desc(created), key).limit(most)


def snapshots_delta(df: DataFrame, order: str, value: str) -> DataFrame:
    """Difference of each snapshot to the one before it within its series."""
    before = F.lag(value).over(Window.partitionBy("series").orderBy(order))
    return df.withColumn("delta", F.col(value) - before)


def tree_hashes(files: DataFrame, path: str, digest: str, max_depth: int) -> DataFrame:
    """Bottom-up directory hashes: sha256 of the children's hashes in name order, level by level."""
    from ..functions import paths

    nodes = files.select(F.col(path).alias("path"), F.col(digest).alias("hash"))
    deep = nodes.withColumn("depth", F.size(F.split("path", "/")))
    levels, below = [], None
    for depth in range(max_depth, 0, -1):
        here = deep.where(F.col("depth") == depth + 1).select("path", "hash")
        here = here if below is None else here.unionByName(below)
        below = _directory_hash(here)
        levels.append(below)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def _directory_hash(children: DataFrame) -> DataFrame:
    """path, hash of the directories right above the children (path, hash)."""
    from ..functions import paths

    own = F.sort_array(F.collect_list(F.struct("path", "hash")))
    return children.groupBy(paths.dirname(F.col("path")).alias("path")).agg(F.sha2(F.array_join(F.transform(own, lambda x: x["hash"]), ""), 256).alias("hash"))


def refreshed_hashes(hashes: DataFrame, before: DataFrame, after: DataFrame, path: str, digest: str, max_depth: int) -> DataFrame:
    """path, hash as `tree_hashes(after)`, from the hashes of `before`: only directories above changed paths are hashed again.

    Level by level upwards: the directories above a changed entry are joined to their present children, files and
    directories alike; those whose hash comes out as it was change nothing further up.  A directory without children is gone.
    """
    from ..functions import paths

    status = diff(before.select(F.col(path).alias("path"), F.col(digest).alias("hash")), after.select(F.col(path).alias("path"), F.col(digest).alias("hash")), "path", "hash")
    changed = work.stored(status.where("status <> 'unchanged' AND path LIKE '%/%'").select("path", (F.size(F.split("path", "/")) - 1).alias("depth")), "changed")
    files = after.select(F.col(path).alias("path"), F.col(digest).alias("hash"), paths.dirname(F.col(path)).alias("parent"))
    known = hashes.select("path", "hash", paths.dirname(F.col("path")).alias("parent"))
    fresh = None  # directories hashed again: path, hash (null: gone)
    for depth in range(max_depth, 0, -1):
        above = changed.where(F.col("depth") == depth).select(paths.dirname(F.col("path")).alias("path"))
        if fresh is not None:  # directories one level below that came out otherwise
            other = fresh.where(F.size(F.split("path", "/")) == depth + 1).join(hashes.withColumnRenamed("hash", "old"), "path", "left").where(~F.col("hash").eqNullSafe(F.col("old")))
            above = above.unionByName(other.select(paths.dirname(F.col("path")).alias("path")))
        above = above.distinct()
        parents = above.withColumnRenamed("path", "parent")
        below = known if fresh is None else known.join(fresh.select("path"), "path", "left_anti").unionByName(fresh.where("hash IS NOT NULL").withColumn("parent", paths.dirname(F.col("path"))))
        children = files.unionByName(below).join(parents, "parent", "left_semi").select("path", "hash")
        level = above.join(_directory_hash(children), "path", "left")
        fresh = work.stored(level if fresh is None else fresh.unionByName(level), "hashes")
    return hashes if fresh is None else hashes.join(fresh.select("path"), "path", "left_anti").unionByName(fresh.where("hash IS NOT NULL"))
