"""Content hashes and ids from natural keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(*parts: Column) -> Column:
    """SHA-256 in hex of the parts joined by colons; nulls count as empty."""
    return F.sha2(F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def edge_hash(kind: Column, source: Column, target: Column, weight: Column) -> Column:
    return content_hash(kind, source, target, weight)


def list_hash(*parts: Column) -> Column:
    """Hash over scalars and sorted id lists."""
    return F.sha2(F.concat_ws(":", *parts), 256)


def pattern_hash(name: Column, kind: Column, signature: Column, instances: Column) -> Column:
    return content_hash(name, kind, signature, instances)


def data_node_hash(name: Column, role: Column, node: Column, metadata: Column) -> Column:
    """metadata: a map or struct; it counts as JSON."""
    return content_hash(name, role, node, F.to_json(metadata))


def cluster_hash(name: Column, members: Column, kind: Column) -> Column:
    """members: a list of ids, in the order in which they count."""
    return content_hash(name, F.array_join(members.cast("array<string>"), ","), kind)
