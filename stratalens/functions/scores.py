"""Confidence and importance formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Base importance of a pattern by the type of its nodes.
TYPE_IMPORTANCE = {"class": 0.8, "interface": 0.8, "function": 0.7, "method": 0.7, "enum": 0.7, "type": 0.7, "property": 0.6, "constant": 0.6, "variable": 0.5}


def least(cap: float, value: Column) -> Column:
    return F.least(F.lit(cap), value)


def pattern_importance(kind: Column, count: Column) -> Column:
    base = F.coalesce(F.create_map(*[F.lit(x) for kv in TYPE_IMPORTANCE.items() for x in kv])[kind], F.lit(0.5))
    return least(1.0, base + least(0.3, 0.01 * count))


def identifier_confidence(count: Column, total: Column, types: Column) -> Column:
    return least(0.9, 0.5 + 5 * count / total + 0.2 * types / 4)


def identifier_importance(count: Column, total: Column, types: Column) -> Column:
    return least(0.9, 10 * count / total + 0.2 * types / 4)


def module_confidence(count: Column, total: Column, importance: Column) -> Column:
    return least(0.9, 0.4 + count / total + 0.1 * importance)


def term_confidence(count: Column, importance: Column) -> Column:
    return least(0.85, 0.4 + 0.05 * count + 0.1 * importance)


def term_importance(count: Column, importance: Column) -> Column:
    return least(0.8, 0.3 + 0.02 * count + 0.1 * importance)


def structure_confidence(properties: Column, methods: Column) -> tuple[Column, Column]:
    """(confidence, importance) of a data structure."""
    k = 0.2 + 0.4 * (properties > 0).cast("int") + 0.4 * (methods > 0).cast("int")
    return least(0.9, 0.5 + 0.4 * k), least(0.9, 0.4 + 0.5 * k)


def path_confidence(confidences: Column, nodes: Column) -> Column:
    mean = F.aggregate(confidences, F.lit(0.0), lambda a, x: a + x) / F.size(confidences)
    return F.when(F.size(confidences) == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.5), least(0.95, mean - 0.03 * F.greatest(F.lit(0), nodes - 2))))


def running_confidence(sorted_values: Column) -> Column:
    """(c + x) / 2 folded over an array in its order."""
    return F.aggregate(F.slice(sorted_values, 2, 1 << 30), sorted_values[0], lambda c, x: (c + x) / 2)


def token_estimate(text: Column) -> Column:
    return F.length(text) * 0.25
