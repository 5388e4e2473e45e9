"""Expressions over identifier and file names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Casing patterns in the order in which they are tried.
CASINGS = (
    ("PascalCase", "^[A-Z][a-z0-9]*([A-Z][a-z0-9]*)*$"),
    ("camelCase", "^[a-z][a-z0-9]*([A-Z][a-z0-9]*)*$"),
    ("snake_case", "^[a-z][a-z0-9]*(_[a-z0-9]+)*$"),
    ("kebab-case", "^[a-z][a-z0-9]*(-[a-z0-9]+)*$"),
    ("CONSTANT_CASE", "^[A-Z][A-Z0-9]*(_[A-Z0-9]+)*$"),
)
CLUSTER_PREFIXES = ("get", "set", "has", "use")
CLUSTER_SUFFIXES = ("Component", "Service", "Provider", "Controller", "Model", "View", "Helper", "Utils", "Factory", "Store", "Manager", "Handler")
CLASS_SUFFIXES = ("Service", "Controller", "Component", "Model", "Repository", "Factory", "Provider", "Manager")
FUNCTION_PREFIXES = ("get", "set", "is", "has", "create", "build", "handle", "on", "use")
FILE_SUFFIXES = ("Component", "Service", "Controller", "Model", "View", "Util", "Helper", "Factory")
FILE_PREFIXES = ("use", "is", "get", "set", "create", "build", "make")
TAG_PREFIXES = ("get", "set", "is", "has", "use", "on", "handle", "create", "build", "make")
TAG_SUFFIXES = ("Component", "Service", "Controller", "Model", "Repository", "Factory", "Provider", "Manager", "Handler")


def first_of(pairs: list[tuple[Column, object]], default=None) -> Column:
    """CASE: the value of the first condition that holds."""
    head = F.lit(None)
    for i, (condition, value) in enumerate(pairs):
        value = value if isinstance(value, Column) else F.lit(value)
        head = F.when(condition, value) if i == 0 else head.when(condition, value)
    return head.otherwise(default if isinstance(default, Column) else F.lit(default))


def casing(name: Column, unknown: str | None = "unknown") -> Column:
    return first_of([(name.rlike(p), label) for label, p in CASINGS], unknown)


def followed_by_capital(name: Column, prefix: str) -> Column:
    return name.rlike(f"^{prefix}[A-Z]")


def name_prefix(name: Column) -> Column:
    """Accessor prefix of a name of at least six characters."""
    head = F.substring(name, 1, 3)
    return F.when((F.length(name) >= 6) & head.isin(*CLUSTER_PREFIXES), head)


def name_suffix(name: Column) -> Column:
    """A known role suffix, else what follows the last dot."""
    return first_of([(name.endswith(s), s) for s in CLUSTER_SUFFIXES], F.when(F.contains(name, F.lit(".")), F.substring_index(name, ".", -1)))


def words(name: Column) -> Column:
    """Words of a name: by capitals if it has any, else by underscores, else by hyphens, else the name."""
    spaced = F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"))
    parts = first_of([(name.rlike("[A-Z]"), F.split(spaced, r"\s+")), (F.contains(name, F.lit("_")), F.split(name, "_")), (F.contains(name, F.lit("-")), F.split(name, "-"))], F.array(name))
    return F.filter(parts, lambda w: w != "")


def split_identifier(name: Column, abbreviations: tuple[str, ...] = ()) -> Column:
    """Words of an identifier with inner capital runs, separators and letter-digit borders."""
    marked = F.regexp_replace(name, "(?<=[a-z0-9])([A-Z]{2,})(?=[A-Z][a-z])", "_$1_")
    bordered = F.regexp_replace(F.regexp_replace(marked, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    digits = F.regexp_replace(F.regexp_replace(bordered, "([A-Za-z])([0-9])", "$1 $2"), "([0-9])([A-Za-z])", "$1 $2")
    parts = F.filter(F.split(F.lower(F.regexp_replace(digits, r"[_.\-]+", " ")), r"\s+"), lambda w: w != "")
    if not abbreviations:
        return parts
    return F.when((F.length(name) <= 3) & F.lower(name).isin(*abbreviations), F.array(F.lower(name))).otherwise(parts)


def class_suffix(name: Column) -> Column:
    return first_of([(name.endswith(s), s) for s in CLASS_SUFFIXES])


def function_prefix(name: Column) -> Column:
    return first_of([(followed_by_capital(name, p), p) for p in FUNCTION_PREFIXES])


def name_tag(name: Column) -> Column:
    """Significant prefix, else significant suffix of a node name."""
    return first_of([(followed_by_capital(name, p), f"{p}*") for p in TAG_PREFIXES] + [(name.endswith(s), f"*{s}") for s in TAG_SUFFIXES])


def file_labels(stem: Column) -> Column:
    """All naming labels of a file stem: casing, test, role suffix, verb prefix."""
    labels = [casing(stem, None), F.when(stem.rlike(r"(\.|-|_)(test|spec)$|^test_"), "test")]
    labels += [F.when(stem.endswith(s), f"*{s}") for s in FILE_SUFFIXES]
    labels += [F.when(followed_by_capital(stem, p) & (F.length(stem) > len(p) + 1), f"{p}*") for p in FILE_PREFIXES]
    return F.filter(F.array(*labels), lambda x: x.isNotNull())


def file_pattern(stem: Column) -> Column:
    """The naming pattern by which files are compared."""
    pairs = [(stem.endswith(s), s) for s in ("Component", "Test", "Model", "Service", "Controller")]
    pairs += [(stem.endswith("Util") | stem.endswith("Utils") | stem.endswith("Helper"), "Utility"), (followed_by_capital(stem, "use"), "Hook")]
    return first_of(pairs, "*")


def capitalised(name: Column) -> Column:
    return F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 1 << 30))


def common_prefix(names: Column) -> Column:
    """Longest common prefix of an array of strings, by its least and greatest member."""
    low, high = F.array_min(names), F.array_max(names)
    places = F.sequence(F.lit(0), F.least(F.length(low), F.length(high)))
    return F.substring(low, F.lit(1), F.array_max(F.filter(places, lambda k: low.substr(F.lit(1), k) == high.substr(F.lit(1), k))))


def common_suffix(names: Column) -> Column:
    return F.reverse(common_prefix(F.transform(names, F.reverse)))


def jaccard(a: Column, b: Column) -> Column:
    """|a ∩ b| / |a ∪ b|; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def any_contains(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda x, y: x | y, [F.contains(text, F.lit(p)) for p in parts])
