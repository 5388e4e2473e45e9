"""Source trees as tables, and the model's tables on disk."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import aggregates
from . import walk
from .nodes import code_nodes  # noqa: F401  (a table of the tree)

# Parts of entry names that are never scanned.
EXCLUDED = (
    "node_modules", ".git", "dist", "build", ".cache", ".svn", ".hg", ".bzr", "_build", "vendor", "bower_components", "tmp", "temp", "__pycache__", ".pytest_cache", ".venv", "venv", "env", ".env",
    "bin", "obj", "target", "output", "out", "build-output", "coverage", "logs", ".logs", "log", ".DS_Store", "thumbs.db", ".idea", ".vscode", ".gradle", ".next", "deploy", ".terraform",
)
#: More that a caller may add: caches and lock files of newer tools.
MORE_EXCLUDED = (".mvn", ".nyc_output", ".mypy_cache", ".tox", ".eggs", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", ".turbo", ".parcel-cache", ".svelte-kit", ".nuxt")
#: This library's own folder inside a tree.
OWN_FOLDER = ".stratalens"

# Languages and their extensions.
LANGUAGES = {
    "JavaScript": "js jsx mjs", "TypeScript": "ts tsx", "Python": "py pyi pyx", "Java": "java", "C#": "cs", "PHP": "php phtml", "Ruby": "rb rake", "Go": "go", "Rust": "rs", "C": "c h",
    "C++": "cpp hpp cc hh cxx hxx", "Swift": "swift", "Kotlin": "kt kts", "HTML": "html htm xhtml", "CSS": "css scss sass less styl", "JSON": "json", "YAML": "yml yaml", "XML": "xml svg xsl", "Markdown": "md markdown",
    "Shell": "sh bash zsh", "PowerShell": "ps1 psm1", "SQL": "sql", "R": "r", "Dart": "dart", "Scala": "scala", "Groovy": "groovy", "Perl": "pl pm", "Lua": "lua", "Clojure": "clj cljs cljc", "Haskell": "hs lhs",
    "Erlang": "erl hrl", "Elixir": "ex exs", "Julia": "jl", "MATLAB": "m",
}
LANGUAGE_OF = {f".{e}": name for name, all_ in LANGUAGES.items() for e in all_.split()}

def excluded(path: Column, names: tuple[str, ...] | list[str]) -> Column:
    """Any segment contains any of the names."""
    return F.exists(F.split(path, "/"), lambda s: F.exists(F.array(*map(F.lit, names)), lambda n: F.contains(s, n)))


def exclusions(extra: str = "", own: str = OWN_FOLDER) -> list[str]:
    """The defaults, the own folder and a comma-separated list, trimmed, each once."""
    return list(dict.fromkeys([*EXCLUDED, own, *(x for p in extra.split(",") if (x := p.strip()))]))


def _entered(spark: SparkSession, base: str, names: tuple[str, ...] | list[str]) -> str | list[str]:
    """The entries of the root that are not excluded by name, so that excluded folders there are not even listed.

    The root itself where nothing is excluded, where it has very many entries, or where names hold signs that a path pattern would read.
    """
    if not names:
        return base
    root = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root) or not fs.getFileStatus(root).isDirectory():
        return base
    found = [x.getPath().getName() for x in fs.listStatus(root)]
    kept = [x for x in found if not any(n in x for n in names) and x[0] not in "._"]
    if not kept or len(kept) == len(found) or len(found) > 1000 or any(re.search(r"[\[\]{}*?\\,]", x) for x in kept):
        return base
    return [f"{base}/{x}" for x in kept]


def scan(spark: SparkSession, root: str, exclude: list[str] | None = None, max_depth: int | None = None) -> DataFrame:
    """path (relative), name, extension, parent_path, depth, size, modified, content, content_hash, line_count of each file.

    Directories are listed level by level (sources/walk.py), so nothing below an excluded one is looked at.  Where only Spark
    knows the root's kind of URI, its binary file source reads the tree; that source passes over names that begin with a dot or
    an underscore.
    """
    base = root.rstrip("/")
    names = (*EXCLUDED, OWN_FOLDER) if exclude is None else exclude
    if walk.opened(base):
        return describe(walk.contents(walk.entries(spark, base, names, max_depth).where("is_file"), base))
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(_entered(spark, base, names))
    # what Spark calls the root: its path without the scheme
    inner = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^/*" + _quoted(base.split(":", 1)[-1].strip("/")) + "/", "")
    rows = rows.select(inner.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.decode("content", "UTF-8").alias("content"))
    rows = rows.where(~excluded(F.col("path"), names) if names else F.lit(True))
    rows = describe(rows)
    return rows if max_depth is None else rows.where(F.col("depth") <= max_depth)


def named(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """The rows of `scan` for some paths alone."""
    base = root.rstrip("/")
    return describe(walk.contents(walk.named(spark, base, paths), base))


def listed(files: DataFrame, include_extensions: tuple[str, ...] = (), include_patterns: tuple[str, ...] = (), exclude_extensions: tuple[str, ...] = (), exclude_patterns: tuple[str, ...] = (), include: Column | None = None) -> DataFrame:
    """The files that pass a filter on path and extension.

    `include` takes the place of the included extensions and patterns; exclusions always hold.  A file below a directory whose
    own path fails the exclusion patterns is left out, as is one below a directory that no included pattern matches.
    """
    path, parts = F.col("path"), F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    fits = lambda p, patterns: reduce(lambda a, b: a | b, [p.rlike(x) for x in patterns], F.lit(False))
    keep = F.lit(True) if include is None else include
    if include is None and include_extensions:
        keep &= F.col("extension").isin(*include_extensions)
    if include is None and include_patterns:
        keep &= F.forall(above, lambda p: fits(p, include_patterns))
    if exclude_extensions:
        keep &= ~F.col("extension").isin(*exclude_extensions)
    if exclude_patterns:
        keep &= ~F.exists(above, lambda p: fits(p, exclude_patterns))
    return files.where(keep & path.isNotNull())


def _quoted(text: str) -> str:
    return re.sub(r"([.^$*+?()\[\]{}|\\])", r"\\\1", text)


def describe(rows: DataFrame) -> DataFrame:
    """File columns from path and content."""
    p = F.col("path")
    language = F.create_map(*[F.lit(x) for kv in LANGUAGE_OF.items() for x in kv])
    return rows.withColumns({"name": paths.basename(p), "extension": paths.extension(p), "parent_path": paths.dirname(p), "depth": F.size(F.split(p, "/")) - 1, "content_hash": F.sha2(F.col("content"), 256), "line_count": F.size(F.split("content", "\n"))}).withColumn("language", language[F.col("extension")])


def directories(files: DataFrame) -> DataFrame:
    """path, name, parent_path, files, dominant_language of every directory with files below it."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    long = files.where(F.contains("path", F.lit("/"))).select(F.explode(above).alias("dir"), "language")
    counts = long.groupBy("dir").agg(F.count("*").alias("files"))
    best = aggregates.dominant(long.where("language IS NOT NULL"), ["dir"], "language").select("dir", F.col("dominant").alias("dominant_language"))
    return counts.join(best, "dir", "left").select(F.col("dir").alias("path"), paths.basename(F.col("dir")).alias("name"), paths.dirname(F.col("dir")).alias("parent_path"), "files", "dominant_language")


def languages(files: DataFrame) -> DataFrame:
    return files.where("language IS NOT NULL").groupBy("language").agg(F.count("*").alias("file_count"), F.sum("size").alias("total_size"), F.array_sort(F.collect_set("extension")).alias("extensions"))


MARKERS = ("package.json", "pyproject.toml", "requirements.txt", "pom.xml", "build.gradle", ".git")


def project_roots(files: DataFrame, levels: int = 5) -> DataFrame:
    """path, root: the nearest directory at or above each file's own, up to `levels`, that holds a project marker."""
    marked = files.where(F.col("name").isin(*MARKERS)).select(F.col("parent_path").alias("root")).distinct()
    parts = F.split("parent_path", "/")
    depth = F.when(F.col("parent_path") == "", 0).otherwise(F.size(parts))
    above = F.transform(F.sequence(F.lit(0), F.least(depth, F.lit(levels))), lambda k: F.array_join(F.slice(parts, F.lit(1), depth - k), "/"))
    return files.select("path", F.posexplode(above).alias("up", "root")).join(marked, "root").groupBy("path").agg(F.min_by("root", "up").alias("root"))


def save(tables: dict[str, DataFrame], root: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")


def load(spark: SparkSession, root: str, names: tuple[str, ...]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{root}/{n}") for n in names}
