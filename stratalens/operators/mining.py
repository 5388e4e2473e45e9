"""Patterns mined from lines, seeded patterns, and evidence of languages and paradigms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..functions.names import first_of
from ..sources import work

# Evidence of paradigms, and of languages where the extension tells none, in order.
PARADIGMS = {"object-oriented": r"(?i)\b(class|interface|extends|implements|prototype)\b", "functional": r"(?i)\b(function|lambda|=>|->|map|filter|reduce)\b"}
CONTENT_LANGUAGES = (
    ("JavaScript", r"import\s+React|export\s+default|const\s+\w+\s*="),
    ("TypeScript", r"interface\s+\w+|type\s+\w+\s*=|export\s+class"),
    ("Python", r"def\s+\w+\s*\(|import\s+\w+|class\s+\w+\s*:"),
    ("Java", r"public\s+class|private\s+static|package\s+\w+;"),
)
# Words of names that tell a role in the data flow.
ROLE_SEEDS = {
    "data_source": "(input|source|api|fetch|get|provider|read|load|create|generate)",
    "data_sink": "(output|sink|save|write|send|emit|publish|dispatch|persist|set|update)",
    "data_transformer": "(transform|convert|format|parse|map|process|filter|reduce|format|sanitize|normalize)",
    "data_store": "(store|state|cache|repository|db|database|storage|collection|model|container)",
}
# What is counted in a file.
STRUCTURES = {
    "classes": r"\b(?:class|interface)\s+[A-Za-z0-9_]+",
    "functions": r"\b(?:function|def|func)\s+[A-Za-z0-9_]+",
    "imports": r"\b(?:import|require|from|using|include)\b",
    "exports": r"\b(?:export|module\.exports|public|package)\b",
}
#: A paradigm where nothing tells one.
NO_PARADIGM = "general-purpose"
LONGEST_EVIDENCE = 500_000


def lines(files: DataFrame, content: str, keep: list[str]) -> DataFrame:
    """Kept columns, line: the trimmed lines that are not empty."""
    long = files.select(*keep, F.explode(F.split(content, "\n")).alias("line")).withColumn("line", F.trim("line"))
    return long.where("line <> ''")


def first_words(found: DataFrame, group: list[str]) -> DataFrame:
    """group, word, n, share: lines of a group by their first word (letters only, lower case)."""
    word = F.lower(F.regexp_extract("line", r"^([A-Za-z]+)", 1))
    counts = found.withColumn("word", word).where("word <> ''").groupBy(*group, "word").agg(F.count("*").alias("n"))
    total = counts.groupBy(*group).agg(F.sum("n").alias("total"))
    return counts.join(total, group).select(*group, "word", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def mined(found: DataFrame, group: list[str], least: int = 2, share: float = 0.2) -> DataFrame:
    """First words that enough lines of a group begin with, as patterns of that group."""
    return first_words(found, group).where((F.col("n") >= least) & (F.col("share") >= share))


def generalised(line: Column) -> Column:
    """A mined line as a pattern: signs escaped, quoted text a group, numbers any number, blanks any blanks."""
    out = F.regexp_replace(line, r"([.^$*+?()\[\]{}|\\])", r"\\$1")
    out = F.regexp_replace(out, r"'[^']*'|\"[^\"]*\"", r"['\"]([^'\"]+)['\"]")
    out = F.regexp_replace(out, r"(^|[^A-Za-z0-9_\\\[\]])[0-9]+", r"$1\\d+")
    return F.regexp_replace(out, r"\s+", r"\\s+")


def applied(found: DataFrame, patterns: DataFrame, group: list[str]) -> DataFrame:
    """Lines matched by a mined first word, which counts only in groups where it was mined: group, word, matches."""
    word = F.lower(F.regexp_extract("line", r"^([A-Za-z]+)", 1))
    return found.withColumn("word", word).join(patterns.select(*group, "word"), [*group, "word"], "left_semi").groupBy(*group, "word").agg(F.count("*").alias("matches"))


def registry(rows: DataFrame, content: str, patterns: dict[str, str], keep: list[str]) -> DataFrame:
    """Kept columns, pattern, match, at: the first match of each pattern and its 1-based place; content without a match gives no row."""
    c = F.col(content)
    each = [F.struct(F.lit(name).alias("pattern"), F.regexp_substr(c, F.lit(p)).alias("match")) for name, p in patterns.items()]
    out = rows.select(*keep, c.alias("__content"), F.explode(F.array(*each)).alias("m")).where("m.match IS NOT NULL AND m.match <> ''")
    return out.select(*keep, "m.pattern", "m.match", F.instr("__content", F.col("m.match")).alias("at"))


def evidence(files: DataFrame, content: str, group: list[str]) -> DataFrame:
    """group, paradigm, n, share of the group's files; very long files tell nothing."""
    own = files.where(F.length(content) <= LONGEST_EVIDENCE)
    found = F.filter(F.array(*[F.when(F.col(content).rlike(p), name) for name, p in PARADIGMS.items()]), lambda x: x.isNotNull())
    total = files.groupBy(*group).agg(F.count("*").alias("files"))
    counts = own.select(*group, F.explode(found).alias("paradigm")).groupBy(*group, "paradigm").agg(F.count("*").alias("n"))
    return counts.join(total, group).select(*group, "paradigm", "n", F.round(F.col("n") / F.col("files"), 6).alias("share"))


def paradigms(files: DataFrame, content: str, group: list[str], most: int = 3, least: float = 0.0) -> DataFrame:
    """group, paradigms: the `most` most frequent ones with at least that share, or the general one."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("n"), "paradigm"))
    best = evidence(files, content, group).where(F.col("share") >= least).withColumn("place", place).where(F.col("place") <= most)
    best = best.groupBy(*group).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "paradigm"))), lambda x: x["paradigm"]), ",").alias("paradigms"))  # at most `most` each
    return files.select(*group).distinct().join(best, group, "left").select(*group, F.coalesce("paradigms", F.lit(NO_PARADIGM)).alias("paradigms"))


def construct_confidence(share: Column) -> Column:
    """Confidence of a paradigm's pattern by its share of files; null below three tenths."""
    return F.when(share >= 0.3, F.round(F.least(F.lit(0.9), 0.6 + 0.3 * share), 6))


def content_language(content: Column) -> Column:
    """A language by content alone; null if nothing tells one."""
    return first_of([(content.rlike(p), name) for name, p in CONTENT_LANGUAGES])


def shared_places(files: DataFrame, value: str, place: str) -> DataFrame:
    """a, b, places: pairs of values (languages, extensions: few) that occur in the same places."""
    own = files.select(value, place).distinct()
    sets = own.groupBy(place).agg(F.array_sort(F.collect_set(value)).alias("all"))  # at most the number of values
    a = sets.select(F.posexplode("all").alias("i", "a"), "all")
    pairs = a.select("a", F.explode(F.slice("all", F.col("i") + 2, F.size("all"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("places"))


def specifier(statement: Column) -> Column:
    """The module that a statement names: quoted without a blank, else the bare word after import, from, require or use."""
    quoted = F.trim(F.regexp_extract(statement, r"""['"]([^'"]+)['"]""", 1))
    bare = F.regexp_extract(statement, r"\b(?:import|from|require|use)\s+([a-zA-Z_][\w.]*)", 1)
    return F.when((quoted != "") & ~F.contains(quoted, F.lit(" ")), quoted).when(bare != "", bare)


def first_lines(content: Column, pattern: str, most: int = 5) -> Column:
    """The first trimmed lines that match."""
    return F.slice(F.filter(F.transform(F.split(content, "\n"), lambda x: F.trim(x)), lambda x: x.rlike(pattern)), 1, most)


def structure_counts(content: Column) -> list[Column]:
    """lines, and the counts of classes, functions, imports and exports in a content."""
    return [F.size(F.split(content, "\n")).alias("lines"), *[F.regexp_count(content, F.lit(p)).alias(name) for name, p in STRUCTURES.items()]]


def eligible(files: DataFrame, observed: DataFrame) -> DataFrame:
    """files with each pattern that was seen in a file of their extension or language; observed: pattern, extension, language."""
    found = None
    for by in ("extension", "language"):
        seen = observed.where(F.col(by).isNotNull()).select("pattern", by).distinct()
        part = files.join(seen, by).select(*files.columns, "pattern")
        found = part if found is None else found.unionByName(part)
    return found.distinct()


def mined_statements(found: DataFrame) -> DataFrame:
    """pattern, regex, type, confidence: lines that begin with a word of import or export, each in its general form.  found: line."""
    kind = first_of([(F.col("line").rlike(r"^(import|from|require|use|include)\b"), "import"), (F.col("line").rlike(r"^(export|module\.exports)\b"), "export")])
    return found.select(kind.alias("type"), generalised(F.col("line")).alias("regex")).where("type IS NOT NULL").distinct().select(F.sha2("regex", 256).alias("pattern"), "regex", "type", F.lit(0.8).alias("confidence"))


def statements(files: DataFrame, patterns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(imports: path, line, module, confidence; exports: path, line, confidence) by mined patterns (pattern, regex, type, confidence).

    A statement that several patterns match is one row with the best confidence; an import that names no module is none.  Patterns
    of each type are tried apart, so no match is joined with its pattern again (one pattern may match in every file).
    """
    patterns = work.stored(patterns, "patterns")
    imports, exports = (text.all_matches(files, "path", "content", patterns.where(F.col("type") == kind))[0] for kind in ("import", "export"))
    imports = imports.withColumn("module", specifier(F.col("match"))).where("module IS NOT NULL")
    rows = imports.groupBy(F.col("key").alias("path"), "line", "module").agg(F.max("confidence").alias("confidence"))
    return rows, exports.groupBy(F.col("key").alias("path"), "line").agg(F.max("confidence").alias("confidence"))


def connections(imports: DataFrame) -> DataFrame:
    """path, module: what each file is connected to."""
    return imports.select("path", "module").distinct()
