"""Terms, n-grams, and regular expressions over text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of comments that carry no topic.
STOP_WORDS = (
    "the", "and", "a", "an", "in", "on", "at", "to", "for", "with",
    "by", "of", "this", "that", "it", "from", "as", "be", "is", "are",
    "was", "were", "been", "being", "have", "has", "had", "do", "does",
    "did", "but", "or", "if", "while", "when",
)
# Words of names and comments that are too common in code to be concepts, unless they are abbreviations.
COMMON_WORDS = (
    "get", "set", "add", "remove", "create", "delete", "update", "fetch",
    "init", "start", "stop", "handle", "process", "execute", "run", "parse",
    "load", "save", "build", "make", "test", "check", "validate", "verify",
    "format", "convert", "transform", "calculate", "compute", "count",
    "index", "key", "value", "item", "element", "node", "component", "module",
    "util", "utility", "helper", "service", "factory", "provider", "manager", "controller",
    "model", "view", "template", "function", "method", "callback", "event",
    "listener", "handler", "config", "setup", "main", "app", "default",
    "container", "wrapper", "context", "store", "state", "props",
    "param", "arg", "input", "output", "result", "response", "request", "data",
    "info", "error", "warning", "log", "debug", "temp", "tmp", "flag", "enabled",
    "disabled", "active", "visible", "hidden", "selected", "current", "next",
    "prev", "first", "last", "new", "old", "min", "max", "sum", "avg",
    "file", "dir", "folder", "path", "name", "id", "src", "source",
)
# Technical abbreviations, which are never common words.
ABBREVIATIONS = (
    "ai", "ml", "nlp", "api", "gui", "ui", "ux", "sdk", "cli", "css", "dom",
    "ssl", "tls", "jwt", "io", "db", "orm", "sql", "fk", "pk", "cdn", "dns",
    "ip", "tcp", "udp", "http", "url", "uri", "rest", "spa", "pwa", "ssr",
    "csr", "ci", "cd", "vm", "os", "fs", "cpu", "ram", "ssd", "hdd",
    "dev", "prod", "qa", "uat", "src", "lib", "doc", "docs", "env", "var",
    "mvc", "mvp", "mvvm", "di", "ioc", "dao", "dto", "vo", "ddd", "tdd", "bdd",
    "nn", "cnn", "rnn", "lstm", "gru", "gan", "ocr", "tts", "stt", "lm",
    "llm", "rag", "gu", "ug", "uf", "au", "ur",
)
# Module names that make their words important.
SIGNIFICANT_MODULES = ("index", "main", "core", "types", "constants", "config", "api", "service", "model", "schema", "store", "context", "provider", "controller", "router", "utils", "helpers", "common", "shared")

# Statement patterns of source code; the group is the module, symbol or list.
IMPORT_PATTERNS = {
    "es": r"""import\s+(?:[^'";]+?\s+from\s+)?['"]([^'"]+)['"]""",
    "commonjs": r"""require\s*\(\s*['"]([^'"]+)['"]\s*\)""",
    "python": r"(?m)^[ \t]*import[ \t]+([\w.]+)[ \t]*$",
    "python_from": r"(?m)^[ \t]*from[ \t]+([\w.]+)[ \t]+import\b",
    "ruby": r"""(?m)^[ \t]*require(?:_relative)?[ \t]+['"]([\w\-/.]+)['"]""",
    "go": r"""(?m)^[ \t]*import[ \t]+\(?\s*"([\w\-/.]+)\"""",
    "java": r"(?m)^[ \t]*import[ \t]+(?:static[ \t]+)?([\w.]+\*?);",
    "csharp": r"(?m)^[ \t]*using[ \t]+([\w.]+);",
    "php": r"(?m)^[ \t]*use[ \t]+([\w\\]+)(?:[ \t]+as[ \t]+\w+)?;",
    "php_file": r"""require(?:_once)[ \t]*\(?[ \t]*['"]([\w\-/.]+)['"]""",
}
EXPORT_PATTERNS = {"declaration": r"export\s+(?:const|let|var|function|class|interface|type|enum)\s+(\w+)", "default": r"export\s+default\s+(?:class\s+|function\s+)?(\w+)", "list": r"export\s*\{([^}]*)\}"}
HEADER_PATTERNS = {"shebang": r"^#!\s*(\S+)", "xml": r"^<\?xml\b", "doctype": r"(?i)^<!DOCTYPE\s+(\w+)", "php": r"^<\?php"}
# How code names events, terms of the domain, and capitalised phrases.
EVENT_CALLS, EVENT_NAME = "(?:emit|on|dispatch|addEventListener|subscribe)", r"\b(?:on|handle|event)([A-Z][a-zA-Z0-9]*)\b"
DOMAIN_TERMS = (
    r"data\s+(?:flow|structure|model|source|sink|store)",
    r"(?:code|file|directory)\s+structure",
    r"(?:semantic|concept|pattern)\s+(?:analysis|extraction|discovery)",
    r"(?:user|input|data)\s+validation",
    r"(?:error|exception)\s+handling",
    r"(?:async|synchronous)\s+(?:processing|operation|function)",
    r"state\s+management",
    r"(?:api|service)\s+(?:call|request|response)",
    r"dependency\s+injection",
    r"event\s+(?:handler|listener|emitter)",
    r"(?:database|storage)\s+(?:connection|query|operation)",
)
CAPITALISED = r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+"


def is_common(word: Column) -> Column:
    """A lower-case word that is too common in code to be a concept."""
    return word.isin(*COMMON_WORDS) & ~word.isin(*ABBREVIATIONS)


def word_list(text: Column, least: int = 1) -> Column:
    """Lower-case words of ASCII letters, digits and underscores."""
    plain = F.split(F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9_]+", " ")), " ")
    return F.filter(plain, lambda w: F.length(w) >= least)


def ngrams(words: Column, n: int) -> Column:
    """Runs of n words, joined by a space.  (Zipped shifts: a lambda that indexes the words would compute them for each run.)"""
    runs = words
    for k in range(1, n):
        runs = F.zip_with(runs, F.slice(words, k + 1, 1 << 30), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.filter(runs, lambda x: x.isNotNull())


def term_counts(df: DataFrame, terms: Column, id_column: str) -> DataFrame:
    """term, occurrences, documents."""
    long = df.select(F.col(id_column).alias("id"), F.explode(terms).alias("term"))
    per = long.groupBy("term", "id").agg(F.count("*").alias("n"))  # first by document: no distinct count over hot terms
    return per.groupBy("term").agg(F.sum("n").alias("occurrences"), F.count("*").alias("documents"))


def matches(df: DataFrame, content: str, patterns: dict[str, str], keep: list[str]) -> DataFrame:
    """One row per match: kept columns, pattern, groups' first match as `found`."""
    each = [F.struct(F.lit(name).alias("pattern"), F.regexp_extract_all(F.col(content), F.lit(p), F.lit(1)).alias("all")) for name, p in patterns.items()]
    return df.select(*keep, F.explode(F.array(*each)).alias("m")).select(*keep, "m.pattern", F.explode("m.all").alias("found"))


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of a 1-based character offset."""
    head = F.substring(text, F.lit(1), offset - 1)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def line_diff(old: DataFrame, new: DataFrame, text: str = "text") -> DataFrame:
    """Positional line differences of two one-row (or keyed by `key`) tables: key, line, before, after, change."""
    a = old.select("key", F.posexplode(F.split(text, "\n")).alias("line", "before"))
    b = new.select("key", F.posexplode(F.split(text, "\n")).alias("line", "after"))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed")
    return a.join(b, ["key", "line"], "full").where(~F.col("before").eqNullSafe(F.col("after"))).withColumn("change", change)


def event_names(content: Column, least: int = 3) -> Column:
    """Distinct events that a text emits or listens to by quoted name, and those that its identifiers name (onSaved: saved)."""
    called = [F.regexp_extract_all(content, F.lit(rf"{EVENT_CALLS}\s*\(\s*{q}([^{q}]+){q}"), F.lit(1)) for q in ("'", '"', "`")]
    named = F.transform(F.regexp_extract_all(content, F.lit(EVENT_NAME), F.lit(1)), lambda x: F.concat(F.lower(F.left(x, F.lit(1))), F.substring(x, 2, 1 << 30)))
    return F.filter(F.array_distinct(F.concat(*called, named)), lambda x: F.length(x) >= least)


def key_phrases(text: Column) -> Column:
    """Words beyond two characters that carry a topic, their runs of two and three, the first of each domain term, and capitalised phrases in lower case."""
    words = F.filter(word_list(text, 3), lambda w: ~w.isin(*STOP_WORDS) & ~is_common(w))
    joined = F.array_join(words, " ")
    domain = F.filter(F.array(*[F.regexp_extract(joined, p, 0) for p in DOMAIN_TERMS]), lambda x: x != "")
    capitalised = F.transform(F.regexp_extract_all(text, F.lit(CAPITALISED), F.lit(0)), F.lower)
    return F.concat(words, domain, ngrams(words, 2), ngrams(words, 3), capitalised)


#: Patterns up to which every text is searched for each; of more, a pattern is tried where the rarest of its whole words stands.
WHOLE = 512
#: Texts that hold a word, beyond which several tasks share them when patterns are looked up by that word.
HOT_TEXTS = 1 << 16


def whole_words(regex: str) -> list[str]:
    """Words (ASCII letters, digits, underscores) that stand as such in every match: plain, with plain other signs or blanks on both sides; none if that is not sure."""
    import re

    if "|" in regex or "(?" in regex or re.search(r"\)[*?{+]", regex):
        return []
    words, run, left = [], "", False  # left: a sign that is no part of a word stands before the run
    for m in re.finditer(r"(\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|[()]|.)([*+?{]?)", regex, re.S):
        sign, times = m.groups()
        if sign in "()" and not times:
            continue
        plain = sign[-1] if len(sign) == 2 and sign[0] == "\\" else sign
        if len(sign) == 1 and re.fullmatch(r"[A-Za-z0-9_]", sign) and not times:
            run += sign
            continue
        if len(sign) == 1:
            other = sign not in ".^$*+?{}[]" and sign.isascii() and not sign.isalnum()
        elif sign[0] == "[":
            other = re.fullmatch(r"\[['\" ;,=]+\]", sign) is not None
        else:
            other = plain == "s" or plain.isascii() and not plain.isalnum() and plain != "_"
        other = other and times in ("", "+")
        if run and left and other:
            words.append(run)
        run, left = "", other
    return words


def all_matches(df: DataFrame, key: str, content: str, patterns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(every match of every pattern, patterns that are no regular expressions).

    patterns: pattern (its id), regex, confidence (null: .8); a table, so that patterns may be mined or come from a registry.  Matches: key,
    pattern, nth (from 0), match, offset (from 1), line, groups (by number; "" where a group takes no part), confidence.  A
    bad pattern is left out and told with its message.  The valid ones are compiled once per task.  Beyond WHOLE patterns those
    with whole words meet texts by a join on such a word; those without are tried on every text, in lists of about WHOLE.  No
    table that grows with texts or patterns is broadcast (the sizes that Spark assumes for made-up strings are far too small).
    """
    import pandas as pd

    from ..sources import work

    def checked(batches):
        import re

        for batch in batches:
            errors = []
            for regex in batch["regex"]:
                try:
                    re.compile(regex)
                    errors.append(None)
                except (re.error, TypeError) as e:
                    errors.append(str(e))
            words = [[] if e else whole_words(r) for r, e in zip(batch["regex"], errors, strict=True)]
            yield batch.assign(error=pd.Series(errors, dtype=object), words=pd.Series(words, dtype=object))

    told = work.spread(patterns, "pattern").select("pattern", "regex", F.coalesce(F.col("confidence"), F.lit(0.8)).cast("double").alias("confidence")).mapInPandas(checked, "pattern string, regex string, confidence double, error string, words array<string>")
    told = work.stored(told, "patterns")
    good = told.where("error IS NULL").drop("error")
    texts = df.select(F.col(key).alias("key"), F.col(content).alias("content")).where("content IS NOT NULL")
    listed = F.collect_list(F.struct("pattern", "regex", "confidence")).alias("patterns")
    many, few = good.count() > WHOLE, good
    if many:
        few = good.where("size(words) = 0")
        n = few.count()
    if many and n > WHOLE:
        lists = few.groupBy(F.pmod(F.xxhash64("pattern"), F.lit(-(-n // max(1, WHOLE)))).alias("list")).agg(listed).drop("list")
        long = texts.join(lists.hint("shuffle_replicate_nl"))
    else:
        long = texts.crossJoin(F.broadcast(few.agg(listed)))  # one row, of WHOLE patterns at most
    if many:
        each = good.select("pattern", "regex", "confidence", F.explode("words").alias("word"))
        rarest = each.join(each.groupBy("word").agg(F.count("*").alias("n")).hint("merge"), "word").groupBy("pattern", "regex", "confidence").agg(F.min_by("word", F.struct("n", "word")).alias("word"))
        held = texts.select("key", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit("[A-Za-z0-9_]+"), F.lit(0)))).alias("word")).distinct()
        held = work.stored(held, "words")
        hot = work.stored(held.groupBy("word").agg(F.ceil(F.count("*") / HOT_TEXTS).cast("int").alias("salts")).where("salts > 1"), "words")  # one of HOT_TEXTS rows at most
        salts = F.coalesce("salts", F.lit(1))
        held = held.join(F.broadcast(hot), "word", "left").select("key", "word", F.pmod(F.xxhash64("key"), salts).cast("int").alias("salt"))
        rarest = rarest.join(F.broadcast(hot), "word", "left").select("pattern", "regex", "confidence", "word", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
        tried = held.join(rarest.hint("merge"), ["word", "salt"]).groupBy("key").agg(listed)  # texts of one key share what is tried
        long = long.where("size(patterns) > 0").unionByName(texts.join(tried.hint("merge"), "key"))

    def found(batches):
        import re
        from functools import lru_cache

        compiled = lru_cache(4096)(re.compile)
        for batch in batches:
            rows = []
            for k, text, patterns in zip(batch["key"], batch["content"], batch["patterns"], strict=True):
                for p in patterns:
                    line, at = 1, 0
                    for nth, m in enumerate(compiled(p["regex"]).finditer(text)):
                        line += text.count("\n", at, m.start())
                        at = m.start()
                        rows.append((k, p["pattern"], nth, m.group(), at + 1, line, [g or "" for g in m.groups()], p["confidence"]))
            yield pd.DataFrame(rows, columns=["key", "pattern", "nth", "match", "offset", "line", "groups", "confidence"])

    kind = df.schema[key].dataType.simpleString()
    return long.mapInPandas(found, f"key {kind}, pattern string, nth int, match string, offset int, line int, groups array<string>, confidence double"), told.where("error IS NOT NULL").select("pattern", "regex", "error")
