"""Prompts from retrieved context, and rows from the text that answers them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import first_of

NO_CONTEXT = "No relevant context was found."
PATTERN = "array<struct<name:string,description:string,type:string,confidence:double>>"


def prompt(question: Column, kind: Column, context: Column) -> Column:
    """Question, its type and the packed context as one text."""
    return F.concat(F.lit("Type: "), kind, F.lit("\nQuestion: "), question, F.lit("\n\nContext:\n"), F.coalesce(context, F.lit(NO_CONTEXT)))


def json_text(answer: Column) -> Column:
    """The fenced block of an answer, else its outermost array or object, else null."""
    fenced = F.regexp_extract(answer, r"(?s)```(?:json)?\s*(.*?)```", 1)
    bare = F.regexp_extract(answer, r"(?s)(\[.*\]|\{.*\})", 1)
    return F.coalesce(F.nullif(fenced, F.lit("")), F.nullif(bare, F.lit("")))


def patterns(answers: DataFrame, key: str, answer: str) -> DataFrame:
    """key, name, description, type, confidence: from a JSON array, an object with `patterns`, one object, or sections "Pattern n: name"."""
    text = json_text(F.col(answer))
    inner = F.from_json(text, F.lit(f"struct<patterns:{PATTERN}>"))["patterns"]
    one = F.from_json(text, F.lit(PATTERN[6:-1]))
    parsed = F.when(F.startswith(F.ltrim(text), F.lit("[")), F.from_json(text, F.lit(PATTERN))).otherwise(F.coalesce(inner, F.when(one["name"].isNotNull(), F.array(one))))
    empty = F.lit(None).cast("string")
    sections = F.transform(F.regexp_extract_all(answer, F.lit(r"(?m)^\W*Pattern\s+\d+\s*:\s*(.+?)\W*$"), F.lit(1)), lambda n: F.struct(n.alias("name"), empty.alias("description"), empty.alias("type"), F.lit(0.5).alias("confidence")))
    rows = F.filter(F.coalesce(F.when(F.size(parsed) > 0, parsed), sections), lambda x: x["name"].isNotNull())
    return answers.select(key, F.explode(rows).alias("p")).select(key, "p.name", "p.description", "p.type", "p.confidence")


def files(answer: Column) -> Column:
    """Distinct paths that a text names after FILE: or in a context header."""
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(r"(?im)^\s*FILE:\s*\[?([^\]\s]+)"), F.lit(1)))


def recommendations(answers: DataFrame, key: str, answer: str) -> DataFrame:
    """key, place, recommendation: list items of a text, in order."""
    items = F.regexp_extract_all(answer, F.lit(r"(?m)^\s*(?:[-*]|\d+[.)])\s+(.+)$"), F.lit(1))
    return answers.select(key, F.posexplode(items).alias("place", "recommendation"))


RELATION = "array<struct<source:string,target:string,type:string,description:string>>"
# Headings under which guidance is given, and verbs that begin advice.
GUIDANCE = (("architecture", "architect"), ("modify", "modify|change"), ("create", "new file|create"), ("steps", "step"))
ADVICE = ("Consider", "Implement", "Add", "Remove", "Refactor", "Improve", "Update", "Enhance", "Fix", "Create", "Maintain", "Ensure")


def relationships(answers: DataFrame, key: str, answer: str) -> DataFrame:
    """key, source, target, type, description: from a JSON array, an object with `relationships`, one object, or sections "Relationship n:" with fields.

    Rows without a source or a target are left out; a missing type is "Undefined".
    """
    text = json_text(F.col(answer))
    inner = F.from_json(text, F.lit(f"struct<relationships:{RELATION}>"))["relationships"]
    one = F.from_json(text, F.lit(RELATION[6:-1]))
    parsed = F.when(F.startswith(F.ltrim(text), F.lit("[")), F.from_json(text, F.lit(RELATION))).otherwise(F.coalesce(inner, F.when(one["source"].isNotNull(), F.array(one))))
    field = lambda s, name: F.trim(F.regexp_extract(s, rf"{name}:?[ \t]*([^\n]*)", 1))
    about = lambda s: F.regexp_extract(s, r"(?s)Description:?\s*(.*?)\s*(?=#{2,3}|Source:|$)", 1)
    sections = F.transform(F.split(answer, r"(?=#{2,3}\s+Relationship:|Relationship \d+:)"), lambda s: F.struct(field(s, "Source").alias("source"), field(s, "Target").alias("target"), F.nullif(field(s, "Type"), F.lit("")).alias("type"), about(s).alias("description")))
    rows = F.filter(F.coalesce(F.when(F.size(parsed) > 0, parsed), sections), lambda x: (x["source"] != "") & (x["target"] != ""))
    return answers.select(key, F.explode(rows).alias("r")).select(key, "r.source", "r.target", F.coalesce("r.type", F.lit("Undefined")).alias("type"), F.coalesce("r.description", F.lit("")).alias("description"))


def guidance(answers: DataFrame, key: str, answer: str) -> DataFrame:
    """key, part, place, item: list items under the headings on architecture, files to modify, files to create (their paths alone), and steps."""
    long = answers.select(key, F.explode(F.split(answer, r"(?m)^(?=#{1,4}\s)")).alias("s"))
    heading = F.lower(F.regexp_extract("s", r"^#{1,4}\s+([^\n]*)", 1))
    parts = long.select(key, first_of([(heading.rlike(p), name) for name, p in GUIDANCE]).alias("part"), F.regexp_extract_all("s", F.lit(r"(?m)^\s*(?:[-*]|\d+[.)])\s+(.+)$"), F.lit(1)).alias("items"))
    rows = parts.where("part IS NOT NULL").select(key, "part", F.posexplode("items").alias("place", "item"))
    path = F.regexp_extract("item", r"`?([^`\s:]+\.[a-zA-Z]+)`?", 1)
    return rows.withColumn("item", F.when(F.col("part").isin("modify", "create"), path).otherwise(F.col("item"))).where("item <> ''")


def advice(found: DataFrame) -> DataFrame:
    """The recommendations (see above) that begin with a verb of advice."""
    return found.where(F.col("recommendation").rlike("^(" + "|".join(ADVICE) + ")"))


def recommended(answer: Column) -> Column:
    """The list items below a heading "Recommendations"; without one, all list items that begin with a verb of advice."""
    item = F.lit(r"(?m)^\s*(?:[-*]|\d+[.)])\s+(.+)$")
    section = F.regexp_extract(answer, r"(?ims)^(?:#{2,3}\s*Recommendations|Recommendations:)[^\n]*\n(.*?)(?=^#{2,3}|\z)", 1)
    advised = F.filter(F.regexp_extract_all(answer, item, F.lit(1)), lambda x: x.rlike("^(" + "|".join(ADVICE) + ")"))
    return F.transform(F.when(section != "", F.regexp_extract_all(section, item, F.lit(1))).otherwise(advised), lambda x: F.trim(x))


def aspect_prompt(aspect: Column, depth: Column, focus: Column, context: Column) -> Column:
    """What to analyse, how deeply (1 to 3, 2 if null), with which focus, over the packed context."""
    how = F.when(F.coalesce(depth, F.lit(2)) == 1, "in outline").when(F.coalesce(depth, F.lit(2)) == 2, "in moderate detail").otherwise("in full detail")
    on = F.when(F.coalesce(focus, F.lit("")) != "", F.concat(F.lit("\nFocus: "), focus)).otherwise("")
    return F.concat(F.lit("Aspect: "), aspect, F.lit("\nAnalyse it "), how, F.lit(", then list actions to recommend."), on, F.lit("\n\nContext:\n"), F.coalesce(context, F.lit(NO_CONTEXT)))


def standards_prompt(category: Column, patterns: Column, context: Column) -> Column:
    """Which standards to find (null: all), the patterns known, and the packed context."""
    return F.concat(F.lit("Standards: "), F.coalesce(category, F.lit("all")), F.lit("\nFor each: what it is, examples, violations.\n\nPatterns:\n"), F.coalesce(patterns, F.lit("none")), F.lit("\n\nContext:\n"), F.coalesce(context, F.lit(NO_CONTEXT)))
