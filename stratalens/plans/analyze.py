"""The whole analysis of a source tree as a graph of stages, and its incremental form."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashes, names, paths, text
from ..operators import clustering, dataflow, dependencies, diff, patterns, relationships, semantics, units
from ..sources import nodes, tree
from .stages import Graph, Stage, Tables

Given = Mapping[str, DataFrame]
SYMBOLS = "type NOT IN ('module', 'parameter')"


def _relationships(t: Given) -> DataFrame:
    own, files = t["code_nodes"], t["files"]
    named = own.where("type IN ('class', 'interface')").select(F.col("name").alias("base"), F.col("id").alias("definition"))
    inherits = relationships.resolve_names(relationships.inheritance(own.where("type = 'class'")), named, "base")
    stems = files.withColumn("pattern", names.file_pattern(paths.stem(F.col("path")))).where("pattern <> '*'")
    edges = relationships.containment(own, F.col("parent_id"), F.col("id"))
    edges = edges.unionByName(relationships.containment(files.where("parent_path <> ''"), F.col("parent_path"), F.col("path")))
    edges = edges.unionByName(relationships.import_edges(t["imports"]))
    edges = edges.unionByName(inherits.select(F.col("kind").alias("type"), F.col("child_id").alias("source_id"), "target_id", F.lit(0.8).alias("weight"), "confidence"))
    edges = edges.unionByName(relationships.similar_files(stems, ["pattern", "extension"], "path"))
    return edges.withColumn("id", hashes.edge_hash(F.col("type"), F.col("source_id"), F.col("target_id"), F.col("weight")))


def _import_links(t: Given) -> DataFrame:
    return t["imports"].where("resolved_path IS NOT NULL").select(F.col("path").alias("source_id"), F.col("resolved_path").alias("target_id"))


def _patterns(t: Given) -> DataFrame:
    own, files = t["code_nodes"].where(SYMBOLS), t["files"]
    rolled, pairs = t["dependencies"], dependencies.co_occurrence(t["imports"], "path", "module")
    built = dependencies.architecture(rolled, dependencies.module_groups(pairs), _import_links(t))
    return patterns.discover(own, files).unionByName(patterns.organisation(files)).unionByName(patterns.dependency_architecture(built))


def _members(t: Given) -> DataFrame:
    """node_id, concept, directory of the symbols whose names hold a concept."""
    own = t["code_nodes"].where(SYMBOLS).select(F.col("id").alias("node_id"), "name", paths.dirname(F.col("path")).alias("directory"))
    best = t["concepts"].select(F.col("name").alias("concept")).distinct()
    return own.withColumn("concept", F.explode(F.array_distinct(names.words(F.col("name"))))).join(best, "concept", "left_semi")


def _concept_links(t: Given) -> DataFrame:
    """a, b, kind, strength: concepts that share nodes, and concepts whose nodes are linked."""
    members = t["concept_members"]
    links = t["relationships"].where("type <> 'contains'").select("source_id", "target_id")
    out = semantics.block_overlaps(members, "concept", "node_id").select("a", "b", F.lit("shared").alias("kind"), F.col("jaccard").alias("strength"))
    return out.unionByName(semantics.edge_links(links, members).select("a", "b", F.lit("linked").alias("kind"), F.col("strength").cast("double")))


def _units(t: Given) -> DataFrame:
    """Units of patterns, concepts, directories and densely linked components: type, name, confidence, cohesion."""
    members = t["concept_members"]
    own = t["code_nodes"].where(SYMBOLS).select(F.col("id").alias("node_id"), "name", paths.dirname(F.col("path")).alias("directory"))
    best = t["concepts"].groupBy("name").agg(F.max("confidence").alias("confidence"))
    links = t["relationships"].where("type <> 'contains'").select("source_id", "target_id")
    out = semantics.pattern_units(t["patterns"]).unionByName(semantics.concept_units(best, semantics.coherence(members, links)))
    placed = own.select("directory", F.col("node_id").alias("id"), "name")
    found = units.directory_units(placed, members.select(F.col("node_id").alias("id"), "concept"), links, "directory")
    out = out.unionByName(found.select(F.lit("directory").alias("type"), F.col("directory").alias("name"), "confidence", F.col("coherence").alias("cohesion")))
    ends = own.select("node_id")
    pairs = links.join(ends.withColumnRenamed("node_id", "source_id"), "source_id", "left_semi").join(ends.withColumnRenamed("node_id", "target_id"), "target_id", "left_semi")
    groups = clustering.dense_groups(pairs.where("source_id <> target_id").select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")))
    titled = units.group_name(groups.join(own, groups["node"] == own["node_id"]).select("group", "name"), "group")
    return out.unionByName(titled.select(F.lit("component").alias("type"), F.col("title").alias("name"), F.lit(0.75).alias("confidence"), F.lit(0.8).alias("cohesion")))


def _clusters(t: Given, least: float = 0.6) -> DataFrame:
    """cluster, node: symbols of one type and directory that similar names, structures and edges connect; a lone one is in none."""
    own = clustering.elements(t["code_nodes"], t["relationships"]).where(SYMBOLS).withColumn("block", F.concat_ws("/", "type", paths.dirname(F.col("path"))))
    found = clustering.components(clustering.combined_pairs(own, "block", "id", least, clustering.ELEMENT_METRICS))
    return found.select(F.col("root").alias("cluster"), "node")


def _call_edges(calls: DataFrame) -> DataFrame:
    return calls.select(F.lit("calls").alias("type"), F.col("caller").alias("source_id"), F.col("callee").alias("target_id"), "context").distinct()


def _flows(t: Given) -> DataFrame:
    """Direct, call, member, shared-state, event and name flows; those of names within one directory."""
    own, calls = t["code_nodes"], t["calls"]
    symbols = own.where(SYMBOLS)
    told = own.where("type IN ('function', 'method')").select("id", F.explode(text.event_names(F.col("content"))).alias("event"), F.col("content").rlike(r"\b(?:emit|dispatch)\s*\(").alias("emits"))
    out = dataflow.direct(_call_edges(calls), t["df_nodes"])
    for more in (dataflow.call_flows(calls, own), dataflow.member_flows(own), dataflow.shared_state(dataflow.accesses(own)), dataflow.event_flows(told.where("emits"), told.where("NOT emits")), dataflow.name_pattern_flows(symbols)):
        out = out.unionByName(more)
    return out


STAGES = [
    Stage("directories", {"files": ("path", "language")}, lambda t: tree.directories(t["files"])),
    Stage("languages", {"files": ("language", "extension", "size")}, lambda t: tree.languages(t["files"])),
    Stage("code_nodes", {"files": ("path", "language", "content", "line_count")}, lambda t: nodes.code_nodes(t["files"]), "path"),
    Stage("import_statements", {"files": ("path", "content")}, lambda t: relationships.imports(t["files"]), "path"),
    Stage("exports", {"files": ("path", "content")}, lambda t: relationships.exports(t["files"]), "path"),
    Stage("call_sites", {"code_nodes": ()}, lambda t: nodes.call_sites(t["code_nodes"]), "path"),
    Stage("packages", {"files": ("path", "content")}, lambda t: dependencies.declared_packages(t["files"]), "path"),
    Stage("imports", {"import_statements": ("path", "module", "pattern", "n"), "files": ("path",)}, lambda t: relationships.resolve_imports(t["import_statements"], t["files"])),
    Stage("calls", {"call_sites": ("caller", "path", "name", "nth", "arguments", "result", "context"), "code_nodes": ("id", "path", "type", "name")}, lambda t: dataflow.resolved_calls(t["call_sites"], t["code_nodes"])),
    Stage("dependencies", {"imports": ("path", "module"), "files": ("path",), "packages": ("package", "version")}, lambda t: dependencies.typed(dependencies.roll_up(t["imports"].withColumnRenamed("path", "file"), "module", "file"), t["files"], dependencies.least_versions(t["packages"]))),
    Stage("relationships", {"code_nodes": ("id", "type", "name", "parent_id", "content"), "files": ("path", "parent_path", "extension"), "imports": ("path", "resolved_path")}, _relationships),
    Stage("patterns", {"code_nodes": ("id", "type", "name", "path"), "files": ("path", "name", "language"), "imports": ("path", "module", "resolved_path"), "dependencies": ("module", "import_count")}, _patterns),
    Stage("concepts", {"code_nodes": ("id", "type", "name", "parent_id", "content")}, lambda t: semantics.concepts(t["code_nodes"])),
    Stage("concept_members", {"code_nodes": ("id", "type", "name", "path"), "concepts": ("name",)}, _members),
    Stage("concept_links", {"concept_members": ("node_id", "concept"), "relationships": ("type", "source_id", "target_id")}, _concept_links),
    Stage("semantic_units", {"code_nodes": ("id", "type", "name", "path"), "concept_members": ("node_id", "concept", "directory"), "concepts": ("name", "confidence"), "relationships": ("type", "source_id", "target_id"), "patterns": ("name", "confidence", "frequency")}, _units),
    Stage("clusters", {"code_nodes": ("id", "type", "name", "path", "language", "parent_id", "start_line", "end_line"), "relationships": ("type", "source_id", "target_id")}, _clusters),
    Stage("df_nodes", {"code_nodes": ("id", "type", "name", "content"), "calls": ("caller", "callee", "context")}, lambda t: dataflow.with_endpoints(dataflow.nodes(t["code_nodes"]), t["code_nodes"], _call_edges(t["calls"]))),
    Stage("df_flows", {"code_nodes": ("id", "type", "name", "path", "parent_id", "position", "start_line", "content"), "calls": ("caller", "path", "callee", "nth", "arguments", "result", "context"), "df_nodes": ("node_id",)}, _flows),
    Stage("df_paths", {"df_flows": ("source_id", "target_id", "origin"), "df_nodes": ("node_id", "role")}, lambda t: dataflow.paths(t["df_flows"].where("origin = 'direct'"), t["df_nodes"])),
    Stage("df_path_names", {"df_paths": ("nodes", "entry", "exit"), "df_nodes": ("node_id", "name", "role")}, lambda t: dataflow.named_paths(t["df_paths"], t["df_nodes"])),
    Stage("df_edges", {"df_flows": ("source_id", "target_id", "type", "confidence"), "relationships": ("type", "source_id", "target_id")}, lambda t: dataflow.relationship_rows(t["df_flows"], t["relationships"])),
]

#: The analysis; a caller's own stages: GRAPH.extended(Stage(...)).
GRAPH = Graph({"files": "path"}, STAGES)


def analyse(files: DataFrame, graph: Graph = GRAPH) -> dict[str, DataFrame]:
    """All tables as plans over the files, nothing written."""
    out = {"files": files}
    for stage in (s for level in graph.levels() for s in level):
        out[stage.name] = stage.run(out)
    return out


def stored(files: DataFrame, out: str, graph: Graph = GRAPH) -> Tables:
    """The analysis, each table written once under `out` and read from there by what follows."""
    return graph.build({"files": files}, files.sparkSession, out)


def full(spark: SparkSession, root: str, out: str, exclude: list[str] | None = None, max_depth: int | None = 5, graph: Graph = GRAPH) -> dict[str, DataFrame]:
    return stored(tree.scan(spark, root, exclude, max_depth), out, graph).all()


def incremental(spark: SparkSession, root: str, old: str, out: str, exclude: list[str] | None = None, max_depth: int | None = 5, graph: Graph = GRAPH) -> tuple[DataFrame, list[str], dict[str, DataFrame]]:
    """(status of each path, stages that ran, all tables; without a change the old ones and nothing under `out`).

    Tables whose rows depend on one file alone get the rows of the touched files on top of the old ones, which stay where they are
    (keep the old root); the others are made anew only if something that they read changed.
    """
    before = Tables.load(spark, old)
    files = tree.scan(spark, root, exclude, max_depth)
    status = diff.diff(before.read("files"), files, "path", "content_hash")
    return (status, *update(before, files, status, out, graph))


def update(before: Tables, files: DataFrame, status: DataFrame, out: str, graph: Graph = GRAPH) -> tuple[list[str], dict[str, DataFrame]]:
    """As `incremental`, for given files (all, or the changed ones alone) and their status."""
    touched = status.where("status <> 'unchanged'").select("path")
    if touched.isEmpty():
        return [], before.all()
    tables, ran = graph.update(before, {"files": files.join(touched, "path", "left_semi")}, touched, "path", out)
    return ran, tables.all()


def targeted(spark: SparkSession, root: str, changed: list[str], old: str, out: str, graph: Graph = GRAPH) -> tuple[list[str], dict[str, DataFrame]]:
    """An update of named paths alone, without a scan of the tree: those that are there are read, the others are gone."""
    files = tree.named(spark, root, changed)
    status = spark.createDataFrame([(p,) for p in changed], "path string").withColumn("status", F.lit("modified"))
    return update(Tables.load(spark, old), files, status, out, graph)


def statistics(tables: Mapping[str, DataFrame]) -> DataFrame:
    """name, rows of every table, in one job."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = part if out is None else out.unionByName(part)
    return out
