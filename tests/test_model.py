"""Source trees, the analysis, its incremental form, and operators that SQL does not express."""

import pytest
from pyspark.sql import functions as F

from stratalens.functions import names, paths, scores, text, vectors
from stratalens.operators import clustering, dataflow, dependencies, diff, patterns, relationships, search, semantics
from stratalens.plans import analyze
from stratalens.sources import tree
from stratalens.streaming import changes

TREE = {
    "package.json": '{"dependencies": {"react": "1"}}',
    "src/models/userModel.ts": "export class UserModel extends BaseModel {\n  // the user record\n  getValue() { return 1 }\n}\n",
    "src/views/userView.ts": "import {UserModel} from '../models/userModel'\nexport class UserView {\n}\n",
    "src/controllers/userController.ts": "import React from 'react'\nimport {UserModel} from '../models/userModel'\nimport {UserView} from '../views/userView'\nexport class UserController implements Controller, Handler {\n}\n",
    "src/services/userService.ts": "export function fetchInput() {\n  return parseRow()\n}\nfunction parseRow() {\n  return saveRow()\n}\nfunction saveRow() {\n  write(1)\n}\n",
    "src/util/index.ts": "export {x} from './extra'\n",
    "src/util/extra.py": "import os\nfrom models import user\n\ndef helper():\n    return 1\n\nclass Thing(Base):\n    def get_value(self):\n        pass\n",
    "node_modules/x/index.js": "module.exports = 1\n",
    "src/combine.ts": "const a = 1\n",
}


@pytest.fixture
def root(tmp_path):
    for name, content in TREE.items():
        p = tmp_path / "tree" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(content)
    return tmp_path


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_scan(spark, root):
    files = tree.scan(spark, str(root / "tree"))
    found = {r.path: r for r in files.collect()}
    assert "node_modules/x/index.js" not in found and "src/combine.ts" not in found  # "bin" is part of the name
    model = found["src/models/userModel.ts"]
    assert (model.extension, model.parent_path, model.depth, model.line_count, model.language) == (".ts", "src/models", 2, 5, "TypeScript")
    assert len(tree.scan(spark, str(root / "tree"), []).collect()) == len(TREE)
    assert max(r.depth for r in tree.scan(spark, str(root / "tree"), max_depth=1).collect()) <= 1
    assert {r.path: r.dominant_language for r in tree.directories(files).collect()}["src/models"] == "TypeScript"
    assert dict(rows(tree.languages(files), "language", "file_count"))["Python"] == 1
    assert dict(rows(tree.project_roots(files), "path", "root"))["src/util/extra.py"] == ""


def test_nodes_imports_and_inheritance(spark, root):
    files = tree.scan(spark, str(root / "tree"))
    nodes = tree.code_nodes(files)
    assert {("class", "UserModel"), ("function", "fetchInput"), ("function", "helper"), ("class", "Thing"), ("module", "userView")} <= set(rows(nodes, "type", "name"))
    spans = {r.name: (r.start_line, r.end_line) for r in nodes.where("type = 'function'").collect()}
    assert spans["fetchInput"] == (1, 3) and spans["helper"] == (4, 5)
    resolved = relationships.resolve_imports(relationships.imports(files), files)
    found = {(r.path.rsplit("/", 1)[-1], r.module): r.resolved_path for r in resolved.collect()}
    assert found["userController.ts", "../models/userModel"] == "src/models/userModel.ts" and found["userController.ts", "react"] is None
    kinds = {(r.kind, r.base) for r in relationships.inheritance(nodes.where("type = 'class'")).collect()}
    assert {("extends", "BaseModel"), ("implements", "Controller"), ("implements", "Handler"), ("extends", "Base")} <= kinds
    assert {"UserModel", "x"} <= {r.name for r in relationships.exports(files).collect()}


def test_analysis_and_increment(spark, root):
    out = {n: str(root / n) for n in ("one", "two", "three")}
    tables = analyze.full(spark, str(root / "tree"), out["one"])
    kinds = dict(rows(tables["relationships"].groupBy("type").count(), "type", "count"))
    assert kinds["imports"] == 3 and kinds["contains"] > 5
    assert ("mvc",) in rows(tables["patterns"], "name")
    assert [len(r.nodes) for r in tables["df_paths"].collect()] == [3]
    assert {r.name: r.rows for r in analyze.statistics(tables).collect()}["files"] == tables["files"].count()
    status, stages, same = analyze.incremental(spark, str(root / "tree"), out["one"], out["two"])
    assert {r.status for r in status.collect()} == {"unchanged"} and stages == [] and same["files"].count() == tables["files"].count()
    (root / "tree/src/util/index.ts").unlink()
    (root / "tree/src/util/new.py").write_text("def added(): pass\n")
    (root / "tree/src/services/userService.ts").write_text("function other() {}\n")
    status, stages, _ = analyze.incremental(spark, str(root / "tree"), out["one"], out["three"])
    by = dict(rows(status, "path", "status"))
    assert (by["src/util/index.ts"], by["src/util/new.py"], by["src/services/userService.ts"], by["package.json"]) == ("deleted", "added", "modified", "unchanged")
    assert {"languages", "code_nodes", "clusters", "concepts"} <= set(stages)


def value(spark, column, **inputs):
    return spark.createDataFrame([tuple(inputs.values())], list(inputs)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("name", "casing"), [("UserModel", "PascalCase"), ("userModel", "camelCase"), ("foo", "camelCase"), ("a_b", "snake_case"), ("a-b", "kebab-case"), ("A_B", "CONSTANT_CASE"), ("ABC", "PascalCase"), ("a b", "unknown")])
def test_casing(spark, name, casing):
    assert value(spark, names.casing(F.col("n")), n=name) == casing


def test_name_and_path_expressions(spark):
    assert value(spark, names.words(F.col("n")), n="getUserName2") == ["get", "user", "name2"]
    assert value(spark, names.split_identifier(F.col("n")), n="parseHTTPHeader_v2.x") == ["parse", "http", "header", "v", "2", "x"]
    assert value(spark, names.common_prefix(F.array(F.lit("abcd"), F.lit("abx"))), n=1) == "ab"
    assert value(spark, names.common_suffix(F.array(F.lit("xyService"), F.lit("zService"))), n=1) == "Service"
    assert value(spark, names.capitalised(F.col("n")), n="abC") == "AbC"
    assert value(spark, names.name_tag(F.col("n")), n="getUser") == "get*"
    assert value(spark, paths.resolved(F.col("p")), p="a/b/../c/./d") == "a/c/d"
    assert value(spark, paths.package(F.col("p")), p="@scope/pkg/sub") == "@scope/pkg"
    assert value(spark, paths.extension(F.col("p")), p="a/.env") == "" and value(spark, paths.stem(F.col("p")), p="a/b.test.TS") == "b.test"
    assert value(spark, text.line_of(F.col("t"), F.lit(4)), t="a\nb\nc") == 2
    assert value(spark, text.ngrams(text.word_list(F.col("t")), 2), t="One two, three") == ["one two", "two three"]
    assert value(spark, text.ngrams(text.word_list(F.col("t")), 4), t="One two, three") == []


def test_line_diff(spark):
    old, new = (spark.createDataFrame([(1, x)], ["key", "text"]) for x in ("a\nb\nc", "a\nx"))
    assert rows(text.line_diff(old, new), "line", "before", "after", "change") == [(1, "b", "x", "changed"), (2, "c", None, "removed")]


def test_scores(spark):
    assert value(spark, scores.path_confidence(F.array(F.lit(0.6), F.lit(0.8)), F.lit(3)), n=1) == pytest.approx(0.67)
    assert value(spark, scores.running_confidence(F.array(F.lit(1.0), F.lit(0.0), F.lit(0.5))), n=1) == 0.5
    assert value(spark, vectors.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))), n=1) == 0.0
    with pytest.raises(Exception, match="differ in length"):
        value(spark, vectors.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0))), n=1)
    with pytest.raises(ValueError):
        search.checked_dimension(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], ["v"]), "v")


def test_context_packing(spark):
    found = spark.createDataFrame([(1, 1, "b.ts", 9, "x" * 40), (1, 2, "a.ts", 1, "y" * 400), (1, 3, "b.ts", 2, "z" * 20)], ["request", "rank", "file_path", "start_line", "content"])
    got = search.pack_context(found, 30.0).first()
    assert got.context == "File: b.ts\n" + "z" * 20 + "\n" + "x" * 40 + "\n" + "File: a.ts\n" + search.OMITTED + "\n"


def test_embedding_provider(spark):
    items = spark.createDataFrame([(1, "ab"), (2, " "), (3, "abc")], ["id", "text"])
    got = search.embed(items, lambda texts: [[float(len(t))] for t in texts], "id", "text", batch=1)
    assert rows(got, "id", "vector") == [(1, [2.0]), (3, [3.0])]


def test_flows(spark):
    nodes = spark.createDataFrame([(x, x, r, None, 0.7) for x, r in (("a", "source"), ("b", "transformer"), ("c", "sink"), ("d", "source"))], "node_id string, name string, role string, data_type string, confidence double")
    edges = spark.createDataFrame([("calls", "a", "b", "x.map(y)"), ("calls", "b", "c", "await z"), ("calls", "c", "b", ""), ("calls", "b", "c", "again"), ("contains", "a", "c", "")], "type string, source_id string, target_id string, context string")
    flows = dataflow.direct(edges, nodes)
    assert rows(flows, "source_id", "target_id", "is_async")[0] == ("a", "b", False) and flows.count() == 4
    assert rows(dataflow.paths(flows, nodes), "nodes") == [(["a", "b", "c"],)]
    assert dataflow.role_metrics(nodes, flows).first().async_flows == 1
    typed = nodes.withColumn("data_type", F.when(F.col("node_id") == "a", "row"))
    assert dict(rows(dataflow.propagated(typed, flows), "node_id", "data_type"))["c"] == "row[]"
    events = spark.createDataFrame([("e", "save"), ("h", "save"), ("h", "load")], ["id", "event"])
    assert rows(dataflow.event_flows(events.where("id = 'e'"), events.where("id = 'h'")), "source_id", "target_id") == [("e", "h")]
    access = spark.createDataFrame([("w", "s", "set x"), ("r", "s", "read"), ("q", "s", "look"), ("w", "t", "set")], "accessor string, target string, context string")
    assert rows(dataflow.shared_state_pairs(access), "source_id", "target_id") == [("w", "q"), ("w", "r")]
    assert dataflow.shared_state(access).count() == 3
    members = spark.createDataFrame([("1", "p", "setName"), ("2", "p", "getName"), ("3", "p", "other")], "id string, parent_id string, name string")
    assert rows(dataflow.property_flows(members), "source_id", "target_id") == [("1", "2")]
    calls = spark.createDataFrame([("a", "b", ""), ("b", "c", ""), ("c", "a", "")], "caller string, callee string, context string")
    assert ["a", "b", "c"] in [r.nodes for r in dataflow.chains(calls).collect()]


def test_clusters(spark):
    sims = spark.createDataFrame([("t", 1, 2, 0.9), ("t", 2, 3, 0.8), ("t", 1, 3, 0.7), ("t", 3, 4, 0.65)], "block string, a long, b long, sim double")
    nodes = spark.createDataFrame([("t", x) for x in (1, 2, 3, 4, 5)], "block string, node long")
    assert rows(clustering.hierarchical(sims, nodes, "block"), "cluster", "node") == [(1, 1), (1, 2), (1, 3)]
    assert rows(clustering.hierarchical(sims, nodes, "block", stop="reference"), "cluster", "node") == [(1, 1), (1, 2)]
    edges = spark.createDataFrame([(a, b) for a in range(4) for b in range(a)] + [(3, 9), (9, 10)], "a long, b long")
    assert rows(clustering.dense_groups(edges), "group", "node") == [(0, 0), (0, 1), (0, 2), (0, 3), (0, 9)]  # 7 of 10 links
    assert dict(rows(clustering.components(edges), "node", "root")) == {x: 0 for x in (0, 1, 2, 3, 9, 10)}
    members = spark.createDataFrame([("c", 1), ("c", 2)], "cluster string, node long")
    described = spark.createDataFrame([(1, "getUser", "f"), (2, "getUserId", "f")], "node long, name string, type string")
    assert rows(clustering.summary(members, described), "size", "dominant_type", "prefix") == [(2, "f", "getUser")]


def test_patterns_concepts_and_dependencies(spark):
    nodes = spark.createDataFrame([(str(i), "class", n, None, "// load the user") for i, n in enumerate(("UserService", "OrderService", "UserModel"))] + [(str(9 + i), "function", n, None, "") for i, n in enumerate(("getUser", "getOrder", "getAll"))], "id string, type string, name string, parent_id string, content string")
    roles = {r.name: r.frequency for r in patterns.role_names(nodes).collect()}
    assert roles == {"Service": 2, "get": 3}
    assert {"structure", "naming"} <= {r.type for r in patterns.structure(nodes).unionByName(patterns.conventions(nodes)).collect()}
    assert {"user", "order"} == {r.name for r in semantics.identifier_concepts(nodes).collect()} - {"all"}
    assert {r.name: r["count"] for r in semantics.comment_concepts(nodes).collect()}["user"] == 3
    members = spark.createDataFrame([("u", "1", "d", "a"), ("u", "2", "d", "a"), ("v", "2", "d", "a"), ("v", "3", "e", "b")], "concept string, node_id string, directory string, name string")
    edges = spark.createDataFrame([("1", "2"), ("1", "3")], "source_id string, target_id string")
    assert rows(semantics.edge_links(edges, members), "a", "b", "strength") == [("u", "v", 2)]
    assert rows(semantics.coherence(members, edges), "concept") == [("u",), ("v",)]
    assert rows(semantics.overlaps(members, "concept", "node_id"), "a", "b", "jaccard") == [("u", "v", round(1 / 3, 6))]
    assert value(spark, dependencies.dependency_type(F.col("m"), ("src",), ("react",)), m="react/x") == "external"
    assert value(spark, dependencies.layer(F.col("m")), m="src/models/a.ts") == "model"
    linked = spark.createDataFrame([("src/view/a", "src/model/b"), ("src/model/b", "src/view/c"), ("src/ui/x", "src/model/b")], "source_id string, target_id string")
    assert rows(dependencies.one_way_share(linked), "pairs", "one_way") == [(2, 0.5)]


def test_diff_covers_every_key(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k long, h string"), spark.createDataFrame([(2, "c"), (3, None), (4, "d")], "k long, h string")
    assert rows(diff.diff(old, new, "k", "h"), "k", "status") == [(1, "deleted"), (2, "modified"), (3, "unchanged"), (4, "added")]


def test_streamed_changes(spark, tmp_path):
    for i, batch in enumerate(([("a", "1"), ("b", "1")], [("a", "1"), ("b", "2")])):
        spark.createDataFrame(batch, "path string, content_hash string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("path string, content_hash string").parquet(str(tmp_path / "in"))
        run = changes.statuses(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
        run.awaitTermination()
        found = rows(spark.read.parquet(str(tmp_path / "out")), "path", "content_hash", "status")
        assert found == ([("a", "1", "added"), ("b", "1", "added")] if i == 0 else [("a", "1", "added"), ("b", "1", "added"), ("b", "2", "modified")])


def test_conversations_overlap_by_all_their_words(spark, tmp_path):
    import random

    from stratalens.plans import catalogue

    rng = random.Random(3)
    turns = [(i % 40, i // 40, " ".join(rng.choices(["the", "cat", "sat", "ab", "mat", *(f"w{k}" for k in range(30)), "extraordinarily"], k=rng.randint(0, 15)))) for i in range(100)] + [(None, 0, "cat sat"), (41, 0, None)]
    spark.createDataFrame(turns, "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    words = {}
    for c, _, t in turns:
        if c is not None:
            words.setdefault(c, set()).update(w for w in (t or "").split() if len(w) > 2)
    want = [(a, b, round(len(words[a] & words[b]) / len(words[a] | words[b]), 6)) for a in sorted(words) for b in sorted(words) if a < b and words[a] & words[b]]
    want = [x for x in want if x[2] > 0.15]
    assert len(want) > 50
    assert rows(catalogue.QUERIES["jaccard_conversations_words"](spark, str(tmp_path)), "a", "b", "jaccard") == sorted(want, key=repr)
    members = spark.createDataFrame([(c, w) for c, ws in words.items() for w in ws], "g long, i string")
    assert rows(semantics.block_overlaps(members, "g", "i", blocks=1), "a", "b", "jaccard") == sorted(want, key=repr)


def test_overlap_tiles_agree_however_small(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    a, b = rng.random((9, 50)) < 0.4, rng.random((7, 50)) < 0.4
    a[:, :3] = b[:, :3] = True
    for dense, chunk in ((2048, 1 << 21), (2, 3)):
        monkeypatch.setattr(semantics, "DENSE", dense)
        monkeypatch.setattr(semantics, "CHUNK", chunk)
        (ra, ca), (rb, cb) = np.nonzero(a), np.nonzero(b)
        assert (semantics._shared((ra, rb), (ca, cb), (9, 7), 50) == a.astype(int) @ b.T.astype(int)).all()


def test_types_reach_three_flows_far(spark, tmp_path):
    from stratalens.plans import catalogue

    chain = ["signup", "view", "click", "purchase", "error"]
    events = [(2 * i + k, i, f"2024-01-01 00:00:0{k}", e) for i, pair in enumerate(zip(chain, chain[1:], strict=False)) for k, e in enumerate(pair)]
    spark.createDataFrame(events, "event_id long, user_id long, ts string, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    got = dict(rows(catalogue.QUERIES["type_propagation_rounds"](spark, str(tmp_path)), "node_id", "data_type"))
    assert got == {"signup": "user", "view": "user", "click": "user", "purchase": "user", "error": None}
