"""Operators whose form follows from hot keys, repeats and restarts, against plain versions."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from stratalens.operators import aggregates, clustering, dataflow, dependencies, relationships, responses
from stratalens.sources import tree
from stratalens.streaming import changes


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize(("share", "least", "most"), [(0.1, 3, 50), (0.5, 1, 10_000), (0.0, 2, 5), (1.0, 1, 10_000)])
def test_sample_by_slices_of_the_hash(spark, share, least, most):
    given = [(i, None if i % 9 == 0 else "ab"[i % 2]) for i in range(3000)] + [(7, "b"), (7, "b"), (1, "lone")]
    md5 = lambda i: hashlib.md5(str(i).encode()).hexdigest()
    want = []
    for g in {g for _, g in given}:
        own = sorted((i for i, x in given if x == g), key=lambda i: (md5(i), i))
        want += [(g, i) for i in own[: min(max(math.ceil(len(own) * share), least), most)]]
    found = aggregates.reference_sample(spark.createDataFrame(given, "id int, g string"), "g", "id", share, least, most)
    assert rows(found, "g", "id") == sorted(want, key=repr)
    assert found.columns == ["id", "g", "n_group", "nth"]


def test_running_confidence_of_long_folds(spark):
    rng = random.Random(1)
    given = [("hot", i, rng.random()) for i in range(500)] + [("one", 1, 0.25), ("two", 1, 1.0), ("two", 2, 0.0)]
    rng.shuffle(given)
    want = []
    for m in ("hot", "one", "two"):
        values = [v for _, v in sorted((at, v) for x, at, v in given if x == m)]
        c = values[0]
        for v in values[1:]:
            c = (c + v) / 2
        want.append((m, round(c, 6)))
    assert rows(dependencies.confidence(spark.createDataFrame(given, "m string, at int, v double"), "m", "at", "v"), "m", "confidence") == want


def test_repeated_references_count_definitions_once(spark):
    refs = spark.createDataFrame([("a", "X"), ("a", "X"), ("b", "Y"), ("c", "Z"), ("d", None)], "child string, base string")
    defs = spark.createDataFrame([("X", "d1"), ("Y", "d2"), ("Y", "d3"), (None, "d4")], "base string, definition string")
    found = relationships.resolve_names(refs, defs, "base")
    assert rows(found, "child", "target_id", "candidates", "confidence") == [("a", "d1", 1, 0.8), ("a", "d1", 1, 0.8), ("b", "d2", 2, 0.72), ("b", "d3", 2, 0.72), ("c", "unresolved:Z", 0, 0.4), ("d", None, 0, 0.4)]


def test_upsert_takes_the_latest_row_and_bears_repeats(spark, tmp_path):
    sink = changes.upsert_to(str(tmp_path / "t"), "k", ("at",))
    batch = lambda *r: spark.createDataFrame(list(r), "at int, k string, v string")
    first, second = batch((1, "a", "old"), (2, "a", "new"), (1, "b", "x")), batch((3, "b", "y"), (1, "c", None))
    sink(first, 0)
    sink(second, 4)  # numbers may leave gaps
    want = [(1, "c", None), (2, "a", "new"), (3, "b", "y")]
    assert rows(spark.read.parquet(str(tmp_path / "t" / "v4")), "at", "k", "v") == want
    (tmp_path / "t" / "v2").mkdir()  # a batch that was cut off
    sink(second, 4)
    assert rows(spark.read.parquet(str(tmp_path / "t" / "v4")), "at", "k", "v") == want
    assert changes.newest_version(spark, str(tmp_path / "t"), 4) == 0


def test_scan_enters_only_what_is_kept(spark, tmp_path):
    for name in ("node_modules/x/a.js", "src/app.ts", "src/combine.ts", "src/dist/b.js", "lib/c.py", "top.go", ".hidden/d.js", "_x/e.js"):
        p = tmp_path / "r" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("x")
    root = str(tmp_path / "r")
    assert rows(tree.scan(spark, root), "path", "depth", "parent_path") == [(".hidden/d.js", 1, ".hidden"), ("_x/e.js", 1, "_x"), ("lib/c.py", 1, "lib"), ("src/app.ts", 1, "src"), ("top.go", 0, "")]
    assert not any("node_modules" in x or "_x" in x or ".hidden" in x for x in tree._entered(spark, root, tree.EXCLUDED))
    (tmp_path / "r" / "odd[1]").mkdir()
    (tmp_path / "r" / "odd[1]" / "f.ts").write_text("x")
    assert ("odd[1]/f.ts",) in rows(tree.scan(spark, root), "path")


def test_specifiers_that_fit_several_files(spark):
    files = spark.createDataFrame([(x,) for x in ("a/x.ts", "b/x.js", "x.ts", "a/main.ts", "node_modules/x", "lib/index.ts", "pkg/x.tsx")], "path string")
    found = spark.createDataFrame([("a/main.ts", m) for m in ("./x", "x", "pkg/x", "/lib", "../x", "none", "./main")], "path string, module string")
    hits = {}
    for module, target, confidence in rows(relationships.resolve_specifiers(found, files), "module", "target_id", "confidence"):
        hits.setdefault((module, confidence), []).append(target)
    assert hits == {("./x", 0.7): ["a/x.ts"], ("x", 0.63): ["a/x.ts", "b/x.js", "node_modules/x", "pkg/x.tsx"], ("pkg/x", 0.63): ["a/x.ts", "b/x.js", "pkg/x.tsx"], ("/lib", 0.7): ["lib/index.ts"], ("../x", 0.7): ["x.ts"]}


def test_children_of_two_nodes(spark):
    given = [({"f": 2, "c": 1}, {"f": 1}), ({}, {}), ({"f": 2}, {}), ({"a": 1}, {"a": 1})]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(given)], "i int, a map<string,bigint>, b map<string,bigint>")
    got = [r.s for r in df.orderBy("i").select(clustering.children_similarity(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got == pytest.approx([0.5 * (1 / 3) + 0.5 * (1 - 2 / 6), 1.0, 0.0, 1.0])


def test_name_patterns_of_one_directory_without_relations(spark):
    nodes = spark.createDataFrame([("1", "getOrder", "a/x.ts", 1), ("2", "saveOrder", "a/y.ts", 2), ("3", "dropOrder", "b/z.ts", 3), *[(str(i), f"v{i}", "c/q.ts", i) for i in range(10, 30)]], "id string, name string, path string, start_line int")
    assert rows(dataflow.name_pattern_flows(nodes), "source_id", "target_id") == [("1", "2")]
    edges = spark.createDataFrame([("3", "1")], "source_id string, target_id string")
    assert rows(dataflow.name_pattern_flows(nodes, edges=edges), "source_id", "target_id") == [("1", "2"), ("1", "3")]


def test_relationships_in_every_form_of_answer(spark):
    answers = ['[{"source": "a", "target": "b", "type": "t", "description": "d"}]', '{"source": "a", "target": "b"}', "Relationship 1: x\nSource: a\nTarget: b\n\nRelationship 2: y\nSource: c\nTarget: d\nType: uses\n", "nothing", None, "{broken"]
    found = responses.relationships(spark.createDataFrame(list(enumerate(answers)), "k int, answer string"), "k", "answer")
    assert rows(found, "k", "source", "target", "type", "description") == [(0, "a", "b", "t", "d"), (1, "a", "b", "Undefined", ""), (2, "a", "b", "Undefined", ""), (2, "c", "d", "uses", "")]
