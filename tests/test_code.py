"""The incremental run, units and clusters of the analysis, the vector store, and answers by an injected provider."""

import pytest
from pyspark.sql import functions as F

from stratalens.operators import clustering, dependencies, mining, relationships, retrieval, units
from stratalens.plans import analyze
from stratalens.sources import tree

from .test_model import TREE, rows

MORE = {"LICENSE": "free", "src/orders/order.ts": "".join(f"export function orderOf{x}() {{}}\n" for x in ("Today", "Week", "Year")), "src/util/names.ts": "".join(f"export function getOrder{x}() {{\n  return getOrder{y}()\n}}\n" for x, y in zip("ABCDE", "BCDEA", strict=True))}


@pytest.fixture
def root(tmp_path):
    for name, content in (TREE | MORE).items():
        p = tmp_path / "tree" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(content)
    return tmp_path


def content_of(table):
    columns = sorted(c for c in table.columns if c != "modified")
    return rows(table, *columns)


def test_increment_equals_the_full_analysis(spark, root):
    source, out = str(root / "tree"), {k: str(root / k) for k in ("one", "two", "three", "four", "full")}
    (root / "tree" / "src/page.vue").write_text("<script>import x from './util/names'</script>")
    tables = analyze.full(spark, source, out["one"])
    kinds = {r.type for r in tables["semantic_units"].collect()}
    assert {"concept", "directory"} <= kinds
    found = {r.module: (r.type, r.version, r.confidence) for r in tables["dependencies"].collect()}
    assert found["react"] == ("external", "1", 0.9) and found["os"] == ("standard_library", None, 0.8) and found["../models/userModel"][0] == "local_file"
    assert any(r.n >= 5 for r in tables["clusters"].groupBy("cluster").agg(F.count("*").alias("n")).collect())
    origins = {r.origin for r in tables["df_flows"].collect()}
    assert {"direct", "call", "property", "name_pattern"} <= origins and ("structure",) in rows(tables["concepts"].select("origin").distinct(), "origin")

    (root / "tree" / "LICENSE").write_text("free for all")
    status, stages, after = analyze.incremental(spark, source, out["one"], out["two"])
    assert rows(status.where("status <> 'unchanged'"), "path", "status") == [("LICENSE", "modified")]
    assert set(stages) == {s.name for s in analyze.STAGES if s.key} | {"languages"}  # a file grew
    assert content_of(after["files"]) != content_of(tables["files"])
    assert all(content_of(after[x]) == content_of(tables[x]) for x in tables if x != "files")
    assert spark.read.parquet(out["two"] + "/files").count() == 1 and spark.read.parquet(out["two"] + "/code_nodes").count() == 0  # the touched rows alone

    (root / "tree" / "src/page.vue").write_text("<script>import x from './util/extra'</script>")  # no code node of its own changes
    (root / "tree" / "src/util/names.ts").write_text(MORE["src/util/names.ts"] + "export function setOrderF() {\n  return 1\n}\n")
    (root / "tree" / "src/util/index.ts").unlink()
    (root / "tree" / "src/util/more.py").write_text("import os\n\ndef more():\n    return 1\n")
    _, stages, after = analyze.incremental(spark, source, out["two"], out["three"])
    assert {"code_nodes", "imports", "patterns", "relationships", "concepts"} <= set(stages)
    assert ("src/page.vue", "./util/extra") in rows(after["imports"], "path", "module") and ("src/page.vue", "./util/names") not in rows(after["imports"], "path", "module")
    (root / "tree" / "src/util/more.py").unlink()
    (root / "tree" / "src/util/extra.py").write_text("class Thing:\n    def __init__(self, size):\n        self.size = size\n")
    stages, after = analyze.targeted(spark, source, ["src/util/more.py", "src/util/extra.py"], out["three"], out["four"])
    whole = analyze.full(spark, source, out["full"])
    assert set(after) == set(whole) and all(content_of(after[x]) == content_of(whole[x]) for x in whole)


def test_store_keeps_versions_and_dimension(spark, tmp_path):
    store = retrieval.VectorStore(spark, str(tmp_path / "vectors"))
    with pytest.raises(ValueError, match="no vectors"):
        store.read()
    item = lambda i, *v: (i, [float(x) for x in v])
    frame = lambda *x: spark.createDataFrame(list(x), "id string, vector array<double>")
    first = store.upsert(frame(item("a", 1, 0), item("b", 0, 1)))
    store.upsert(frame(item("b", 1, 1), item("c", 0, -1)))
    assert rows(first, "id") == [("a",), ("b",)]
    assert [r.id for r in store.search([1.0, 0.2], limit=2, min_score=0.5).collect()] == ["a", "b"]
    assert rows(store.delete(frame(item("a", 0, 0))), "id") == [("b",), ("c",)]
    with pytest.raises(ValueError, match="dimensions"):
        store.upsert(frame(item("d", 1, 2, 3)))
    assert rows(store.read(), "id") == [("b",), ("c",)]
    short = retrieval.VectorStore(spark, str(tmp_path / "short"), keep=2)
    for k in range(4):
        short.upsert(frame(item(str(k), k, 1)))
    assert len(short._versions()) == 2 and short.read().count() == 4
    (tmp_path / "short" / "claim-4").touch()  # another writer is at it
    with pytest.raises(RuntimeError, match="another writer"):
        short.upsert(frame(item("x", 1, 1)))


def test_answers_name_the_files_of_their_context(spark):
    items = spark.createDataFrame([(i, [1.0, i / 10], f"src/f{i}.py", i, f"line {i}") for i in range(12)], "id long, vector array<double>, file_path string, start_line int, content string")
    asked = spark.createDataFrame([(1, "please fix this bug", [1.0, 0.1]), (2, "  ", [1.0, 0.0]), (3, "what is it", [-1.0, 0.0])], "request long, question string, query array<double>")

    def provider(prompts):
        return [f"FILE: src/f{p.count('line')}.py" if "src/f1.py" in p else "none" for p in prompts]

    got = {r.request: r for r in retrieval.answers(asked, items, provider).collect()}
    assert set(got) == {1, 2, 3} and got[2].prompt is got[2].answer is None
    assert "src/f1.py" in got[1].prompt and got[1].files == ["src/f12.py"]
    assert retrieval.NOTHING in got[3].prompt and got[3].files == []


def test_preceding_comments(spark):
    lines = ["x = 1", "# one", "# two", "def f():", "", "// c", "class A"]
    df = spark.createDataFrame([(lines, s) for s in range(1, 8)], "lines array<string>, start int")
    got = [r.c for r in df.orderBy("start").select(retrieval.preceding_comments(F.col("lines"), F.col("start")).alias("c")).collect()]
    assert got == [[], [], ["# one"], ["# one", "# two"], [], [], ["// c"]]
    capped = df.where("start = 4").select(retrieval.preceding_comments(F.col("lines"), F.col("start"), 1).alias("c")).first().c
    assert capped == ["# two"]


def test_filter_of_files(spark):
    df = spark.createDataFrame([("src/a.ts", ".ts"), ("src/gen/b.ts", ".ts"), ("doc/c.md", ".md"), (None, None)], "path string, extension string")
    names = lambda **k: [p for p, in rows(tree.listed(df, **k), "path")]
    assert names() == ["doc/c.md", "src/a.ts", "src/gen/b.ts"]
    assert names(include_extensions=(".ts",), exclude_patterns=("gen$",)) == ["src/a.ts"]
    assert names(include_patterns=("^src",)) == ["src/a.ts", "src/gen/b.ts"]
    assert names(include=F.col("path").startswith("doc"), include_extensions=(".ts",)) == ["doc/c.md"]
    assert names(exclude_extensions=(".md",)) == ["src/a.ts", "src/gen/b.ts"]


def test_lone_names_and_empty_tables(spark):
    members = spark.createDataFrame([("a", 1, "getUser"), ("b", 2, "x_y"), ("b", 3, "x_z")], "g string, id long, name string")
    assert dict(rows(units.mean_word_overlap(members, "g"), "g", "overlap")) == {"b": pytest.approx(1 / 3, abs=1e-6)}
    assert dict(rows(units.name_similarity(members, "g"), "g", "similarity")) == {"a": 0.5, "b": 0.1}
    none = members.where("false")
    assert units.directory_units(none, none.select("id", F.col("name").alias("concept")), none.select(F.col("id").alias("source_id"), F.col("id").alias("target_id")), "g").count() == 0
    lines = mining.lines(spark.createDataFrame([("a\n\n b ", "x"), (None, "x"), ("", "x")], "content string, g string"), "content", ["g"])
    assert rows(lines, "line") == [("a",), ("b",)]


def brute_dense(edges, density=0.7, size=4):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    left, out = set(near), set()
    while left:
        start = min(left)
        group, queue = {start}, sorted(near[start] & left)
        while queue:
            x = queue.pop(0)
            if x in group:
                continue
            links = sum(len(near[y] & group) for y in group) / 2 + len(near[x] & group)
            if links / ((len(group) + 1) * len(group) / 2) >= density:
                group.add(x)
                queue += sorted((near[x] & left) - group)
        left -= group
        if len(group) >= size:
            out |= {(start, x) for x in group}
    return out


def test_dense_groups_against_brute_force(spark):
    edges = [(a, b) for c in (0, 10, 20) for a in range(c, c + 5) for b in range(a + 1, c + 5)] + [(4, 10), (14, 20), (30, 31), (31, 32)]
    got = clustering.dense_groups(spark.createDataFrame(edges, "a long, b long"))
    assert set(rows(got, "group", "node")) == brute_dense(edges)


def test_imports_of_other_languages(spark):
    code = {"a.rb": "require 'net/http'\nrequire_relative \"lib/x\"\n", "b.go": 'import (\n\t"fmt"\n)\nimport "os/exec"\n', "c.java": "import java.util.List;\nimport static a.B;\n", "d.cs": "using System.Text;\n", "e.php": "use App\\Models\\User as U;\nrequire_once('db.php');\n"}
    files = spark.createDataFrame(list(code.items()), "path string, content string")
    assert rows(relationships.imports(files), "path", "module") == sorted([("a.rb", "net/http"), ("a.rb", "lib/x"), ("b.go", "fmt"), ("b.go", "os/exec"), ("c.java", "java.util.List"), ("c.java", "a.B"), ("d.cs", "System.Text"), ("e.php", "App\\Models\\User"), ("e.php", "db.php")], key=repr)


def test_manifest(spark):
    files = spark.createDataFrame([("package.json", "package.json", '{"dependencies": {"a": "1", "@s/b": "2"}}'), ("x/package.json", "package.json", '{"devDependencies": {"a": "0"}}'), ("y/package.json", "package.json", "no json"), ("lib/z.ts", "z.ts", None)], "path string, name string, content string")
    assert rows(dependencies.manifest(files), "package", "version") == [("@s/b", "2"), ("a", "0")]
    rolled = spark.createDataFrame([("@s/b/inner", 1), ("lib/z", 2), ("fs", 3), ("long-name-of-one", 1)], "module string, import_count int")
    assert rows(dependencies.typed(rolled, files), "module", "type", "version") == [("@s/b/inner", "external", "2"), ("fs", "standard_library", None), ("lib/z", "internal", None), ("long-name-of-one", "external", None)]
