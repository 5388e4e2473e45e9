"""Nested code nodes, calls, the directory walk, and stage graphs."""

import pytest
from pyspark.sql import functions as F

from stratalens.functions import text
from stratalens.operators import cache, clustering, dataflow, diff, mining, retrieval
from stratalens.plans import stages
from stratalens.plans.stages import Graph, Stage, Tables
from stratalens.sources import nodes, tree, walk

from .test_model import rows

TYPESCRIPT = """import {x} from './a';
export const LIMIT = 3;
// class Fake {
export class Shop extends Base {
  private items: Map<string, number> = new Map();
  constructor(private readonly db: Db, name?: string) {
    super();
    this.size = compute(name, 1);
  }
  get total(): number { return this.size; }
  async load(id: string, {a, b}: Opts = {}, ...rest: string[]): Promise<void> {
    const inner = (p) => {
      return p;
    };
    if (x) { go("class Bad {"); }
  }
}
interface Db { url: string; open(path: string): void; }
enum Color { Red, Green }
namespace N { export class In { m() { } } }
"""
PYTHON = '''import os
LIMIT: int = 3
class Shop(Base):
    """class Fake:"""
    size = 0
    def __init__(self, db, *args, n: int = 3):
        self.db = db
        self.size = 1
        def inner(
            a,
            b=(1, 2),
        ):
            return a
    class Meta:
        ordering = 1
def free(x):
    y = 1
    return helper(x, y)
'''
JAVA = """public class A {
  private final int count = 0;
  public static void main(String[] args, final int n) {
    run(args, n);
  }
  class B { String name; int get() { return 1; } }
}
"""
GO = "type S struct {\n\tName string\n}\nfunc (s *S) Get(id int) string {\n\treturn s.Name\n}\nfunc Free(a, b int) {}\n"
RUST = "pub struct P { x: i32, pub y: u8 }\nimpl P {\n    pub fn new(x: i32) -> Self { P { x } }\n    fn go(&self, n: u8) {}\n}\n"
C = "#include <x.h>\nstatic int add(int a, char *b) {\n  if (a) { return 1; }\n  return a;\n}\nint other(void);\n"

#: type, name, first line, last line, parent, position
WANT = {
    "TypeScript": [
        ("variable", "LIMIT", 2, 2, None, None), ("class", "Shop", 4, 17, None, None), ("property", "items", 5, 5, "Shop", None), ("method", "constructor", 6, 9, "Shop", None),
        ("parameter", "db", 6, 6, "constructor", 0), ("parameter", "name", 6, 6, "constructor", 1), ("method", "total", 10, 10, "Shop", None), ("method", "load", 11, 16, "Shop", None),
        ("parameter", "id", 11, 11, "load", 0), ("parameter", "rest", 11, 11, "load", 2), ("function", "inner", 12, 14, "load", None), ("parameter", "p", 12, 12, "inner", 0),
        ("interface", "Db", 18, 18, None, None), ("property", "url", 18, 18, "Db", None), ("method", "open", 18, 18, "Db", None), ("parameter", "path", 18, 18, "open", 0),
        ("enum", "Color", 19, 19, None, None), ("property", "Red", 19, 19, "Color", None), ("property", "Green", 19, 19, "Color", None),
        ("namespace", "N", 20, 20, None, None), ("class", "In", 20, 20, "N", None), ("method", "m", 20, 20, "In", None),
    ],
    "Python": [
        ("variable", "LIMIT", 2, 2, None, None), ("class", "Shop", 3, 15, None, None), ("property", "size", 5, 5, "Shop", None), ("method", "__init__", 6, 13, "Shop", None),
        ("parameter", "db", 6, 6, "__init__", 0), ("parameter", "args", 6, 6, "__init__", 1), ("parameter", "n", 6, 6, "__init__", 2), ("property", "db", 7, 7, "Shop", None),
        ("function", "inner", 9, 13, "__init__", None), ("parameter", "a", 9, 9, "inner", 0), ("parameter", "b", 9, 9, "inner", 1), ("class", "Meta", 14, 15, "Shop", None),
        ("property", "ordering", 15, 15, "Meta", None), ("function", "free", 16, 18, None, None), ("parameter", "x", 16, 16, "free", 0),
    ],
    "Java": [
        ("class", "A", 1, 7, None, None), ("property", "count", 2, 2, "A", None), ("method", "main", 3, 5, "A", None), ("parameter", "args", 3, 3, "main", 0), ("parameter", "n", 3, 3, "main", 1),
        ("class", "B", 6, 6, "A", None), ("property", "name", 6, 6, "B", None), ("method", "get", 6, 6, "B", None),
    ],
    "Go": [
        ("struct", "S", 1, 3, None, None), ("property", "Name", 2, 2, "S", None), ("method", "Get", 4, 6, "S", None), ("parameter", "id", 4, 4, "Get", 0),
        ("function", "Free", 7, 7, None, None), ("parameter", "a", 7, 7, "Free", 0), ("parameter", "b", 7, 7, "Free", 1),
    ],
    "Rust": [
        ("struct", "P", 1, 1, None, None), ("property", "x", 1, 1, "P", None), ("property", "y", 1, 1, "P", None), ("method", "new", 3, 3, "P", None), ("parameter", "x", 3, 3, "new", 0),
        ("method", "go", 4, 4, "P", None), ("parameter", "n", 4, 4, "go", 0),
    ],
    "C": [("function", "add", 2, 5, None, None), ("parameter", "a", 2, 2, "add", 0), ("parameter", "b", 2, 2, "add", 1)],
}


@pytest.mark.parametrize(("language", "content"), [("TypeScript", TYPESCRIPT), ("Python", PYTHON), ("Java", JAVA), ("Go", GO), ("Rust", RUST), ("C", C)])
def test_declarations(language, content):
    found = nodes.declared(content, language)
    assert [(f.kind, f.name, f.line, f.to, f.parent and f.parent.name, f.position) for f in found] == WANT[language]


@pytest.mark.parametrize("content", ["", "}}}))) class", "class A {", "function f(", "((((", "'", "/*", "`${", "class A:\n", "def f(\n", "end\nend", "x" * 100_000, "{" * 5000 + "}" * 6000, "class A { " * 300])
@pytest.mark.parametrize("language", [*nodes.BRACKETED[:3], *nodes.INDENTED[:2], "Go", "Rust", "C", "Markdown"])
def test_broken_texts_end(content, language):
    for f in nodes.declared(content, language):
        assert 1 <= f.line <= f.to <= content.count("\n") + 1


def test_ids_do_not_move_with_lines(spark):
    frame = lambda text: spark.createDataFrame([("a.ts", "TypeScript", text, 1)], "path string, language string, content string, line_count int")
    ids = lambda text: {(r.type, r.name, r.id) for r in nodes.code_nodes(frame(text)).collect()}
    text = "class A { f() { } f() { } }\nclass A { f() { } }"
    assert ids(text) == ids("\n\n// more\n" + text) and len(ids(text)) == 6


def test_nodes_of_odd_rows(spark):
    rows_ = [("a.ts", "TypeScript", None, 1), ("b.py", "Python", "", 1), ("c", None, "class A {}", 1), ("d.md", "Markdown", "class A {}", 1)]
    df = spark.createDataFrame(rows_, "path string, language string, content string, line_count int").withColumn("id", F.lit("x"))
    assert rows(nodes.code_nodes(df), "path", "type", "name") == [("a.ts", "module", "a"), ("b.py", "module", "b"), ("d.md", "module", "d")]
    assert rows(nodes.code_nodes(df, symbols=False), "path", "type", "name") == rows(nodes.code_nodes(df), "path", "type", "name")
    assert nodes.call_sites(nodes.code_nodes(df.where("false"))).count() == 0


def test_calls_and_their_flows(spark):
    text = """class Box {
  size = 1;
  fill(a, b) { return a; }
  use(x, y) {
    const r = this.fill(
      x,
      [y, 2],
    );
    this.size = this.fill(this.size, other);
    // this.fill(x)
    this.fill("fill(x, y)", if2(x));
    return r;
  }
}
"""
    own = nodes.code_nodes(spark.createDataFrame([("a.ts", "TypeScript", text, 14)], "path string, language string, content string, line_count int"))
    sites = nodes.call_sites(own)
    assert [(r.name, list(r.arguments), r.result) for r in sites.orderBy("nth").collect()] == [
        ("fill", ["x", "[y, 2]"], "r"), ("fill", ["this.size", "other"], "size"), ("fill", ['"' + 10 * " " + '"', "if2(x)"], None), ("if2", ["x"], None)
    ]
    name = {r.id: r.name for r in own.collect()}
    flows = dataflow.call_flows(dataflow.resolved_calls(sites, own), own)
    found = {(name[r.source_id], name[r.target_id], r.type, r.confidence) for r in flows.collect()}
    assert found == {("x", "a", "parameter", 0.85), ("y", "b", "parameter", 0.7), ("size", "a", "parameter", 0.85), ("x", "b", "parameter", 0.7), ("fill", "use", "return", 0.7), ("fill", "size", "return", 0.8)}


def test_walk_sees_hidden_names_and_never_enters_excluded_directories(spark, tmp_path):
    for name in ("src/__init__.py", ".eslintrc", "a/b/c/node_modules/deep/x.js", "a/b/c/node_modules/y.js", "a/b/c/d/z.ts", "_p/.q/r.ts", "é ü/[x].ts", "a/empty/.keep"):
        p = tmp_path / "r" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"caf\xe9" if name.endswith("z.ts") else b"x = 1\n")
    (tmp_path / "r" / "loop").symlink_to(tmp_path / "r")
    root = str(tmp_path / "r")
    listings = spark.sparkContext.accumulator(0)
    found = walk.entries(spark, root, ("node_modules",), listings=listings)
    files = {p for p, f in rows(found, "path", "is_file") if f}
    assert files == {"src/__init__.py", ".eslintrc", "a/b/c/d/z.ts", "_p/.q/r.ts", "é ü/[x].ts", "a/empty/.keep"}
    assert listings.value == 10  # the root, src, a, a/b, a/b/c, a/b/c/d, a/empty, _p, _p/.q, é ü
    assert {p for (p,) in rows(walk.entries(spark, root, (), max_depth=1).where("is_file"), "path")} == {"src/__init__.py", ".eslintrc", "é ü/[x].ts"}
    assert {r.path: r.content for r in tree.scan(spark, "file://" + root, []).collect()}["a/b/c/d/z.ts"] == "caf\ufffd"
    assert rows(tree.named(spark, root, ["src/__init__.py", "gone.py", "src"]), "path", "language", "depth") == [("src/__init__.py", "Python", 1)]
    (tmp_path / "none").mkdir()
    assert tree.scan(spark, str(tmp_path / "none")).count() == 0


def counts(name, needs, column):
    return Stage(name, {needs: (column,)}, lambda t: t[needs].groupBy(column).agg(F.count("*").alias("n")))


def test_stage_graphs(spark, tmp_path, monkeypatch):
    given = lambda *x: spark.createDataFrame(list(x), "path string, kind string, text string")
    words = Stage("words", {"files": ("path", "text")}, lambda t: t["files"].select("path", F.explode(F.split("text", " ")).alias("word")), "path")
    graph = Graph({"files": "path"}, [counts("per_word", "words", "word"), words, counts("kinds", "files", "kind")])
    assert [[s.name for s in level] for level in graph.levels()] == [["words", "kinds"], ["per_word"]]
    assert graph.affected({"words"}) == ["per_word"] and graph.affected({"files"}) == ["words", "kinds", "per_word"]
    graph = graph.extended(Stage("top", {"per_word": ("word", "n")}, lambda t: t["per_word"].where("n > 1")))
    with pytest.raises(ValueError, match="there already"):
        graph.register(words)
    with pytest.raises(ValueError, match="wait for each other"):
        Graph({}, [counts("a", "b", "x"), counts("b", "a", "x")]).levels()
    one = graph.build({"files": given(("a", "k", "x y"), ("b", "k", "y"), ("c", None, None))}, spark, str(tmp_path / "1"))
    assert rows(one.read("top"), "word", "n") == [("y", 2)]

    def change(before, to, touched, *now):
        return graph.update(Tables.load(spark, str(tmp_path / before)), {"files": given(*now)}, spark.createDataFrame([(x,) for x in touched], "path string"), "path", str(tmp_path / to))

    two, ran = change("1", "2", ["a"], ("a", "k", "y x"))  # other text, the same counts
    assert ran == ["words"] and rows(two.read("words"), "path", "word") == [("a", "x"), ("a", "y"), ("b", "y")]
    three, ran = change("2", "3", ["b", "d"], ("d", "m", "x"))  # b is gone
    assert ran == ["words", "kinds", "per_word", "top"] and rows(three.read("top"), "word", "n") == [("x", 2)]
    before = "3"
    monkeypatch.setattr(stages, "MOST_SEGMENTS", 3)
    for k in range(4, 8):  # compaction on the way
        now, _ = change(before, str(k), [f"e{k}"], (f"e{k}", "m", f"w{k % 2}"))
        before = str(k)
    assert max(len(s) for s in now.segments.values()) <= 3
    assert dict(rows(now.read("per_word"), "word", "n")) == {"x": 2, "y": 1, "w0": 2, "w1": 2}


def test_similar_names_against_all_pairs(spark):
    import random

    rng = random.Random(1)
    parts = ["get", "set", "user", "order", "Item", "Service", "has", "row", "use"]
    made = [(i, rng.choice("xy"), "".join(p if k == 0 else p.capitalize() for k, p in enumerate(rng.choices(parts, k=rng.randint(1, 4)))) + rng.choice(["", "", "Service"])) for i in range(160)]
    df = spark.createDataFrame([*made, (900, "x", ""), (901, "x", "a_b"), (902, "x", "a-b")], "k long, g string, n string")
    distinct = df.groupBy("g", "n").agg(F.min("k").alias("k"))
    want = set(rows(clustering.blocked_pairs(distinct, ["g"], "k", "n", clustering.naming_similarity, 0.6), "a", "b", "sim"))
    own = {n: k for k, g, n in reversed(made) for n in [(g, n)]}
    first = {n: min(k for k, g, m in made if (g, m) == n) for n in own}
    got = set(rows(clustering.naming_pairs(df, "g", "k", "n"), "a", "b", "sim"))
    twins = {(first[g, n], k) for k, g, n in made if first[g, n] != k}
    assert len(want) > 50 and {p for p in got if p[:2] not in twins} == want
    with pytest.raises(ValueError):
        clustering.naming_pairs(df, "g", "k", "n", 0.5)


def test_types_change_along_flows(spark):
    df = spark.createDataFrame([("a", ["map"]), ("a[]", ["map"]), ("a[]", ["filter", "reduce"]), ("a[][]", ["reduce"]), ("a", ["reduce", "format"]), ("a", ["format"]), ("a", ["transform"]), ("a", [])], "t string, x array<string>")
    assert [r.y for r in df.select(dataflow.transformed_type(F.col("t"), F.col("x")).alias("y")).collect()] == ["a[]", "a[]", "a[]", "a[]", "a", "string", "string", "a"]


def greedy_linkage(sims, n, least, most=None):
    """One merge at a time, the most similar two."""
    clusters = {i: [i] for i in range(n)}
    mean = lambda x, y: sum(sims.get((min(a, b), max(a, b)), 0.0) for a in clusters[x] for b in clusters[y]) / (len(clusters[x]) * len(clusters[y]))
    while len(clusters) > 1:
        best = max(((mean(x, y), -x, -y) for x in clusters for y in clusters if x < y))
        if best[0] < least:
            break
        clusters[-best[1]] += clusters.pop(-best[2])
        if most is not None and len(clusters) <= most:
            break
    return sorted((min(c), x) for c in clusters.values() if len(c) > 1 for x in c)


def test_linkage_in_rounds_equals_the_greedy(spark):
    import random

    rng = random.Random(3)
    all_pairs, all_nodes, want, cut = [], [], {}, {}
    for block in "xy":
        sims = {(a, b): rng.random() for a in range(14) for b in range(a + 1, 14) if rng.random() < 0.7}
        all_pairs += [(block, *((b, a) if rng.random() < 0.5 else (a, b)), s) for (a, b), s in sims.items()]
        all_nodes += [(block, i) for i in range(14)]
        want[block], cut[block] = greedy_linkage(sims, 14, 0.3), greedy_linkage(sims, 14, 0.3, 9)
    pairs, given = spark.createDataFrame(all_pairs, "block string, a long, b long, sim double"), spark.createDataFrame(all_nodes, "block string, node long")
    for expected, options in ((want, {}), (cut, {"stop": "reference", "most": 9})):
        got = rows(clustering.hierarchical(pairs, given, "block", 0.3, **options), "block", "cluster", "node")
        assert set(got) == {(b, *x) for b in "xy" for x in expected[b]} and len(got) == sum(map(len, expected.values()))
    assert clustering.hierarchical(pairs.where("false"), given, "block").count() == 0


def test_cache_asks_once_and_keeps_failures(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def provider(texts):
        calls.add(len(texts))
        if "bad" in texts:
            raise ValueError("no")
        return [[float(len(x)), 1.0] for x in texts]

    store = cache.ContentCache(spark, str(tmp_path / "cache"))
    items = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "a"), (4, "bad"), (5, ""), (6, None), (7, "  ")], "id long, text string").coalesce(1)
    got = {r.id: r for r in store.through(items, "id", "text", provider).collect()}
    assert set(got) == {1, 2, 3, 4} and got[1].value == got[3].value == [1.0, 1.0] and not any(r.cached for r in got.values())
    assert got[4].value is None and got[4].error == "ValueError: no"
    calls.value = 0
    again = {r.id: r for r in store.through(items.where("text <> 'bad'"), "id", "text", provider).collect()}
    assert calls.value == 0 and all(r.cached for r in again.values()) and again[2].value == [2.0, 1.0]
    store.through(spark.createDataFrame([(9, "ccc")], "id long, text string"), "id", "text", provider)
    store.through(items.where("id = 2"), "id", "text", provider)
    assert sorted(r.value[0] for r in store.evict(2).collect()) == [2.0, 3.0]
    assert store.through(items.where("id = 1"), "id", "text", provider).first().cached is False
    wrong = cache.ContentCache(spark, str(tmp_path / "wrong"))
    assert wrong.through(items.where("id = 2"), "id", "text", lambda texts: [] if len(texts) else None).first().error.startswith("IndexError")


def test_cached_answers_are_asked_once(spark, tmp_path):
    items = spark.createDataFrame([(i, [1.0, i / 10], f"src/f{i}.py", i, f"line {i}") for i in range(4)], "id long, vector array<double>, file_path string, start_line int, content string")
    asked = spark.createDataFrame([(k, q, [1.0, 0.1]) for k, q in enumerate(["fix this bug", "fix this bug", None])], "request long, question string, query array<double>")
    calls = spark.sparkContext.accumulator(0)

    def provider(prompts):
        calls.add(len(prompts))
        return ["FILE: src/f1.py" for _ in prompts]

    store = cache.ContentCache(spark, str(tmp_path / "answers"), "string")
    for _ in range(2):
        got = {r.request: (r.answer, r.files) for r in retrieval.answers(asked, items, provider, cache=store).collect()}
        assert got[0] == got[1] == ("FILE: src/f1.py", ["src/f1.py"]) and got[2][0] is None
    assert calls.value == 1


def test_patterns_from_a_table(spark):
    df = spark.createDataFrame([(1, "import a\nimport b as c\n"), (2, None), (3, "")], "k long, code string")
    table = spark.createDataFrame([("import", r"import (\w+)(?: as (\w+))?", 0.9), ("bad", "[", 0.9), ("none", None, 0.1), ("empty", r"^", None)], "pattern string, regex string, confidence double")
    found, bad = text.all_matches(df, "k", "code", table)
    assert rows(found.where("pattern = 'import'"), "key", "nth", "match", "offset", "line", "groups") == [(1, 0, "import a", 1, 1, ["a", ""]), (1, 1, "import b as c", 10, 2, ["b", "c"])]
    assert rows(found.where("pattern = 'empty'"), "key", "confidence") == [(1, 0.8), (3, 0.8)]
    assert rows(bad, "pattern") == [("bad",), ("none",)]
    assert text.all_matches(df, "k", "code", table.where("pattern = 'bad'"))[0].count() == 0


def test_refreshed_hashes_after_random_edits(spark):
    import random
    from hashlib import sha256

    rng = random.Random(5)
    frame = lambda d: spark.createDataFrame(sorted((p, sha256(x.encode()).hexdigest()) for p, x in d.items()), "path string, hash string")
    before = {f"r/{rng.choice('abc')}/{rng.choice('de')}/{i}" if i % 4 else f"r/{rng.choice('abc')}/{i}" for i in range(40)}
    before = dict.fromkeys(before, "x")
    for _ in range(3):
        after = {p: (x + "y" if rng.random() < 0.1 else x) for p, x in before.items() if rng.random() < 0.9 and not p.startswith("r/b/d/")} | {f"r/new{rng.randint(0, 9)}/f": "z", "top": "t"}
        got = diff.refreshed_hashes(diff.tree_hashes(frame(before), "path", "hash", 3), frame(before), frame(after), "path", "hash", 3)
        assert rows(got, "path", "hash") == rows(diff.tree_hashes(frame(after), "path", "hash", 3).where("path <> ''"), "path", "hash")
        before = after


def test_vector_pairs_in_parts(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(60, 5)).round(2).tolist() + [[0.0] * 5, [float("nan")] * 5, None]
    df = spark.createDataFrame([(i, "xy"[i % 2], v) for i, v in enumerate(vectors)], "k long, g string, v array<double>")
    own = {i: np.array(v) for i, v in enumerate(vectors[:60])}
    want = {(a, b, round(float(own[a] @ own[b] / np.linalg.norm(own[a]) / np.linalg.norm(own[b])), 6)) for a in own for b in own if a < b and a % 2 == b % 2}
    want = {x for x in want if x[2] >= 0.5}
    for size in (4096, 7):
        monkeypatch.setattr(clustering, "PART_ROWS", size)
        got = rows(clustering.vector_pairs(df, "k", "v", 0.5, ["g"]), "a", "b", "sim")
        assert set(got) == want and len(got) == len(want)
    with pytest.raises(ValueError):
        clustering.vector_pairs(df, "k", "v", 0.0, ["g"])


def test_kmeans_gives_every_vector_a_near_centre(spark):
    points = [(i, [float(10 * (i % 3)) + i / 100, 0.0]) for i in range(30)]
    got = dict(rows(clustering.kmeans(spark.createDataFrame(points, "k long, v array<double>"), "k", "v", 3, seed=1), "k", "cluster"))
    assert set(got) == set(range(30)) and len(set(got.values())) == 3
    assert all((got[a] == got[b]) == (a % 3 == b % 3) for a in got for b in got)


def test_aspects_and_standards(spark, tmp_path):
    items = spark.createDataFrame([(i, [1.0, i / 10], f"src/f{i}.py", i, f"line {i}") for i in range(4)], "id long, vector array<double>, file_path string, start_line int, content string")
    calls = spark.sparkContext.accumulator(0)

    def provider(prompts):
        calls.add(len(prompts))
        if any("dependencies" in p for p in prompts):
            raise RuntimeError("down")
        return [f"## Recommendations\n- {'focus' if 'Focus: x' in p else 'all'}\n" for p in prompts]

    store = cache.ContentCache(spark, str(tmp_path / "answers"), "string")
    asked = spark.createDataFrame([(1, "architecture", 1, "x", [1.0, 0.1]), (2, "patterns", None, None, [1.0, 0.1]), (3, "dependencies", 3, "", [1.0, 0.1])], "request long, aspect string, depth int, focus string, query array<double>")
    for _ in range(2):
        got = {r.request: r for r in retrieval.aspects(asked, items, provider, store).collect()}
        assert list(got[1].recommendations) == ["focus"] and list(got[2].recommendations) == ["all"] and "in outline" in got[1].prompt and "line 1" in got[1].prompt
        assert got[3].analysis == "Failed to analyze dependencies" and got[3].recommendations == []
    before = calls.value
    wanted = spark.createDataFrame([(1, "testing", [1.0, 0.1]), (2, None, [1.0, 0.1])], "request long, category string, query array<double>")
    known = spark.createDataFrame([("Service", 9, 0.9, "ends so"), ("weak", 99, 0.5, "x")], "name string, frequency long, confidence double, description string")
    for _ in range(2):
        got = {r.request: r for r in retrieval.standards(wanted, items, known, provider, store).collect()}
        assert "Standards: testing" in got[1].prompt and "Service: ends so" in got[1].prompt and "weak" not in got[1].prompt and "Standards: all" in got[2].prompt
    assert calls.value == before + 2


def test_mined_statements(spark):
    files = spark.createDataFrame([("a", "import x from './m1'\nexport default 3\nuse lib.z\nimportant\n"), ("b", None), ("c", "  import x from './m22'\n")], "path string, content string")
    table = mining.mined_statements(mining.lines(files, "content", ["path"]))
    imports, exports = mining.statements(files, table)
    assert rows(imports, "path", "line", "module") == [("a", 1, "./m1"), ("a", 3, "lib.z"), ("c", 1, "./m22")]
    assert rows(exports, "path", "line") == [("a", 2)] and rows(mining.connections(imports), "path", "module") == [("a", "./m1"), ("a", "lib.z"), ("c", "./m22")]


def test_combined_pairs(spark, monkeypatch):
    """Parts, the bound and twins against all pairs; nulls drop out of the mean."""
    schema = "type string, id string, name string, structure struct<metadata:map<string,string>,children:map<string,bigint>,size:bigint>, edge_types array<string>, in_ratio double"
    made = []
    for i in range(60):
        name = (None, "", "getUser", "getUserName", "user_name", "UserService", "parse")[i % 7]
        structure = None if i % 13 == 0 else ({"language": ("Go", "C")[i % 2]}, None if i % 11 == 0 else {"method": i % 3}, i % 4 + 1)
        made.append(("function" if i % 5 else "class", f"n{i:02}", name, structure, None if i % 3 == 0 else ["calls", "contains"][: i % 3], (i % 4) / 4))
    made += [("class", None, "getUser", None, None, None), (None, "x", "getUser", None, None, None)]
    items = spark.createDataFrame(made, schema)
    a, b = (items.select("type", F.struct("id", F.when(F.col("name") != "", clustering.name_signs(F.col("name"))).alias("signs"), F.when(F.col("structure").isNotNull(), F.struct(F.col("structure.metadata").alias("metadata"), F.coalesce("structure.children", F.create_map().cast("map<string,bigint>")).alias("children"), F.col("structure.size").alias("size"))).alias("structure"), "edge_types", "in_ratio").alias(s)) for s in "xy")
    score = clustering.combined([(clustering._metric(m, F.col("x"), F.col("y")), 1.0) for m in clustering.ELEMENT_METRICS])
    every = {(r.a, r.b): r.sim for r in a.join(b, "type").where("x.id < y.id").select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.round(score, 6).alias("sim")).collect()}
    want = {k: v for k, v in every.items() if v >= 0.6}
    assert 100 < len(want) < len(every)
    monkeypatch.setattr(clustering, "ELEMENT_ROWS", 7)
    got = clustering.combined_pairs(items, "type", "id", metrics=clustering.ELEMENT_METRICS, twins="all").collect()
    assert len(got) == len(want) and {(r.a, r.b): r.sim for r in got} == want
    less = clustering.combined_pairs(items, "type", "id", metrics=clustering.ELEMENT_METRICS).collect()
    assert len({(r.a, r.b) for r in less}) == len(less) <= len(got) and all(want[r.a, r.b] == r.sim for r in less)
    # twins: copies of one element make as many links as there are copies, and the same components
    copies = spark.createDataFrame([("function", f"c{i}", "getUser", ({"language": "Go"}, {}, 3), ["calls"], 0.5) for i in range(50)], schema)
    assert clustering.combined_pairs(copies, "type", "id", metrics=clustering.ELEMENT_METRICS).count() == 49
    # equal elements that are not similar enough to each other keep their own links
    low = spark.createDataFrame([("function", f"c{i}", "parse" if i else None, ({}, {}, 3), None, None) for i in range(6)], schema)
    assert clustering.combined_pairs(low, "type", "id", metrics=clustering.ELEMENT_METRICS).count() == 5
    same = lambda pairs: sorted((r.root, r.node) for r in clustering.components(spark.createDataFrame(pairs)).collect())
    assert same(less) == same(got)
    assert clustering.combined_pairs(items.where("false"), "type", "id", metrics=clustering.ELEMENT_METRICS).count() == 0


def test_relationship_profiles(spark):
    edges = spark.createDataFrame([("calls", "a", "b"), ("calls", "a", "a"), ("contains", "b", "a"), ("calls", None, "b")], "type string, source_id string, target_id string")
    got = {r.node: (r.edge_types, r.in_ratio) for r in clustering.relationship_profiles(edges).collect()}
    assert got == {"a": (["calls", "contains"], 2 / 3), "b": (["calls", "contains"], 2 / 3)}
