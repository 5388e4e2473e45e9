"""What must not come back when tables grow: work done anew for each reader, one task for a small file, pairs of copies."""

import random
import re

import pytest
from pyspark.sql import functions as F

from stratalens.functions import text
from stratalens.operators import clustering, dataflow, semantics
from stratalens.plans import catalogue
from stratalens.sources import nodes, work

SF = "/root/testdata/sf0.001"


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["call_alignment", "member_flows", "nested_nodes", "shared_properties"])
def test_code_nodes_are_found_once(spark, name):
    assert "MapInArrow" not in plan(catalogue.QUERIES[name](spark, SF))  # a written table


def test_small_files_share_batches_of_nodes(spark):
    files = spark.range(3000).repartition(1).select(F.concat(F.lit("f"), "id").alias("path"), F.lit("Python").alias("language"), F.lit("x = 1\n").alias("content"), F.lit(2).alias("line_count"))
    found = nodes.code_nodes(files)
    count = lambda batches: (type(b).from_pydict({"n": [b.num_rows]}) for b in batches)
    sizes = [r.n for r in found.mapInArrow(count, "n long").collect()]
    assert sum(sizes) == 6000 and len(sizes) < 10
    assert work.spread(files, "path").rdd.getNumPartitions() >= 4


NAMES = ("getName", "nameGet", "getOrderService", "orderService", "hot bolt", "HotBoltService", "getHotBolt", "hot_bolt", "bolt_hot", "", "getaway", "x.y")


def test_all_pairs_of_items_with_similar_names(spark):
    df = spark.createDataFrame([(k, "ab"[k % 2], None if k == 77 else NAMES[k * 7 % 12]) for k in range(100)], "k int, block string, name string")
    want = rows(clustering.blocked_pairs(df, ["block"], "k", "name", clustering.naming_similarity, 0.6), "a", "b", "sim")
    assert rows(clustering.naming_pairs(df, "block", "k", "name", 0.6, twins="all"), "a", "b", "sim") == want
    assert len(want) > 100


@pytest.mark.parametrize("least", [0.4, 0.55])
def test_clusters_of_distinct_names_are_those_of_all_items(spark, least):
    df = spark.createDataFrame([(k, "ab"[k % 2], None if k == 77 else NAMES[k * 7 % 12]) for k in range(80)], "k int, block string, name string")
    pairs = clustering.blocked_pairs(df, ["block"], "k", "name", clustering.naming_similarity, 0.1, keep_block=True)
    want = rows(clustering.hierarchical(pairs, df.select("block", F.col("k").alias("node")), "block", least), "block", "cluster", "node")
    assert rows(clustering.name_clusters(df, "block", "k", "name", 0.1, least), "block", "cluster", "node") == want


def test_many_patterns_meet_texts_by_a_whole_word(spark, monkeypatch):
    regexes = [rf"export\s+const\s+v{i}\s+=\s+\d+" for i in range(8)] + [r"import\s+tools\.v3", "v1", "(", r"a(b c)? d ", r"x{1,2} y1 z", r"[\] q ] y1", r"c|d e f", r"const \_v1 z", None]
    table = spark.createDataFrame([(f"p{i}", r, None) for i, r in enumerate(regexes)], "pattern string, regex string, confidence double")
    texts = [f"export const v{i % 9}  = 12\nimport tools.v3{i}\n ab c d a d q y1 xx y1 z const _v1 z" for i in range(20)] + [None, ""]
    df = spark.createDataFrame([(i // 2, x) for i, x in enumerate(texts)], "k int, content string")  # two texts a key
    columns = ["key", "pattern", "nth", "match", "offset", "line", "groups", "confidence"]
    want, bad = (rows(x, *c) for x, c in zip(text.all_matches(df, "k", "content", table), (columns, ["pattern"]), strict=True))
    monkeypatch.setattr(text, "WHOLE", 0)
    found, told = text.all_matches(df, "k", "content", table)
    assert rows(found, *columns) == want and len(want) > 100
    assert rows(told, "pattern") == bad == [("p10",), ("p16",)]
    assert text.whole_words(regexes[5]) == ["const", "v5"] and text.whole_words(regexes[14]) == []


def test_many_patterns_meet_texts_without_large_broadcasts(spark, monkeypatch):
    regexes = [rf"export\s+const\s+v{i}\s+=\s+\d+" for i in range(8)] + [r"import\s+tools\.v3", *(f"v{i}" for i in range(9)), r"a b c"]
    table = spark.createDataFrame([(f"p{i}", r, None) for i, r in enumerate(regexes)], "pattern string, regex string, confidence double")
    df = spark.createDataFrame([(i // 2, f"export const v{i % 9}  = 12\nimport tools.v3{i}\n a b c") for i in range(40)], "k int, content string")
    columns = ["key", "pattern", "nth", "match", "offset", "line", "groups", "confidence"]
    want = rows(text.all_matches(df, "k", "content", table)[0], *columns)
    for name, value in (("WHOLE", 4), ("HOT_TEXTS", 3)):
        monkeypatch.setattr(text, name, value, raising=False)
    found, _ = text.all_matches(df, "k", "content", table)
    assert rows(found, *columns) == want and len(want) > 100
    executed = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in executed and "BroadcastNestedLoopJoin" not in executed
    assert not re.search(r"BroadcastHashJoin \[(key|pattern)", executed)
    built = re.findall(r"BroadcastHashJoin \[word#\d+\], \[word#\d+\], (\w+)", executed)
    assert built and set(built) == {"LeftOuter"}  # counted words that many texts hold, no texts or patterns


def test_phrases_of_a_small_table_are_found_by_many_tasks(spark):
    assert "RepartitionByExpression" in plan(catalogue.QUERIES["comment_phrases"](spark, SF))


def test_paths_end_when_no_node_goes_on(spark, monkeypatch):
    flows = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("b", "z"), ("c", "c"), ("s", "s"), ("s", "b"), ("a", None), (None, "b"), ("a", "y")], "source_id string, target_id string")
    nodes_ = spark.createDataFrame([("a", "source"), ("a", "source"), ("s", "source"), ("b", "sink"), ("c", None), ("n", "source"), (None, "sink")], "node_id string, role string")
    names, stored = [], work.stored
    monkeypatch.setattr(dataflow.work, "stored", lambda df, name: names.append(name) or stored(df, name))
    found = dataflow.paths(flows, nodes_)
    assert rows(found, "nodes", "entry", "exit") == [(["a", "b", "z"], "a", "z"), (["a", "b"], "a", "b"), (["a", "y"], "a", "y")]
    assert names.count("paths") == 3  # c has a flow to itself and so goes on; no fourth round
    names.clear()
    short = flows.where("source_id <> 'c' AND source_id <> 's'")
    assert rows(dataflow.paths(short, nodes_), "nodes") == [(["a", "b", "c"],), (["a", "b", "z"],), (["a", "b"],), (["a", "y"],)]
    assert names.count("paths") == 1  # the last round is read once


def test_sets_are_found_once_and_sent_to_few_blocks(spark, monkeypatch):
    monkeypatch.setattr(semantics, "TILE", 10)
    members = spark.range(900).select((F.col("id") % 300).alias("g"), F.concat(F.lit("w"), F.col("id") % 7).alias("i"))
    found = semantics.block_overlaps(members, "g", "i")
    assert "Range" not in plan(found)  # a written table
    assert "sequence(0, 11," in plan(found)  # not a block a tile
