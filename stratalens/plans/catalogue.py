"""Registered queries over the provided tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashes, names, ngrams, paths, scores, text, vectors
from ..operators import aggregates, clustering, dataflow, dependencies, diff, relationships, search
from ..sources import tree
from .registry import ORACLES, QUERIES, query  # noqa: F401

FLAGSHIP = "vector_topk"


def first_vector(t, key: int = 0) -> list[float]:
    return t("embeddings").where(F.col("vec_id") == key).select("embedding").first()["embedding"]


# vectors

COSINE = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


@query(f"SELECT e.vec_id, e.label, round({COSINE}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 AND {COSINE} >= 0.05 ORDER BY {COSINE} DESC, e.vec_id LIMIT 10")
def vector_topk(t):
    found = search.search(t("embeddings"), first_vector(t), "vec_id", "embedding", 10, 0.05)
    return found.select("vec_id", "label", F.round("score", 6).alias("score"))


@query(f"SELECT e.vec_id, round({COSINE}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 AND e.label = 3 AND {COSINE} >= 0.0 ORDER BY {COSINE} DESC, e.vec_id LIMIT 5")
def vector_topk_filtered(t):
    return search.search(t("embeddings"), first_vector(t), "vec_id", "embedding", 5, 0.0, {"label": 3}).select("vec_id", F.round("score", 6).alias("score"))


@query(f"SELECT e.vec_id, round({COSINE}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 AND (e.label IN (1, 2, 3) OR e.label >= 8) AND e.label <> 2 AND {COSINE} >= 0.0 ORDER BY {COSINE} DESC, e.vec_id LIMIT 7")
def vector_filter_document(t):
    where = {"$and": [{"$or": [{"label": {"$in": [1, 2, 3]}}, {"label": {"$gte": 8}}]}, {"label": {"$ne": 2}}]}
    return search.search(t("embeddings"), first_vector(t), "vec_id", "embedding", 7, 0.0, where).select("vec_id", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id, score FROM (SELECT e.vec_id, round({COSINE}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY {COSINE} DESC, e.vec_id LIMIT 10) WHERE score >= 0.3")
def vector_limit_then_minscore(t):
    return search.similar(t("embeddings"), first_vector(t), "vec_id", "embedding", 10, 0.3).select("vec_id", F.round("score", 6).alias("score"))


@query("SELECT label, min(len(embedding))::INT AS dimension, count(*) AS n FROM embeddings GROUP BY label")
def vector_stats(t):
    return search.checked_dimension(t("embeddings"), "embedding").groupBy("label").agg(F.min(F.size("embedding")).alias("dimension"), F.count("*").alias("n"))


PAIRS = "SELECT e.vec_id AS a, q.vec_id AS b, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS sim FROM embeddings e JOIN embeddings q ON e.label = q.label AND e.vec_id < q.vec_id"


@query(f"SELECT * FROM ({PAIRS}) WHERE sim >= 0.35")
def vector_pairs_threshold(t):
    """Pairs of one label: it plays the part of the node type, and the reference compares nodes of one type only."""
    return clustering.vector_pairs(t("embeddings"), "vec_id", "embedding", 0.35, ["label"])


@query(f"""WITH RECURSIVE p AS MATERIALIZED (SELECT a, b FROM ({PAIRS}) WHERE sim >= 0.35), e AS (SELECT a AS x, b AS y FROM p UNION SELECT b, a FROM p),
    r AS (SELECT x AS node, x AS root FROM e UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.node)
    SELECT node, min(root) AS root FROM r GROUP BY node""")
def vector_components(t):
    """Components of the pairs of one label (see `vector_pairs_threshold`)."""
    return clustering.components(clustering.vector_pairs(t("embeddings"), "vec_id", "embedding", 0.35, ["label"]))


@query(None)
def vector_kmeans(t):
    return clustering.kmeans(t("embeddings"), "vec_id", "embedding", 10)


@query(None)
def context_pack(t):
    found = search.search(t("embeddings"), first_vector(t), "vec_id", "embedding", 15, 0.0)
    docs = t("documents").select(F.col("doc_id").alias("vec_id"), F.col("source").alias("file_path"), F.col("text").alias("content"))
    rows = found.join(docs, "vec_id").select(F.lit(0).alias("request"), F.row_number().over(_by_score()).alias("rank"), "file_path", F.col("vec_id").alias("start_line"), "content")
    return search.pack_context(rows, 2000.0)


def _by_score():
    from pyspark.sql.window import Window

    return Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "vec_id")  # 15 rows at most


# files and languages


@query("SELECT source, lang, count(*) AS files, sum(strlen(text))::BIGINT AS total_size FROM documents GROUP BY source, lang")
def file_stats_by_dir(t):
    return aggregates.totals(t("documents"), ["source", "lang"], F.octet_length("text"))


@query("""WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS k, sum(n) OVER (PARTITION BY source)::BIGINT AS total FROM c)
    SELECT source, lang AS dominant, n, total, round(n / total, 6) AS share FROM r WHERE k = 1""")
def lang_dominant(t):
    return aggregates.dominant(t("documents"), ["source"], "lang")


@query("SELECT source, lang, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY source), 6) AS share FROM documents GROUP BY source, lang")
def lang_share_by_dir(t):
    return aggregates.shares(t("documents"), ["source"], "lang")


@query("SELECT lang, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM documents GROUP BY lang")
def lang_distribution(t):
    return aggregates.share_of_all(t("documents"), "lang")


@query("""WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY source) AS share FROM c)
    SELECT source, lang, n FROM s WHERE share > 0.7 AND n >= 3""")
def lang_specific_dirs(t):
    return aggregates.shares(t("documents"), ["source"], "lang").where("share > 0.7 AND n >= 3").select("source", "lang", "n")


@query("""SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k <= 3""")
def largest_per_language(t):
    return aggregates.top_per_group(t("documents"), ["lang"], [F.desc("n_chars"), F.col("doc_id")], 3).select("lang", "doc_id")


@query("""SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents) WHERE k <= least(greatest(ceil(n * 0.1), 3), 50)""")
def hash_sample(t):
    return aggregates.reference_sample(t("documents").select("doc_id", "lang"), "lang", "doc_id", 0.1, 3, 50).select("lang", "doc_id")


@query("SELECT user_id, event_type AS dominant, n, total, round(n / total, 6) AS share FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k, sum(n) OVER (PARTITION BY user_id)::BIGINT AS total FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)) WHERE k = 1")
def user_dominant_event(t):
    return aggregates.dominant(t("events"), ["user_id"], "event_type")


@query("SELECT doc_id, len(string_split(text, chr(10)))::INT AS line_count, length(text)::BIGINT AS chars, strlen(text)::BIGINT AS bytes FROM documents")
def line_counts(t):
    rows = t("documents").select("doc_id", F.concat(F.lit("docs/"), "doc_id", F.lit(".md")).alias("path"), F.col("text").alias("content"))
    return tree.describe(rows).select("doc_id", "line_count", F.length("content").cast("long").alias("chars"), F.octet_length("content").cast("long").alias("bytes"))


# hashes and differences


@query("SELECT doc_id, sha256(text) AS content_hash, sha256(source || ':' || lang || ':' || doc_id) AS node_hash FROM documents")
def content_hashes(t):
    return t("documents").select("doc_id", F.sha2("text", 256).alias("content_hash"), hashes.content_hash(F.col("source"), F.col("lang"), F.col("doc_id")).alias("node_hash"))


@query("""WITH f AS (SELECT 'root/' || source || '/' || lang || '/' || doc_id AS path, sha256(text) AS hash FROM documents),
    l3 AS (SELECT regexp_replace(path, '/[^/]*$', '') AS path, sha256(string_agg(hash, '' ORDER BY path)) AS hash FROM f GROUP BY 1),
    l2 AS (SELECT regexp_replace(path, '/[^/]*$', '') AS path, sha256(string_agg(hash, '' ORDER BY path)) AS hash FROM l3 GROUP BY 1),
    l1 AS (SELECT regexp_replace(path, '/[^/]*$', '') AS path, sha256(string_agg(hash, '' ORDER BY path)) AS hash FROM l2 GROUP BY 1)
    SELECT * FROM l3 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l1""")
def directory_hashes(t):
    rows = t("documents").select(F.concat_ws("/", F.lit("root"), "source", "lang", "doc_id").alias("path"), F.sha2("text", 256).alias("hash"))
    return diff.tree_hashes(rows, "path", "hash", 3)


SNAPSHOTS = """WITH a AS (SELECT o_orderkey AS k, sha256(o_orderstatus) AS h FROM orders WHERE o_orderkey % 7 <> 0),
    b AS (SELECT o_orderkey AS k, sha256(o_orderstatus || CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE '' END) AS h FROM orders WHERE o_orderkey % 11 <> 0),
    d AS (SELECT coalesce(a.k, b.k) AS o_orderkey, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'deleted' WHEN a.h = b.h THEN 'unchanged' ELSE 'modified' END AS status FROM a FULL JOIN b ON a.k = b.k)"""


def snapshots(t):
    rows = t("orders")
    old = rows.where("o_orderkey % 7 <> 0").select("o_orderkey", F.sha2("o_orderstatus", 256).alias("h"))
    changed = F.concat("o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, "x").otherwise(""))
    return old, rows.where("o_orderkey % 11 <> 0").select("o_orderkey", F.sha2(changed, 256).alias("h"))


@query(SNAPSHOTS + " SELECT * FROM d")
def snapshot_diff(t):
    return diff.diff(*snapshots(t), "o_orderkey", "h")


@query(SNAPSHOTS + " SELECT status, count(*) AS n FROM d GROUP BY status")
def snapshot_diff_counts(t):
    return diff.diff(*snapshots(t), "o_orderkey", "h").groupBy("status").agg(F.count("*").alias("n"))


@query(SNAPSHOTS + " SELECT b.k AS o_orderkey, b.h, a.h IS NULL OR a.h <> b.h AS has_changed FROM b LEFT JOIN a ON a.k = b.k")
def snapshot_merge(t):
    return diff.merge(*snapshots(t), "o_orderkey", "h")


@query(SNAPSHOTS + " SELECT k AS o_orderkey, h FROM b UNION ALL SELECT k, h FROM a WHERE k NOT IN (SELECT k FROM b)")
def snapshot_upsert(t):
    return diff.upsert(*snapshots(t), "o_orderkey")


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def cache_misses(t):
    return diff.misses(t("documents").select("doc_id"), t("labels"), "doc_id")


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 500")
def cache_eviction(t):
    return diff.evict(t("documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 500)


@query("SELECT l_partkey, l_suppkey, min(l_orderkey) AS l_orderkey FROM lineitem GROUP BY l_partkey, l_suppkey")
def dedup_edges(t):
    return diff.first_by(t("lineitem").select("l_partkey", "l_suppkey", "l_orderkey"), ["l_partkey", "l_suppkey"], ["l_orderkey"])


@query("SELECT user_id AS series, ts, value, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts), 6) AS delta FROM events")
def snapshot_deltas(t):
    rows = t("events").select(F.col("user_id").alias("series"), "ts", "value")
    return diff.snapshots_delta(rows, "ts", "value").withColumn("delta", F.round("delta", 6))


# names

CASING = r"""CASE WHEN regexp_full_match(n, '[A-Z][a-z0-9]*([A-Z][a-z0-9]*)*') THEN 'PascalCase' WHEN regexp_full_match(n, '[a-z][a-z0-9]*([A-Z][a-z0-9]*)*') THEN 'camelCase' WHEN regexp_full_match(n, '[a-z][a-z0-9]*(_[a-z0-9]+)*') THEN 'snake_case'
    WHEN regexp_full_match(n, '[a-z][a-z0-9]*(-[a-z0-9]+)*') THEN 'kebab-case' WHEN regexp_full_match(n, '[A-Z][A-Z0-9]*(_[A-Z0-9]+)*') THEN 'CONSTANT_CASE' ELSE 'unknown' END"""
VARIANTS = "SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN replace(p_name, ' ', '_') WHEN 1 THEN replace(p_name, ' ', '-') WHEN 2 THEN upper(replace(p_name, ' ', '_')) WHEN 3 THEN 'get' || upper(left(p_name, 1)) || replace(substr(p_name, 2), ' ', '') WHEN 4 THEN upper(left(p_name, 1)) || replace(substr(p_name, 2), ' ', '') || 'Service' ELSE p_name END AS n, p_type AS type, p_brand AS brand FROM part"


def variants(t):
    """Part names in several casings."""
    n = F.col("p_name")
    joined = F.replace(F.substring(n, 2, 1000), F.lit(" "), F.lit(""))
    head, k = F.upper(F.left(n, F.lit(1))), F.col("p_partkey") % 6
    name = names.first_of([(k == 0, F.replace(n, F.lit(" "), F.lit("_"))), (k == 1, F.replace(n, F.lit(" "), F.lit("-"))), (k == 2, F.upper(F.replace(n, F.lit(" "), F.lit("_")))), (k == 3, F.concat(F.lit("get"), head, joined)), (k == 4, F.concat(head, joined, F.lit("Service")))], n)
    return t("part").select(F.col("p_partkey").alias("k"), name.alias("n"), F.col("p_type").alias("type"), F.col("p_brand").alias("brand"))


@query(f"SELECT {CASING} AS casing, count(*) AS n FROM ({VARIANTS}) GROUP BY 1")
def casing_histogram(t):
    return variants(t).groupBy(names.casing(F.col("n")).alias("casing")).agg(F.count("*").alias("n"))


@query(f"""WITH v AS ({VARIANTS}), c AS (SELECT type, {CASING} AS casing, count(*) AS n FROM v GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY n DESC, casing) AS k, sum(n) OVER (PARTITION BY type)::BIGINT AS total FROM c)
    SELECT type, casing AS dominant, n, total, round(n / total, 6) AS share FROM r WHERE k = 1""")
def casing_by_type(t):
    return aggregates.dominant(variants(t).select("type", names.casing(F.col("n")).alias("casing")), ["type"], "casing")


WORDS = r"""list_filter(CASE WHEN regexp_matches(n, '[A-Z]') THEN regexp_split_to_array(lower(regexp_replace(n, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '\s+') WHEN contains(n, '_') THEN string_split(n, '_') WHEN contains(n, '-') THEN string_split(n, '-') ELSE [n] END, lambda w: w <> '')"""


@query(f"SELECT word, count(*) AS n FROM (SELECT unnest({WORDS}) AS word FROM ({VARIANTS})) GROUP BY word")
def name_words(t):
    return variants(t).select(F.explode(names.words(F.col("n"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query(f"""SELECT CASE WHEN length(n) >= 6 AND left(n, 3) IN ('get', 'set', 'has', 'use') THEN left(n, 3) END AS prefix, CASE WHEN suffix(n, 'Service') THEN 'Service' WHEN contains(n, '.') THEN regexp_extract(n, '[^.]*$') END AS suffix, count(*) AS n FROM ({VARIANTS}) GROUP BY 1, 2""")
def name_affixes(t):
    return variants(t).groupBy(names.name_prefix(F.col("n")).alias("prefix"), names.name_suffix(F.col("n")).alias("suffix")).agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT lower(left(p_name, k)) AS affix, p_type AS type FROM part, range(3, 7) r(k) WHERE k <= least(floor(length(p_name) / 2), 6)) SELECT affix, count(*) AS n FROM l GROUP BY affix HAVING count(*) >= 3""")
def affix_counts(t):
    long = aggregates.affixes(t("part"), "p_name", 6)
    return aggregates.frequent(long, F.col("affix"), "affix", 3)


@query("""WITH l AS (SELECT lower(right(p_name, k)) AS affix, p_type AS type FROM part, range(3, 9) r(k) WHERE k <= least(floor(length(p_name) / 2), 8)), c AS (SELECT affix, type, count(*) AS n FROM l GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY affix ORDER BY n DESC, type) AS k, sum(n) OVER (PARTITION BY affix)::BIGINT AS total FROM c)
    SELECT affix, type AS dominant, n, total, round(n / total, 6) AS share FROM r WHERE k = 1""")
def affix_dominant_type(t):
    return aggregates.dominant(aggregates.affixes(t("part"), "p_name", 8, suffix=True, keep=["p_type"]), ["affix"], "p_type")


@query(f"""WITH v AS (SELECT k, n, brand, CASE WHEN length(n) >= 6 AND left(n, 3) IN ('get', 'set', 'has', 'use') THEN left(n, 3) END AS p, CASE WHEN suffix(n, 'Service') THEN 'Service' END AS s, {CASING} AS c, list_distinct({WORDS}) AS w FROM ({VARIANTS})),
    m AS (SELECT x.k AS a, y.k AS b, round(0.3 * coalesce((x.p = y.p)::INT, 0) + 0.3 * coalesce((x.s = y.s)::INT, 0) + 0.1 * (x.c = y.c)::INT + 0.3 * coalesce(len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w))), 0), 6) AS sim FROM v x JOIN v y ON x.brand = y.brand AND x.k < y.k)
    SELECT a, b, sim FROM m WHERE sim >= 0.6""")
def naming_similarity_pairs(t):
    return clustering.naming_pairs(variants(t), "brand", "k", "n", 0.6, twins="all")


@query(None)
def hierarchical_clusters(t):
    rows = variants(t).withColumn("block", F.concat_ws("/", "brand", "type"))
    return clustering.name_clusters(rows, "block", "k", "n", 0.1, 0.4)


@query(None)
def dense_groups(t):
    return clustering.dense_groups(dependencies.co_occurrence(t("lineitem"), "l_orderkey", "l_suppkey", 3))


@query(f"SELECT type, round(least(1.0, 0.5 + least(0.3, 0.01 * count(*)))::DOUBLE, 6) AS importance, count(*) AS n FROM ({VARIANTS}) GROUP BY type")
def pattern_importance(t):
    counted = variants(t).groupBy("type").agg(F.count("*").alias("n"))
    return counted.select("type", "n", F.round(scores.pattern_importance(F.col("type"), F.col("n")), 6).alias("importance"))


# terms

TERMS = r"list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9_]+', ' ', 'g')), ' '), lambda w: length(w) >= {n})"


@query(f"""WITH l AS (SELECT doc_id, unnest({TERMS.format(n=3)}) AS term FROM documents) SELECT term, count(*) AS occurrences, count(DISTINCT doc_id) AS documents FROM l GROUP BY term HAVING count(*) >= 5""")
def key_terms(t):
    return ngrams.counts(t("documents"), F.col("text"), "doc_id", least=3).where("occurrences >= 5")


def _ngrams(n: int, table: str, key: str) -> str:
    pick = " || ' ' || ".join(f"w[i + {k}]" for k in range(n))
    return f"""WITH l AS (SELECT {key} AS id, {TERMS.format(n=1)} AS w FROM {table}), g AS (SELECT id, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: {pick})) AS term FROM l WHERE len(w) >= {n})
    SELECT term, count(*) AS occurrences, count(DISTINCT id) AS documents FROM g GROUP BY term HAVING count(*) >= 4"""


@query(_ngrams(2, "documents", "doc_id"))
def bigrams(t):
    return ngrams.counts(t("documents"), F.col("text"), "doc_id", 2).where("occurrences >= 4")


@query(_ngrams(3, "conversations", "conv_id"))
def trigrams(t):
    return ngrams.counts(t("conversations"), F.col("text"), "conv_id", 3).where("occurrences >= 4")


@query(f"""WITH l AS (SELECT DISTINCT conv_id AS g, unnest({TERMS.format(n=12)}) AS i FROM conversations), z AS (SELECT g, count(*) AS n FROM l GROUP BY g), s AS (SELECT a.g AS a, b.g AS b, count(*) AS k FROM l a JOIN l b ON a.i = b.i AND a.g < b.g GROUP BY ALL)
    SELECT a, b, jaccard FROM (SELECT a, b, round(k / (x.n + y.n - k), 6) AS jaccard FROM s JOIN z x ON x.g = a JOIN z y ON y.g = b) WHERE jaccard > 0.15""")
def jaccard_conversations(t):
    """Overlap of the long words (12 characters and more) only; `jaccard_conversations_words` takes the reference's words."""
    from ..operators import semantics

    long = t("conversations").select("conv_id", F.explode(F.array_distinct(text.word_list(F.col("text"), 12))).alias("term"))
    return semantics.overlaps(long, "conv_id", "term")


@query(f"""WITH l AS (SELECT DISTINCT conv_id AS g, unnest({TERMS.format(n=3)}) AS i FROM conversations), z AS (SELECT g, count(*) AS n FROM l GROUP BY g), s AS (SELECT a.g AS a, b.g AS b, count(*) AS k FROM l a JOIN l b ON a.i = b.i AND a.g < b.g GROUP BY ALL)
    SELECT a, b, jaccard FROM (SELECT a, b, round(k / (x.n + y.n - k), 6) AS jaccard FROM s JOIN z x ON x.g = a JOIN z y ON y.g = b) WHERE jaccard > 0.15""")
def jaccard_conversations_words(t):
    """Overlap of whole texts: all words of more than 2 characters."""
    from ..operators import semantics

    long = t("conversations").select("conv_id", F.explode(F.array_distinct(text.word_list(F.col("text"), 3))).alias("term"))
    return semantics.block_overlaps(long, "conv_id", "term")


@query("SELECT role, question, count(*) AS n FROM (SELECT role, CASE WHEN regexp_matches(lower(text), 'pattern|architecture|design|structure') THEN 'pattern' WHEN regexp_matches(lower(text), 'relationship|connect|between|interact|depends') THEN 'relationship' WHEN regexp_matches(lower(text), 'implement|add feature|create|extend|write code') THEN 'implementation' WHEN regexp_matches(lower(text), 'bug|fix|error|issue|problem') THEN 'bug' WHEN regexp_matches(lower(text), 'standard|convention|best practice|guideline') THEN 'standard' ELSE 'explanation' END AS question FROM conversations) GROUP BY ALL")
def question_types(t):
    return t("conversations").groupBy("role", search.question_type(F.col("text")).alias("question")).agg(F.count("*").alias("n"))


@query("SELECT text FROM documents INTERSECT SELECT text FROM benchmark")
def shared_texts(t):
    return t("documents").select("text").intersect(t("benchmark").select("text"))


# pages

HREFS = """SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages"""


@query(f"SELECT page_id, href, count(*) AS n FROM ({HREFS}) GROUP BY ALL")
def href_targets(t):
    found = text.matches(t("pages"), "html", {"href": 'href="([^"]*)"'}, ["page_id"])
    return found.groupBy("page_id", F.col("found").alias("href")).agg(F.count("*").alias("n"))


@query(r"""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages""")
def url_parts(t):
    return t("pages").select("page_id", paths.host(F.col("url")).alias("host"), paths.url_path(F.col("url")).alias("path"))


@query(rf"""WITH h AS (SELECT DISTINCT href FROM ({HREFS}) WHERE starts_with(href, '/')), p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+(/[^/?#]+)', 1) AS dir FROM pages)
    SELECT h.href, count(p.page_id) AS pages FROM h LEFT JOIN p ON p.dir = h.href GROUP BY h.href""")
def href_resolution(t):
    links = text.matches(t("pages"), "html", {"href": 'href="([^"]*)"'}, ["page_id"]).where("startswith(found, '/')").select(F.col("found").alias("href")).distinct()
    own = t("pages").select(F.regexp_extract("url", r"^[a-z]+://[^/?#]+(/[^/?#]+)", 1).alias("href"), F.col("page_id").alias("definition"))
    return relationships.resolve_names(links, own, "href").select("href", F.col("candidates").alias("pages")).distinct()


@query(r"SELECT page_id, lower(regexp_extract(html, '(?i)^<!DOCTYPE\s+(\w+)', 1)) AS doctype, len(regexp_extract_all(html, '<p[ >]'))::INT AS paragraphs FROM pages")
def page_header_patterns(t):
    return t("pages").select("page_id", F.lower(F.regexp_extract("html", text.HEADER_PATTERNS["doctype"], 1)).alias("doctype"), F.regexp_count("html", F.lit("<p[ >]")).alias("paragraphs"))


# dependencies


@query("SELECT l_partkey, count(*) AS import_count, count(DISTINCT l_orderkey) AS file_count FROM lineitem GROUP BY l_partkey")
def dependency_rollup(t):
    return dependencies.roll_up(t("lineitem"), "l_partkey", "l_orderkey")


@query("SELECT l_partkey, count(*) AS import_count FROM lineitem GROUP BY l_partkey ORDER BY 2 DESC, 1 LIMIT 10")
def central_items(t):
    return dependencies.central(dependencies.roll_up(t("lineitem"), "l_partkey", "l_orderkey"), "l_partkey").select("l_partkey", "import_count")


COOCCUR = "WITH o AS (SELECT DISTINCT l_orderkey AS f, l_suppkey AS m FROM lineitem), c AS (SELECT x.m AS a, y.m AS b, count(*) AS n FROM o x JOIN o y ON x.f = y.f AND x.m < y.m GROUP BY ALL HAVING count(*) >= 3)"


@query(COOCCUR + " SELECT * FROM c")
def cooccurrence_pairs(t):
    return dependencies.co_occurrence(t("lineitem"), "l_orderkey", "l_suppkey", 3)


@query(COOCCUR + " SELECT module, count(*) AS partners, round(avg(n), 6) AS strength FROM (SELECT a AS module, n FROM c UNION ALL SELECT b, n FROM c) GROUP BY module HAVING count(*) >= 2 ORDER BY strength DESC, module LIMIT 10")
def module_groups(t):
    return dependencies.module_groups(dependencies.co_occurrence(t("lineitem"), "l_orderkey", "l_suppkey", 3))


@query(COOCCUR + " SELECT a, b, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, b)::INT AS rank FROM (SELECT a, b, n FROM c UNION ALL SELECT b, a, n FROM c)) WHERE rank <= 3")
def strong_partners(t):
    return dependencies.top_partners(dependencies.co_occurrence(t("lineitem"), "l_orderkey", "l_suppkey", 3))


@query("""WITH i AS (SELECT o_custkey AS c, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1), e AS (SELECT o_custkey AS c, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), f AS (SELECT coalesce(i.c, e.c) AS o_custkey, coalesce(i.n, 0) AS imports, coalesce(e.n, 0) AS exports FROM i FULL JOIN e ON i.c = e.c)
    SELECT *, CASE WHEN exports > 0 AND imports = 0 THEN 'provider' WHEN exports > 0 AND imports > 0 AND imports / exports < 2 THEN 'adapter' WHEN imports > 3 AND exports = 0 THEN 'consumer' WHEN exports > 0 AND imports > 0 AND imports / exports >= 2 THEN 'integrator' ELSE 'unknown' END AS role FROM f""")
def role_profile(t):
    rows = t("orders")
    return dependencies.profiles(rows.where("o_orderstatus <> 'F'"), rows.where("o_orderstatus = 'F'"), "o_custkey")


@query("""SELECT l_partkey, round(list_reduce(list(l_discount ORDER BY l_orderkey, l_linenumber, l_discount), lambda c, x: (c + x) / 2), 6) AS confidence FROM lineitem GROUP BY l_partkey""")
def running_confidence(t):
    rows = t("lineitem").withColumn("at", F.col("l_orderkey") * 1000 + F.col("l_linenumber"))
    return dependencies.confidence(rows, "l_partkey", "at", "l_discount")


# relationships

EDGES = "SELECT 'contains' AS type, 'region:' || n_regionkey AS source_id, 'nation:' || n_nationkey AS target_id FROM nation UNION ALL SELECT 'contains', 'nation:' || c_nationkey, 'customer:' || c_custkey FROM customer UNION ALL SELECT 'places', 'customer:' || o_custkey, 'order:' || o_orderkey FROM orders"


def model_edges(t):
    a = relationships.containment(t("nation"), F.concat(F.lit("region:"), "n_regionkey"), F.concat(F.lit("nation:"), "n_nationkey"))
    b = relationships.containment(t("customer"), F.concat(F.lit("nation:"), "c_nationkey"), F.concat(F.lit("customer:"), "c_custkey"))
    c = relationships.edges(t("orders"), "places", F.concat(F.lit("customer:"), "o_custkey"), F.concat(F.lit("order:"), "o_orderkey"))
    return a.unionByName(b).unionByName(c)


@query(f"SELECT *, sha256(concat_ws(':', type, source_id, target_id, '1.0')) AS id FROM ({EDGES}) WHERE type = 'contains'")
def containment_edges(t):
    own = model_edges(t).where("type = 'contains'")
    return own.select("type", "source_id", "target_id", hashes.edge_hash(F.col("type"), F.col("source_id"), F.col("target_id"), F.col("weight")).alias("id"))


@query(f"SELECT type, count(*) AS n FROM ({EDGES}) GROUP BY type")
def edge_type_distribution(t):
    return relationships.type_distribution(model_edges(t))


@query(f"SELECT type, source_id, target_id FROM ({EDGES}) WHERE source_id = 'nation:3' OR target_id = 'nation:3'")
def node_neighbourhood(t):
    return relationships.neighbourhood(model_edges(t), "nation:3").select("type", "source_id", "target_id")


@query("""WITH r AS (SELECT DISTINCT l_partkey AS k, CASE WHEN l_partkey % 10 = 0 THEN 'no such part' ELSE p_name END AS base FROM lineitem JOIN part ON p_partkey = l_partkey), d AS (SELECT p_name AS base, min(p_partkey) AS definition FROM part GROUP BY p_name, p_brand), n AS (SELECT base, count(*) AS n FROM d GROUP BY base)
    SELECT r.k, r.base, coalesce(n.n, 0) AS candidates, (CASE WHEN n.n IS NULL THEN 0.4 WHEN n.n > 1 THEN 0.72 ELSE 0.8 END)::DOUBLE AS confidence, count(*) AS links FROM r LEFT JOIN n USING (base) LEFT JOIN d USING (base) GROUP BY ALL""")
def ambiguous_names(t):
    joined = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    refs = joined.select(F.col("l_partkey").alias("k"), F.when(F.col("l_partkey") % 10 == 0, "no such part").otherwise(F.col("p_name")).alias("base")).distinct()
    defs = t("part").groupBy(F.col("p_name").alias("base"), "p_brand").agg(F.min("p_partkey").cast("string").alias("definition")).drop("p_brand")
    return relationships.resolve_names(refs, defs, "base").groupBy("k", "base", "candidates", "confidence").agg(F.count("*").alias("links"))


@query("SELECT a.source, a.lang, a.doc_id AS a, b.doc_id AS b FROM documents a JOIN documents b ON a.source = b.source AND a.lang = b.lang AND a.doc_id < b.doc_id")
def similar_same_group(t):
    return relationships.pairs_sharing(t("documents"), ["source", "lang"], "doc_id")


@query("SELECT doc_id AS source_id, next AS target_id FROM (SELECT doc_id, lead(doc_id) OVER (PARTITION BY source, lang ORDER BY doc_id) AS next FROM documents) WHERE next IS NOT NULL")
def similar_chain(t):
    return relationships.similar_files(t("documents"), ["source", "lang"], "doc_id").select("source_id", "target_id")


# data flow

USER_FLOWS = """SELECT DISTINCT event_type AS s, next AS t FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events) WHERE next IS NOT NULL AND event_type <> next"""


@query("""SELECT w.user_id AS source_id, r.user_id AS target_id, w.k AS via FROM (SELECT DISTINCT user_id, props AS k FROM events WHERE event_type = 'purchase') w JOIN (SELECT DISTINCT user_id, props AS k FROM events WHERE event_type = 'view') r ON w.k = r.k WHERE NOT EXISTS (SELECT 1 FROM events x WHERE x.event_type = 'purchase' AND x.user_id = r.user_id AND x.props = r.k)""")
def shared_state_flows(t):
    rows = t("events").where("event_type IN ('purchase', 'view')")
    access = rows.select(F.col("user_id").alias("accessor"), F.col("props").alias("target"), F.when(F.col("event_type") == "purchase", "write").otherwise("read").alias("context"))
    return dataflow.shared_state_pairs(access)


@query("""SELECT e.event_id AS source_id, h.event_id AS target_id FROM events e JOIN events h ON e.event_type = 'error' AND h.event_type = 'click' AND e.user_id = h.user_id AND date_trunc('hour', e.ts) = date_trunc('hour', h.ts)""")
def event_flows(t):
    name = F.concat_ws("@", "user_id", F.date_trunc("hour", "ts").cast("string")).alias("event")
    rows = t("events")
    return dataflow.event_flows(rows.where("event_type = 'error'").select(F.col("event_id").alias("id"), name), rows.where("event_type = 'click'").select(F.col("event_id").alias("id"), name)).select("source_id", "target_id")


LAYERED = "SELECT 'c' || o_custkey AS s, 'o' || o_orderkey AS t FROM orders UNION SELECT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem"


@query(f"""WITH RECURSIVE e AS MATERIALIZED ({LAYERED}), w AS (SELECT [s, t] AS nodes FROM e WHERE starts_with(s, 'c') UNION ALL SELECT list_append(nodes, e.t) FROM w JOIN e ON e.s = nodes[-1] WHERE len(nodes) < 5 AND NOT list_contains(nodes, e.t))
    SELECT array_to_string(nodes, '>') AS path, nodes[1] AS entry, nodes[-1] AS exit FROM w WHERE starts_with(nodes[-1], 'p') OR NOT EXISTS (SELECT 1 FROM e WHERE s = nodes[-1])""")
def flow_paths(t):
    a = t("orders").select(F.concat(F.lit("c"), "o_custkey").alias("source_id"), F.concat(F.lit("o"), "o_orderkey").alias("target_id"))
    b = t("lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("source_id"), F.concat(F.lit("p"), "l_partkey").alias("target_id"))
    flows = a.unionByName(b)
    ids = flows.select(F.explode(F.array("source_id", "target_id")).alias("node_id"))
    role = names.first_of([(F.startswith("node_id", F.lit("c")), "source"), (F.startswith("node_id", F.lit("p")), "sink")], "transformer")
    return dataflow.paths(flows, ids.withColumn("role", role)).select(F.array_join("nodes", ">").alias("path"), "entry", "exit")


def _typed_events(t):
    """Event types, of which signup has a data type, and the flows between them."""
    from pyspark.sql.window import Window

    nxt = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    flows = t("events").select(F.col("event_type").alias("source_id"), nxt.alias("target_id")).where("target_id IS NOT NULL AND source_id <> target_id").distinct().withColumn("transformations", F.array().cast("array<string>"))
    nodes = t("events").select(F.col("event_type").alias("node_id")).distinct().withColumn("data_type", F.when(F.col("node_id") == "signup", "user"))
    return nodes, flows


@query(f"""WITH e AS (SELECT s AS source_id, t AS target_id FROM ({USER_FLOWS})), t0 AS (SELECT DISTINCT event_type AS node_id, CASE WHEN event_type = 'signup' THEN 'user' END AS data_type FROM events),
    t1 AS (SELECT t.node_id, coalesce(t.data_type, (SELECT x.data_type FROM e JOIN t0 x ON x.node_id = e.source_id WHERE e.target_id = t.node_id AND x.data_type IS NOT NULL ORDER BY e.source_id LIMIT 1)) AS data_type FROM t0 t)
    SELECT node_id, data_type FROM t1""")
def type_propagation(t):
    """The first round only; `type_propagation_rounds` runs the reference's three."""
    return dataflow.propagated(*_typed_events(t), 1)


def _propagation_rounds(n: int) -> str:
    each = ", ".join(f"t{k} AS MATERIALIZED (SELECT t.node_id, coalesce(t.data_type, (SELECT min_by(x.data_type, e.source_id) FROM e JOIN t{k - 1} x ON x.node_id = e.source_id WHERE e.target_id = t.node_id AND x.data_type IS NOT NULL)) AS data_type FROM t{k - 1} t)" for k in range(1, n + 1))
    return f"""WITH e AS MATERIALIZED (SELECT s AS source_id, t AS target_id FROM ({USER_FLOWS})), t0 AS (SELECT DISTINCT event_type AS node_id, CASE WHEN event_type = 'signup' THEN 'user' END AS data_type FROM events), {each} SELECT node_id, data_type FROM t{n}"""


@query(_propagation_rounds(3))
def type_propagation_rounds(t):
    return dataflow.propagated(*_typed_events(t))


@query("""SELECT role, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(lower(p_name), 'input|source|api|fetch|get|provider') THEN 'source' WHEN regexp_matches(lower(p_name), 'output|sink|save|write|send') THEN 'sink' WHEN regexp_matches(lower(p_name), 'transform|convert|format|parse|map|process') THEN 'transformer' WHEN regexp_matches(lower(p_name), 'store|state|cache|repository|db|database') THEN 'store' END AS role FROM part) GROUP BY role""")
def name_roles(t):
    return t("part").select(dataflow.role(F.col("p_name"), F.lit(None).cast("string"), F.lit("")).alias("role")).groupBy("role").agg(F.count("*").alias("n"))


@query("SELECT event_type, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY event_type")
def event_metrics(t):
    return t("events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"))


@query("""WITH n AS (SELECT DISTINCT user_id, ['source', 'sink', 'transformer', 'store'][user_id % 4 + 1] AS role FROM events)
    SELECT (SELECT count(*) FROM n WHERE role = 'source') AS sources, (SELECT count(*) FROM n WHERE role = 'sink') AS sinks, (SELECT count(*) FROM n WHERE role = 'transformer') AS transformers, (SELECT count(*) FROM n WHERE role = 'store') AS stores,
        count(*) AS flows, count_if(event_type = 'click') AS async_flows, count_if(value > 100) AS conditional_flows FROM events""")
def flow_metrics(t):
    """Nodes by role, and flows of each kind."""
    roles = F.array(*map(F.lit, ("source", "sink", "transformer", "store")))
    users = t("events").select("user_id", F.element_at(roles, (F.col("user_id") % 4 + 1).cast("int")).alias("role")).distinct()
    return dataflow.role_metrics(users, t("events").select((F.col("event_type") == "click").alias("is_async"), (F.col("value") > 100).alias("is_conditional")))


@query("SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS norm2 FROM embeddings")
def vector_norms(t):
    return t("embeddings").select("vec_id", F.round(vectors.dot(F.col("embedding"), F.col("embedding")), 6).alias("norm2"))


@query("SELECT source, round(sum(length(text) * 0.25::DOUBLE), 6) AS tokens FROM documents GROUP BY source")
def token_estimates(t):
    return t("documents").groupBy("source").agg(F.round(F.sum(scores.token_estimate(F.col("text"))), 6).alias("tokens"))


from . import catalogue_code, catalogue_model, catalogue_tree  # noqa: E402, F401  (register their queries)
