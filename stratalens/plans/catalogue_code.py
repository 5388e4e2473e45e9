"""Registered queries of mined patterns, units, retrieval and data flow, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashes, paths
from ..operators import dataflow, mining, retrieval, units
from ..sources import tree
from .catalogue import CASING, VARIANTS, WORDS, variants
from .catalogue_tree import COMMON as USUAL_WORDS
from .registry import query

# lines and patterns

LINES = "SELECT lang, trim(unnest(string_split(text, chr(10)))) AS line FROM documents"
FIRST = f"""SELECT lang, lower(regexp_extract(line, '^([A-Za-z]+)', 1)) AS word, count(*) AS n FROM ({LINES}) WHERE regexp_matches(line, '^[A-Za-z]') GROUP BY ALL"""
MINED = f"SELECT lang, word, n, share FROM (SELECT *, round(n / sum(n) OVER (PARTITION BY lang), 6) AS share FROM ({FIRST})) WHERE n >= 2 AND share >= 0.002"


def document_lines(t):
    return mining.lines(t("documents"), "text", ["lang"])


@query(MINED)
def mined_first_words(t):
    return mining.mined(document_lines(t), ["lang"], 2, 0.002)


@query(f"SELECT lang, word, n AS matches FROM ({MINED})")
def mined_matches(t):
    found = document_lines(t)
    return mining.applied(found, mining.mined(found, ["lang"], 2, 0.002), ["lang"])


@query(r"""SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(string_split(text, chr(10))[1], '([.^$*+?()\[\]{}|\\])', '\\\1', 'g'), '''[^'']*''|"[^"]*"', '[''"]([^''"]+)[''"]', 'g'), '(^|[^A-Za-z0-9_\\\[\]])[0-9]+', '\1\\d+', 'g'), '\s+', '\\s+', 'g') AS pattern FROM conversations WHERE text IS NOT NULL""")
def generalised_lines(t):
    return t("conversations").where("text IS NOT NULL").select("conv_id", "turn", mining.generalised(F.split("text", "\n")[0]).alias("pattern"))


OO, FUNCTIONAL = (r"(?i)\b(class|interface|extends|implements|prototype)\b", r"(?i)\b(function|lambda|=>|->|map|filter|reduce)\b")
SECTION = "regexp_extract(url, '^[a-z]+://[^/?#]+/([a-z]+)/', 1)"
EVIDENCE = f"""WITH p AS (SELECT {SECTION} AS section, html FROM pages), t AS (SELECT section, count(*) AS files FROM p GROUP BY section),
    e AS (SELECT section, unnest(list_filter([CASE WHEN regexp_matches(html, '{OO}') THEN 'object-oriented' END, CASE WHEN regexp_matches(html, '{FUNCTIONAL}') THEN 'functional' END], lambda x: x IS NOT NULL)) AS paradigm FROM p WHERE length(html) <= 500000),
    c AS (SELECT section, paradigm, count(*) AS n FROM e GROUP BY ALL)"""


def sections(t):
    return t("pages").select(F.regexp_extract("url", "^[a-z]+://[^/?#]+/([a-z]+)/", 1).alias("section"), "html")


@query(f"{EVIDENCE} SELECT section, paradigm, n, round(n / files, 6) AS share, CASE WHEN n / files >= 0.3 THEN round(least(0.9, 0.6 + 0.3 * round(n / files, 6)), 6) END AS confidence FROM c JOIN t USING (section)")
def paradigm_evidence(t):
    return mining.evidence(sections(t), "html", ["section"]).withColumn("confidence", mining.construct_confidence(F.col("share")))


@query(f"{EVIDENCE}, r AS (SELECT section, string_agg(paradigm, ',' ORDER BY n DESC, paradigm) AS paradigms FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY n DESC, paradigm) AS k FROM c) WHERE k <= 3 GROUP BY section) SELECT section, coalesce(paradigms, 'general-purpose') AS paradigms FROM t LEFT JOIN r USING (section)")
def paradigms_by_section(t):
    return mining.paradigms(sections(t), "html", ["section"])


@query(f"{EVIDENCE}, r AS (SELECT section, string_agg(paradigm, ',' ORDER BY n DESC, paradigm) AS paradigms FROM (SELECT c.*, row_number() OVER (PARTITION BY section ORDER BY n DESC, paradigm) AS k FROM c JOIN t USING (section) WHERE round(n / files, 6) >= 0.3) WHERE k <= 2 GROUP BY section) SELECT section, coalesce(paradigms, 'general-purpose') AS paradigms FROM t LEFT JOIN r USING (section)")
def main_paradigms(t):
    return mining.paradigms(sections(t), "html", ["section"], 2, 0.3)


@query(r"""SELECT language, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(html, 'import\s+React|export\s+default|const\s+\w+\s*=') THEN 'JavaScript' WHEN regexp_matches(html, 'interface\s+\w+|type\s+\w+\s*=|export\s+class') THEN 'TypeScript' WHEN regexp_matches(html, 'def\s+\w+\s*\(|import\s+\w+|class\s+\w+\s*:') THEN 'Python' WHEN regexp_matches(html, 'public\s+class|private\s+static|package\s+\w+;') THEN 'Java' END AS language FROM pages) GROUP BY language""")
def content_languages(t):
    return t("pages").groupBy(mining.content_language(F.col("html")).alias("language")).agg(F.count("*").alias("n"))


@query("WITH d AS (SELECT DISTINCT lang, source FROM documents WHERE lang IS NOT NULL) SELECT x.lang AS a, y.lang AS b, count(*) AS places FROM d x JOIN d y ON x.source = y.source AND x.lang < y.lang GROUP BY ALL")
def languages_sharing_sources(t):
    return mining.shared_places(t("documents"), "lang", "source")


@query(r"""WITH q AS (SELECT page_id, trim(regexp_extract(html, '[''"]([^''"]+)[''"]', 1)) AS q, regexp_extract(html, '\b(?:import|from|require|use)\s+([a-zA-Z_][\w.]*)', 1) AS w FROM pages) SELECT page_id, CASE WHEN q <> '' AND NOT contains(q, ' ') THEN q WHEN w <> '' THEN w END AS module FROM q""")
def module_specifiers(t):
    return t("pages").select("page_id", mining.specifier(F.col("html")).alias("module"))


@query("SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: regexp_matches(x, '^[A-Z]'))[1:3], '|') AS lines FROM documents WHERE text IS NOT NULL")
def first_capital_lines(t):
    return t("documents").where("text IS NOT NULL").select("doc_id", F.array_join(mining.first_lines(F.col("text"), "^[A-Z]", 3), "|").alias("lines"))


@query("""SELECT * FROM (SELECT page_id, p.pattern, regexp_extract(html, p.re) AS match, strpos(html, regexp_extract(html, p.re)) AS at FROM pages, (VALUES ('title', '<title>[^<]*</title>'), ('link', 'href="[^"]+"')) p(pattern, re)) WHERE match <> ''""")
def registry_matches(t):
    return mining.registry(t("pages"), "html", {"title": "<title>[^<]*</title>", "link": 'href="[^"]+"'}, ["page_id"])


SEEDS = " UNION ALL ".join(f"SELECT '{name}' AS pattern, unnest(regexp_extract_all(n, '{p}', 1)) AS found FROM v" for name, p in mining.ROLE_SEEDS.items())


@query(f"WITH v AS ({VARIANTS}) SELECT pattern, found, count(*) AS n FROM ({SEEDS}) GROUP BY ALL")
def role_seed_matches(t):
    from ..functions import text

    return text.matches(variants(t), "n", mining.ROLE_SEEDS, []).groupBy("pattern", "found").agg(F.count("*").alias("n"))


# units

MEMBERS = f"SELECT k AS id, n, n AS name, brand FROM ({VARIANTS})"
NEXT = "SELECT a.l_partkey AS source_id, b.l_partkey AS target_id FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1"


def members(t):
    return variants(t).select(F.col("k").alias("id"), F.col("n").alias("name"), "brand")


def next_parts(t):
    own = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    a = own.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_partkey").alias("source_id"))
    return a.join(own.withColumnRenamed("l_partkey", "target_id"), ["l_orderkey", "l_linenumber"]).select("source_id", "target_id")


COMMON = "coalesce(list_max(list_filter(range(1, least(length({a}), length({b}))::BIGINT + 1), lambda k: left({a}, k) = left({b}, k))), 0)"
AFFIX = "CASE WHEN {x} > 2 THEN least(1.0, {x} / 8) ELSE 0.0 END"
UNITS = f"""WITH m AS ({MEMBERS}), w AS (SELECT DISTINCT brand, id, unnest({WORDS}) AS concept FROM m),
    c AS (SELECT brand, concept, row_number() OVER (PARTITION BY brand ORDER BY count(*) DESC, concept) AS place FROM w GROUP BY brand, concept),
    v AS (SELECT brand, count(DISTINCT id) AS covered FROM w JOIN c USING (brand, concept) WHERE place <= 3 GROUP BY brand),
    z AS (SELECT brand, count(DISTINCT id) AS n, min(name) AS low, max(name) AS high, min(reverse(name)) AS rlow, max(reverse(name)) AS rhigh FROM m GROUP BY brand),
    l AS (SELECT brand, n, {COMMON.format(a="low", b="high")} AS p, {COMMON.format(a="rlow", b="rhigh")} AS s FROM z),
    s AS (SELECT brand, n, round(CASE WHEN n < 2 THEN 0.5 ELSE greatest({AFFIX.format(x="p")}, {AFFIX.format(x="s")}, 0.1) END, 6) AS similarity FROM l),
    e AS (SELECT DISTINCT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b FROM ({NEXT}) WHERE source_id <> target_id),
    i AS (SELECT x.brand, count(*) AS inner_edges FROM e JOIN m x ON x.id = a JOIN m y ON y.id = b AND y.brand = x.brand GROUP BY x.brand),
    h AS (SELECT brand, n, round(0.5 * round(coalesce(covered, 0) / n, 6) + 0.2 * similarity + 0.3 * least(1.0, coalesce(inner_edges, 0) / (n * (n - 1) / 2)), 6) AS coherence FROM s LEFT JOIN v USING (brand) LEFT JOIN i USING (brand) WHERE n >= 3)"""


@query(f"{UNITS} SELECT brand, n, coherence::DOUBLE AS coherence, round(least(0.9, 0.6 + 0.3 * coherence), 6)::DOUBLE AS confidence FROM h WHERE coherence > 0.05")
def directory_units(t):
    from ..functions import names

    concepts = members(t).select("id", F.explode(F.array_distinct(names.words(F.col("name")))).alias("concept"))
    return units.directory_units(members(t), concepts, next_parts(t), "brand", 3, 0.05)


NAMING = f"""WITH m AS (SELECT brand, n, CASE WHEN length(n) >= 6 AND left(n, 3) IN ('get', 'set', 'has', 'use') THEN left(n, 3) END AS p, CASE WHEN suffix(n, 'Service') THEN 'Service' WHEN contains(n, '.') THEN regexp_extract(n, '[^.]*$') END AS s, {CASING} AS c FROM ({VARIANTS})),
    z AS (SELECT brand, count(*) AS size FROM m GROUP BY brand), l AS (SELECT brand, 'prefix' AS kind, p AS value, 0.15 AS least FROM m UNION ALL SELECT brand, 'suffix', s, 0.15 FROM m UNION ALL SELECT brand, 'casing', c, 0.3 FROM m),
    q AS (SELECT brand, kind, value, count(*) AS n, any_value(least) AS least FROM l WHERE value IS NOT NULL GROUP BY brand, kind, value), r AS (SELECT brand, kind, value, round(n / size, 6) AS share, size FROM q JOIN z USING (brand) WHERE n / size >= least)"""


@query(f"{NAMING} SELECT brand, kind, value, share FROM r")
def naming_patterns(t):
    return units.naming_patterns(members(t), "brand", 0.15, 0.3)


@query(f"{NAMING} SELECT kind, value, count(*) AS groups, sum(size)::BIGINT AS members FROM r WHERE size >= 3 GROUP BY ALL")
def cluster_patterns(t):
    return units.cluster_patterns(members(t), "brand", 3, 0.15, 0.3)


@query(f"""WITH v AS (SELECT k, brand, list_distinct({WORDS}) AS w FROM ({VARIANTS})) SELECT x.brand, round(avg(len(list_intersect(x.w, y.w)) / (len(x.w) + len(y.w) - len(list_intersect(x.w, y.w)))), 6) AS overlap FROM v x JOIN v y ON x.brand = y.brand AND x.k < y.k GROUP BY x.brand""")
def mean_word_overlap(t):
    return units.mean_word_overlap(members(t), "brand")


USUAL = ", ".join(f"'{w}'" for w in USUAL_WORDS.split())


@query(f"""WITH v AS ({VARIANTS}), z AS (SELECT brand, count(*) AS size, min(n) AS low, max(n) AS high FROM v GROUP BY brand), w AS (SELECT brand, unnest({WORDS}) AS word FROM v),
    c AS (SELECT brand, word, count(*) AS c, row_number() OVER (PARTITION BY brand ORDER BY count(*) DESC, word) AS place FROM w WHERE length(word) > 2 AND lower(word) NOT IN ({USUAL}) GROUP BY brand, word),
    t AS (SELECT z.brand, CASE WHEN c >= greatest(2, size / 3) THEN word WHEN {COMMON.format(a="low", b="high")} >= 3 AND lower(left(low, {COMMON.format(a="low", b="high")})) NOT IN ({USUAL}) THEN left(low, {COMMON.format(a="low", b="high")}) ELSE low END AS title FROM z LEFT JOIN c ON z.brand = c.brand AND place = 1)
    SELECT brand, upper(left(title, 1)) || substr(title, 2) AS title FROM t""")
def group_names(t):
    return units.group_name(members(t), "brand")


@query("""WITH l AS (SELECT doc_id AS id, 'good' AS label FROM labels WHERE quality = 1 UNION SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1), g AS (SELECT id, string_agg(label, ',' ORDER BY label) AS tags FROM l GROUP BY id) SELECT DISTINCT doc_id AS id, coalesce(tags, '') AS tags FROM documents LEFT JOIN g ON id = doc_id""")
def document_tags(t):
    named = t("labels").select(F.col("doc_id").alias("id"), F.explode(F.array(F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic"))).alias("label")).where("label IS NOT NULL")
    return units.tags(t("documents").select(F.col("doc_id").alias("id")), named).select("id", F.array_join("tags", ",").alias("tags"))


# vectors and retrieval


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN doc_id END AS i, CASE WHEN doc_id % 5 > 0 THEN source END AS name, lang || '/' || source AS path FROM documents)
    SELECT doc_id, CASE WHEN i IS NOT NULL THEN i::VARCHAR WHEN coalesce(name, '') <> '' AND coalesce(path, '') <> '' THEN name || ':' || path ELSE regexp_replace('item_name_' || coalesce(name, '') || '_filePath_' || coalesce(path, ''), '[^a-zA-Z0-9_]', '_', 'g') END AS id FROM d""")
def item_ids(t):
    name = F.when(F.col("doc_id") % 5 > 0, F.col("source"))
    return t("documents").select("doc_id", retrieval.item_id(F.when(F.col("doc_id") % 3 == 0, F.col("doc_id")), name, F.concat_ws("/", "lang", "source")).alias("id"))


@query("SELECT label, count(*) AS n FROM embeddings WHERE label <> 3 GROUP BY label")
def vector_delete(t):
    items = t("embeddings")
    return retrieval.without(items, items.where("label = 3"), "vec_id").groupBy("label").agg(F.count("*").alias("n"))


KINDS = ("explanation", "implementation", "architecture", "bug", "standard", "pattern")


@query(f"""WITH r AS (SELECT vec_id AS request, embedding AS query, [{", ".join(f"'{k}'" for k in KINDS)}][(vec_id // 100) % 6 + 1] AS kind FROM embeddings WHERE vec_id % 100 = 0),
    p AS (SELECT *, CASE kind WHEN 'implementation' THEN 5 WHEN 'standard' THEN 5 WHEN 'architecture' THEN 15 WHEN 'pattern' THEN 15 WHEN 'bug' THEN 12 ELSE 8 END AS most FROM r),
    s AS (SELECT request, most, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], query::DOUBLE[]), 6) AS score FROM p, embeddings e), k AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY score DESC, vec_id) AS rank FROM s WHERE score >= 0.1)
    SELECT request, rank, vec_id, score FROM k WHERE rank <= most""")
def retrieval_by_type(t):
    kind = F.array(*map(F.lit, KINDS))[((F.col("vec_id") / 100).cast("int") % 6)]
    asked = t("embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("request"), F.col("embedding").alias("query"), kind.alias("kind"))
    return retrieval.retrieve(t("embeddings"), asked, "vec_id", "embedding", F.lit(0.1))


HIERARCHY = "SELECT 'contains' AS type, 'region:' || n_regionkey AS source_id, 'nation:' || n_nationkey AS target_id FROM nation UNION ALL SELECT 'contains', 'nation:' || c_nationkey, 'customer:' || c_custkey FROM customer UNION ALL SELECT 'supplies', 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier"


def hierarchy(t):
    edge = lambda kind, a, x, b, y: (F.lit(kind).alias("type"), F.concat(F.lit(a), F.col(x)).alias("source_id"), F.concat(F.lit(b), F.col(y)).alias("target_id"))
    out = t("nation").select(*edge("contains", "region:", "n_regionkey", "nation:", "n_nationkey"))
    out = out.unionByName(t("customer").select(*edge("contains", "nation:", "c_nationkey", "customer:", "c_custkey")))
    return out.unionByName(t("supplier").select(*edge("supplies", "supplier:", "s_suppkey", "nation:", "s_nationkey")))


@query(f"""WITH e AS (SELECT * FROM ({HIERARCHY}) WHERE type = 'contains'), one AS (SELECT * FROM e WHERE 'nation:3' IN (source_id, target_id)), n AS (SELECT source_id AS node FROM one UNION SELECT target_id FROM one), two AS (SELECT DISTINCT e.* FROM e JOIN n ON node IN (source_id, target_id))
    SELECT type, source_id, target_id, min(distance) AS distance FROM (SELECT *, 1 AS distance FROM one UNION ALL SELECT *, 2 FROM two) GROUP BY ALL""")
def component_relations(t):
    return retrieval.relations(hierarchy(t), "nation:3", ["contains"], 2)


# data flow

VERBS = " ".join(f"WHEN starts_with(n, '{v}') THEN substr(n, {len(v) + 1})" for v in dataflow.DATA_VERBS)


@query(rf"""WITH v AS (SELECT k, n, CASE {VERBS} ELSE n END AS r FROM ({VARIANTS})) SELECT k, array_to_string(list_concat(list_filter(string_split(lower(replace(regexp_replace(r, '([a-z])([A-Z])', '\1 \2', 'g'), '_', ' ')), ' '), lambda x: x <> ''), [n]), '|') AS terms FROM v""")
def data_terms(t):
    return variants(t).select("k", F.array_join(dataflow.data_terms(F.col("n")), "|").alias("terms"))


HITS = ", ".join(f"CASE WHEN regexp_matches(h, '{p}') THEN '{name}' END" for name, p in dataflow.CALL_TRANSFORMATIONS)


@query(f"SELECT page_id, array_to_string(list_filter([{HITS}], lambda x: x IS NOT NULL), ',') AS found FROM (SELECT page_id, lower(html) AS h FROM pages WHERE html IS NOT NULL)")
def call_transformations(t):
    return t("pages").where("html IS NOT NULL").select("page_id", F.array_join(dataflow.call_transformations(F.col("html")), ",").alias("found"))


@query(f"SELECT round(least(0.95, 0.7 + 0.15 * contains(n, 'Service')::INT + 0.1 * starts_with(n, 'get')::INT), 6)::DOUBLE AS confidence, count(*) AS n FROM ({VARIANTS}) GROUP BY 1")
def node_confidences(t):
    value = dataflow.node_confidence(F.contains("n", F.lit("Service")), F.startswith("n", F.lit("get")))
    return variants(t).groupBy(F.round(value, 6).alias("confidence")).agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT l_suppkey AS source_id, l_partkey AS target_id, l_returnflag AS type, max(l_discount) AS confidence FROM lineitem GROUP BY ALL) SELECT f.* FROM f ANTI JOIN (SELECT DISTINCT l_suppkey, l_partkey, l_returnflag FROM lineitem WHERE l_linestatus = 'F') o ON source_id = l_suppkey AND target_id = l_partkey AND type = l_returnflag""")
def flow_relationships(t):
    flows = t("lineitem").select(F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("target_id"), F.col("l_returnflag").alias("type"), F.col("l_discount").alias("confidence"), "l_linestatus")
    return dataflow.relationship_rows(flows.drop("l_linestatus"), flows.where("l_linestatus = 'F'"))


TERM_SQL = r"list_filter(list_distinct(list_concat(list_filter(string_split(replace(r, '_', ' '), ' '), lambda x: x <> ''), [n])), lambda x: length(x) >= 3)"
GIVES, TAKES = ("|".join(x) for x in (dataflow.GIVING, dataflow.TAKING))


@query(f"""WITH m AS (SELECT type AS unit, k AS id, lower(n) AS n, k % 97 AS line FROM ({VARIANTS})), s AS (SELECT unit, id, n, CASE {VERBS} ELSE n END AS r FROM m), w AS (SELECT unit, id, unnest({TERM_SQL}) AS term FROM s),
    e AS (SELECT DISTINCT source_id, target_id FROM ({NEXT})), g AS (SELECT unit, source_id, target_id FROM e JOIN m ON m.id = source_id),
    p AS (SELECT x.unit, x.id AS a, y.id AS b, 'term' AS evidence FROM w x JOIN w y ON x.unit = y.unit AND x.term = y.term AND x.id < y.id
        UNION SELECT x.unit, x.id, y.id, 'edge' FROM e JOIN m x ON x.id = least(source_id, target_id) JOIN m y ON y.id = greatest(source_id, target_id) AND y.unit = x.unit WHERE source_id <> target_id
        UNION SELECT x.unit, x.source_id, y.source_id, 'target' FROM g x JOIN g y ON x.unit = y.unit AND x.target_id = y.target_id AND x.source_id < y.source_id),
    q AS (SELECT unit, a, b, string_agg(evidence, ',' ORDER BY evidence) AS evidence FROM p GROUP BY unit, a, b),
    d AS (SELECT q.*, CASE WHEN f.source_id IS NOT NULL THEN true WHEN k.source_id IS NOT NULL THEN false WHEN regexp_matches(x.n, '{GIVES}') AND regexp_matches(y.n, '{TAKES}') THEN true WHEN regexp_matches(y.n, '{GIVES}') AND regexp_matches(x.n, '{TAKES}') THEN false ELSE x.line <= y.line END AS straight
        FROM q JOIN m x ON x.id = a JOIN m y ON y.id = b LEFT JOIN e f ON f.source_id = a AND f.target_id = b LEFT JOIN e k ON k.source_id = b AND k.target_id = a)
    SELECT CASE WHEN straight THEN a ELSE b END AS source_id, CASE WHEN straight THEN b ELSE a END AS target_id, unit, evidence, 0.6::DOUBLE AS confidence FROM d""")
def conceptual_flows(t):
    own = variants(t).select(F.col("type").alias("unit"), F.col("k").alias("id"), F.col("n").alias("name"), (F.col("k") % 97).alias("start_line"))
    return dataflow.conceptual_flows(own, next_parts(t))


@query("""SELECT 'region:' || r_regionkey || '>nation:' || n_nationkey || '>customer:' || c_custkey AS path, r_name || ' to ' || c_name AS name, 'Data flows from ' || r_name || ' (source) to ' || c_name || ' (sink) through 1 intermediate steps' AS description FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey""")
def path_names(t):
    node = lambda kind, key: F.concat(F.lit(kind), F.col(key))
    joined = t("region").join(t("nation"), F.col("r_regionkey") == F.col("n_regionkey")).join(t("customer"), F.col("c_nationkey") == F.col("n_nationkey"))
    nodes = F.array(node("region:", "r_regionkey"), node("nation:", "n_nationkey"), node("customer:", "c_custkey"))
    found = joined.select(nodes.alias("nodes")).select("nodes", F.col("nodes")[0].alias("entry"), F.col("nodes")[2].alias("exit"))
    named = t("region").select(node("region:", "r_regionkey").alias("node_id"), F.col("r_name").alias("name"), F.lit("source").alias("role"))
    named = named.unionByName(t("customer").select(node("customer:", "c_custkey").alias("node_id"), F.col("c_name").alias("name"), F.lit("sink").alias("role")))
    return dataflow.named_paths(found, named).select(F.array_join("nodes", ">").alias("path"), "name", "description")


# hashes and files


@query(f"""SELECT brand, sha256(brand || ':' || string_agg(k::VARCHAR, ',' ORDER BY k) || ':' || 'part') AS cluster, sha256(brand || ':naming:' || min(n) || ':' || count(*)) AS pattern FROM ({VARIANTS}) GROUP BY brand""")
def group_hashes(t):
    found = members(t).groupBy("brand").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.min("name").alias("first"), F.count("*").alias("n"))
    return found.select("brand", hashes.cluster_hash(F.col("brand"), F.col("ids"), F.lit("part")).alias("cluster"), hashes.pattern_hash(F.col("brand"), F.lit("naming"), F.col("first"), F.col("n")).alias("pattern"))


@query("""SELECT p_partkey, sha256(p_name || ':store:' || p_partkey || ':{"size":' || p_size || '}') AS hash FROM part""")
def data_node_hashes(t):
    return t("part").select("p_partkey", hashes.data_node_hash(F.col("p_name"), F.lit("store"), F.col("p_partkey"), F.struct(F.col("p_size").alias("size"))).alias("hash"))


@query("""SELECT path FROM (SELECT source || '/' || lang || '/' || doc_id || '.' || lang AS path, lang FROM documents) WHERE lang IN ('en', 'fr') AND NOT regexp_matches(path, 'src1/|/fr/.*7[.]')""")
def filtered_files(t):
    path = F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id"), F.lit("."), F.col("lang"))
    files = t("documents").select(path.alias("path")).withColumn("extension", paths.extension(F.col("path")))
    return tree.listed(files, include_extensions=(".en", ".fr"), exclude_patterns=("^src1(/|$)", "/fr/.*7[.]")).select("path")
