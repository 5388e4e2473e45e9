"""Registered queries of resolution, phrases, structure, architecture and answers, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..functions.names import first_of
from ..operators import clustering, dataflow, dependencies, diff, mining, patterns, relationships, responses
from .catalogue import VARIANTS, WORDS, variants
from .registry import query


def quoted(pattern: str) -> str:
    """A pattern as a SQL literal."""
    return "'" + pattern.replace("'", "''") + "'"


# snapshots

SIDES = {"old": ("c_custkey % 7 <> 0", "c_name", "s_suppkey % 7 <> 0", "s_name"), "new": ("c_custkey % 5 <> 0", "CASE WHEN c_custkey % 11 = 0 THEN upper(c_name) ELSE c_name END", "s_suppkey % 5 <> 0", "CASE WHEN s_suppkey % 11 = 0 THEN upper(s_name) ELSE s_name END")}
SNAPSHOT = {side: f"SELECT 'concept:' || c_custkey AS key, {cd} AS d FROM customer WHERE {cw} UNION ALL SELECT 'unit:' || s_suppkey, {sd} FROM supplier WHERE {sw}" for side, (cw, cd, sw, sd) in SIDES.items()}


@query(f"SELECT key, CASE WHEN o.key IS NULL THEN 'added' WHEN n.key IS NULL THEN 'deleted' WHEN o.d IS NOT DISTINCT FROM n.d THEN 'unchanged' ELSE 'modified' END AS status FROM ({SNAPSHOT['old']}) o FULL JOIN ({SNAPSHOT['new']}) n USING (key)")
def collections_diff(t):
    c, s = t("customer"), t("supplier")
    at = lambda df, side, key, name: df.where(SIDES[side][0 if key == "c_custkey" else 2]).select(F.col(key).alias("key"), F.expr(SIDES[side][1 if key == "c_custkey" else 3]).alias("d"))
    return diff.collections_diff({"concept": (at(c, "old", "c_custkey", "c"), at(c, "new", "c_custkey", "c")), "unit": (at(s, "old", "s_suppkey", "s"), at(s, "new", "s_suppkey", "s"))}, "key", "d")


# texts

COUNTS = ", ".join(f"len(regexp_extract_all(html, {quoted(p)}))::INT AS {name}" for name, p in mining.STRUCTURES.items())


@query(f"SELECT page_id, len(string_split(html, chr(10)))::INT AS lines, {COUNTS} FROM pages WHERE html IS NOT NULL")
def structure_counts(t):
    return t("pages").where("html IS NOT NULL").select("page_id", *mining.structure_counts(F.col("html")))


STOPS = ", ".join(quoted(w) for w in dict.fromkeys((*text.STOP_WORDS, *text.COMMON_WORDS)) if w not in text.ABBREVIATIONS)  # written out in catalogue_tree
DOMAIN = ", ".join(f"regexp_extract(array_to_string(w, ' '), {quoted(p)})" for p in text.DOMAIN_TERMS)


@query(rf"""WITH w AS (SELECT item_id, text, list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9_]+', ' ', 'g')), ' '), lambda x: length(x) > 2 AND x NOT IN ({STOPS})) AS w FROM benchmark WHERE text IS NOT NULL),
    p AS (SELECT unnest(list_concat(w, list_filter([{DOMAIN}], lambda x: x <> ''), list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]),
        list_transform(regexp_extract_all(text, {quoted(text.CAPITALISED)}), lambda x: lower(x)))) AS phrase FROM w)
    SELECT phrase, count(*) AS n FROM p GROUP BY phrase""")
def key_phrases(t):
    return t("benchmark").select(F.explode(text.key_phrases(F.col("text"))).alias("phrase")).groupBy("phrase").agg(F.count("*").alias("n"))


@query("SELECT event_id, array_to_string(list_sort(list_filter([event_type, event_type || 'Done', 'k' || user_id], lambda x: length(x) >= 3)), ',') AS names FROM events")
def event_names(t):
    kind, head = F.col("event_type"), F.concat(F.upper(F.left("event_type", F.lit(1))), F.substring("event_type", 2, 100))
    code = F.concat(F.lit("bus.emit('"), kind, F.lit("'); bus.on(\""), kind, F.lit("\", on"), head, F.lit("Done); handleIt(`x`); dispatch ( `k"), F.col("user_id"), F.lit("`)"))
    return t("events").select("event_id", F.array_join(F.array_sort(F.filter(text.event_names(code), lambda x: x != "it")), ",").alias("names"))


@query("""WITH o AS (SELECT DISTINCT 'p' || doc_id % 3 AS pattern, CASE WHEN doc_id % 2 = 0 THEN source END AS extension, CASE WHEN doc_id % 2 = 1 THEN lang END AS language FROM documents WHERE doc_id % 50 < 2),
    e AS (SELECT doc_id, pattern FROM documents JOIN o ON o.extension = source UNION SELECT doc_id, pattern FROM documents JOIN o ON o.language = lang) SELECT pattern, count(*) AS files FROM e GROUP BY pattern""")
def eligible_patterns(t):
    docs = t("documents")
    seen = docs.where("doc_id % 50 < 2").select(F.concat(F.lit("p"), F.col("doc_id") % 3).alias("pattern"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("extension"), F.when(F.col("doc_id") % 2 == 1, F.col("lang")).alias("language"))
    files = docs.select("doc_id", F.col("source").alias("extension"), F.col("lang").alias("language"))
    return mining.eligible(files, seen).groupBy("pattern").agg(F.count("*").alias("files"))


# imports

CODE = "SELECT 'src/' || k || '.ts' AS path, k, n FROM (" + VARIANTS + ") WHERE k % 2 = 0"


@query(f"""WITH c AS ({CODE}) SELECT path, 2 AS line, './' || n AS module, 'es' AS pattern, 0.8::DOUBLE AS confidence FROM c WHERE k % 4 = 0
    UNION ALL SELECT path, 3, n, 'commonjs', 0.8 FROM c UNION ALL SELECT path, 4, 'os.path', 'python', 0.8 FROM c WHERE k % 6 = 0 UNION ALL SELECT path, 5, 'a.b', 'python_from', 0.8 FROM c""")
def import_rows(t):
    k, n = F.col("k"), F.col("n")
    second = F.when(k % 4 == 0, F.concat(F.lit("import {x} from './"), n, F.lit("'; import y from './"), n, F.lit("'"))).otherwise("let x")
    third = F.concat(F.lit("const r = require('"), n, F.lit("')"))
    content = F.concat_ws("\n", F.lit("// head"), second, third, F.when(k % 6 == 0, "  import os.path").otherwise(""), F.lit("from a.b import c"))
    return relationships.import_rows(variants(t).where("k % 2 = 0").select(F.concat(F.lit("src/"), k, F.lit(".ts")).alias("path"), content.alias("content")))


TREE = "SELECT DISTINCT source || '/' || coalesce(lang, 'xx') || '/f' || doc_id // 3 || ['.js', '.ts', '.py', '/index.ts'][doc_id % 4 + 1] AS path, source || '/' || coalesce(lang, 'xx') AS dir, 'f' || doc_id // 3 AS stem, doc_id % 4 AS kind, doc_id // 3 AS k FROM documents"


@query(rf"""WITH f AS ({TREE}), m AS (SELECT DISTINCT path, dir, x.form, CASE x.form WHEN 0 THEN './f' || k + 1 WHEN 1 THEN 'pkg/f' || k WHEN 2 THEN '/' || dir || '/f' || k ELSE '../en/f' || k END AS module, regexp_extract(dir, '^[^/]+') AS top, k FROM f, (VALUES (0), (1), (2), (3)) x(form)),
    b AS (SELECT path, module, CASE form WHEN 0 THEN dir || '/f' || k + 1 WHEN 2 THEN dir || '/f' || k ELSE top || '/en/f' || k END AS base FROM m WHERE form <> 1),
    h AS (SELECT b.path, b.module, f.path AS target_id FROM b, (SELECT unnest(['', '.js', '.ts', '.jsx', '.tsx', '.json', '.mjs', '.cjs', '/index.js', '/index.ts', '/index.jsx', '/index.tsx']) AS e) JOIN f ON f.path = base || e
        UNION SELECT m.path, m.module, f.path FROM m JOIN f ON form = 1 AND f.kind IN (0, 1) AND f.stem = 'f' || m.k)
    SELECT path, module, target_id, round(CASE WHEN count(*) OVER (PARTITION BY path, module) > 1 THEN 0.63 ELSE 0.7 END, 6)::DOUBLE AS confidence FROM h WHERE target_id <> path""")
def specifier_resolution(t):
    k = F.floor(F.col("doc_id") / 3)
    own = t("documents").select(F.concat_ws("/", "source", F.coalesce("lang", F.lit("xx"))).alias("dir"), k.alias("k"), F.array(*map(F.lit, (".js", ".ts", ".py", "/index.ts")))[(F.col("doc_id") % 4).cast("int")].alias("end")).where("dir IS NOT NULL")
    files = own.withColumn("path", F.concat("dir", F.lit("/f"), "k", "end")).distinct()
    f = lambda head, number: F.concat(F.lit(head), F.lit("f"), number)
    forms = F.array(f("./", F.col("k") + 1), f("pkg/", F.col("k")), F.concat(F.lit("/"), "dir", F.lit("/f"), "k"), f("../en/", F.col("k")))
    # an index file lies one folder deeper, so its relative forms start from its own folder
    found = files.withColumn("module", F.explode(forms)).withColumn("module", F.when(F.endswith("path", F.lit("/index.ts")) & F.startswith("module", F.lit(".")), F.concat(F.when(F.startswith("module", F.lit("./")), "../").otherwise("../../"), F.regexp_replace("module", r"^\.\.?/", ""))).otherwise(F.col("module")))
    hits = relationships.resolve_specifiers(found.select("path", "module").distinct(), files.select("path"))
    plain = F.when(F.endswith("path", F.lit("/index.ts")) & F.startswith("module", F.lit("../")), F.concat(F.when(F.startswith("module", F.lit("../../")), "../").otherwise("./"), F.regexp_replace("module", r"^(\.\./)+", ""))).otherwise(F.col("module"))
    return hits.withColumn("module", plain)


MAY = "(m.module = regexp_extract(e.target, '([^/]+)[.]ts$', 1) OR contains(e.target, m.module) OR contains(m.module, e.target) OR (regexp_replace(m.module, '/?[^/]*$', '') NOT IN ('', '.') AND starts_with(e.target, regexp_replace(m.module, '/?[^/]*$', ''))))"


@query(f"""WITH c AS (SELECT DISTINCT 'r' || n_regionkey AS path, CASE c_custkey % 4 WHEN 0 THEN lower(n_name) WHEN 1 THEN 'lib/' || lower(n_name) WHEN 2 THEN './' || lower(n_name) ELSE 'x/' || c_custkey % 3 END AS module FROM customer JOIN nation ON c_nationkey = n_nationkey),
    e AS (SELECT 'r' || n_regionkey AS path, 'lib/' || lower(n_name) || '.ts' AS target FROM nation) SELECT m.path, m.module, min(CASE WHEN {MAY} THEN e.target END) AS resolved_path FROM c m LEFT JOIN e ON e.path = m.path GROUP BY m.path, m.module""")
def enriched_imports(t):
    low, path, kind = F.lower("n_name"), F.concat(F.lit("r"), "n_regionkey"), F.col("c_custkey") % 4
    module = first_of([(kind == 0, low), (kind == 1, F.concat(F.lit("lib/"), low)), (kind == 2, F.concat(F.lit("./"), low))], F.concat(F.lit("x/"), F.col("c_custkey") % 3))
    imports = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(path.alias("path"), module.alias("module")).distinct()
    return dependencies.enriched(imports, t("nation").select(path.alias("source_id"), F.concat(F.lit("lib/"), low, F.lit(".ts")).alias("target_id")))


LAYER_NAMES = ("model", "view", "service", "data")
LINKS = f"SELECT DISTINCT [{', '.join(map(quoted, LAYER_NAMES))}][o_custkey % 4 + 1] AS x, [{', '.join(map(quoted, LAYER_NAMES))}][(o_custkey + 1) % 4 + 1] AS y FROM orders"


@query(f"""WITH m AS (SELECT max(n) AS n FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_suppkey)), g AS (SELECT count(*) AS n FROM (SELECT count(*) AS s FROM supplier GROUP BY s_nationkey) WHERE s > 2),
    w AS (SELECT count(*) AS n FROM (SELECT least(x, y), greatest(x, y), count(*) AS k FROM ({LINKS}) GROUP BY ALL) WHERE k = 1), l AS (SELECT count(DISTINCT x) AS k FROM (SELECT x FROM ({LINKS}) UNION SELECT y FROM ({LINKS})))
    SELECT 'central' AS name, n, round(0.7 + least(0.2, n / 50), 6)::DOUBLE AS confidence FROM m WHERE n > 5 UNION ALL SELECT 'modular', n, round(0.7 + least(0.2, n / 10), 6) FROM g WHERE n >= 3 UNION ALL SELECT 'layered', w.n, 0.75 FROM w, l WHERE w.n > 0.6 * l.k * (l.k - 1) / 2""")
def dependency_architecture(t):
    rolled = dependencies.roll_up(t("lineitem"), "l_suppkey", "l_orderkey")
    groups = t("supplier").groupBy("s_nationkey").agg(F.count("*").alias("strength"))
    layer = lambda shift: F.concat(F.lit("app/"), F.array(*map(F.lit, LAYER_NAMES))[((F.col("o_custkey") + shift) % 4).cast("int")], F.lit("s/f"), F.col("o_custkey"), F.lit(".ts"))
    return dependencies.architecture(rolled, groups, t("orders").select(layer(0).alias("source_id"), layer(1).alias("target_id")))


FOLDERS = "SELECT source || '/' || coalesce(lang || '/', '') || doc_id || '.txt' AS path, source, coalesce(lang, doc_id::VARCHAR) AS child, lang FROM documents WHERE source IS NOT NULL"


@query(f"""SELECT 'organisation' AS type, 'feature-based' AS name, count(*) AS frequency, 0.7::DOUBLE AS confidence, 0.8::DOUBLE AS importance FROM (SELECT source FROM ({FOLDERS}) GROUP BY source HAVING count(DISTINCT child) > 1 AND count(lang) > 0) HAVING count(*) >= 3
    UNION ALL SELECT 'organisation', 'mvc folders', 3, 0.9, 0.9 FROM region WHERE r_regionkey = 0""")
def folder_organisation(t):
    path = F.concat(F.col("source"), F.lit("/"), F.coalesce(F.concat("lang", F.lit("/")), F.lit("")), F.col("doc_id"), F.lit(".txt"))
    more = t("region").select(F.concat(F.array(*map(F.lit, ("Models", "views", "controllers", "views", "docs")))[F.col("r_regionkey")], F.lit("/f.ts")).alias("path"))
    return patterns.organisation(t("documents").where("source IS NOT NULL").select(path.alias("path")).unionByName(more))


# structure

SEGMENTS = "SELECT c_nationkey AS k, c_mktsegment AS s, count(*) AS n FROM customer GROUP BY ALL"


@query(f"""WITH g AS ({SEGMENTS}), z AS (SELECT k, sum(n)::BIGINT AS z FROM g GROUP BY k), p AS (SELECT a.k AS a, b.k AS b, a.z AS za, b.z AS zb FROM z a JOIN z b ON a.k < b.k),
    d AS (SELECT p.a, p.b, sum(abs(coalesce(x.n, 0) - coalesce(y.n, 0))) AS off FROM p, (SELECT DISTINCT s FROM g) q LEFT JOIN g x ON x.k = p.a AND x.s = q.s LEFT JOIN g y ON y.k = p.b AND y.s = q.s GROUP BY ALL),
    m AS (SELECT p.*, off, (x.n_regionkey = y.n_regionkey)::INT + (p.a % 2 = p.b % 2)::INT AS equal FROM p JOIN d USING (a, b) JOIN nation x ON x.n_nationkey = p.a JOIN nation y ON y.n_nationkey = p.b)
    SELECT a, b, round(0.4 * (0.4 + 0.6 * equal / 2) + 0.4 * (0.5 * (1 - abs(za - zb) / greatest(za, zb)) + 0.5 * (1 - off / (2 * greatest(za, zb)))) + 0.2 * (1 - abs(za - zb) / greatest(za, zb)), 6) AS sim FROM m""")
def structural_pairs(t):
    children = t("customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    children = children.groupBy("c_nationkey").agg(F.map_from_entries(F.collect_list(F.struct("c_mktsegment", "n"))).alias("children"), F.sum("n").alias("size"))
    metadata = F.create_map(F.lit("region"), F.col("n_regionkey").cast("string"), F.lit("parity"), (F.col("n_nationkey") % 2).cast("string"))
    rows = children.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.lit("nation").alias("kind"), F.col("c_nationkey").alias("k"), F.struct(metadata.alias("metadata"), "children", "size").alias("s"))
    return clustering.blocked_pairs(rows, ["kind"], "k", "s", clustering.structural_similarity, 0.0)


@query("SELECT type, count(*) AS clusters, round(avg(size), 6) AS mean_size FROM (SELECT p_type AS type, p_brand, count(*) AS size FROM part GROUP BY ALL) GROUP BY type")
def clusters_by_type(t):
    return clustering.by_type(t("part").groupBy(F.col("p_type").alias("type"), "p_brand").agg(F.count("*").alias("size")))


@query(f"""WITH v AS (SELECT *, k % 97 AS line, brand || '/' || k % 40 AS dir, type || k % 30 AS unit FROM ({VARIANTS})), w AS (SELECT DISTINCT k, line, dir, unit, term FROM (SELECT *, unnest({WORDS}) AS term FROM v) WHERE length(term) >= 3),
    r AS (SELECT term FROM w GROUP BY term HAVING count(*) >= 2 AND count(*) <= 0.2 * (SELECT count(*) FROM v)), o AS (SELECT w.* FROM w SEMI JOIN r USING (term)),
    e AS (SELECT DISTINCT l_partkey AS x, l_suppkey AS y FROM lineitem),
    p AS (SELECT a.k AS a, a.line AS la, b.k AS b, b.line AS lb FROM o a JOIN o b ON a.term = b.term AND a.dir = b.dir AND a.k <> b.k UNION SELECT a.k, a.line, b.k, b.line FROM o a JOIN o b ON a.term = b.term AND a.unit = b.unit AND a.k <> b.k
        UNION SELECT a.k, a.line, b.k, b.line FROM e JOIN o a ON a.k = x JOIN o b ON b.k = y AND b.term = a.term WHERE x <> y UNION SELECT b.k, b.line, a.k, a.line FROM e JOIN o a ON a.k = x JOIN o b ON b.k = y AND b.term = a.term WHERE x <> y)
    SELECT DISTINCT a AS source_id, b AS target_id, 0.65::DOUBLE AS confidence FROM p WHERE (la, a) < (lb, b)""")
def name_pattern_flows(t):
    own = variants(t).select("k", "n", "brand", "type", (F.col("k") % 97).alias("start_line"))
    nodes = own.select(F.col("k").alias("id"), F.col("n").alias("name"), "start_line", F.concat("brand", F.lit("/"), F.col("k") % 40, F.lit("/f")).alias("path"))
    units = own.select(F.col("k").alias("id"), F.concat("type", F.col("k") % 30).alias("unit"))
    edges = t("lineitem").select(F.col("l_partkey").alias("source_id"), F.col("l_suppkey").alias("target_id"))
    return dataflow.name_pattern_flows(nodes, 0.2, edges, units).select("source_id", "target_id", "confidence")


# answers


def answers(t):
    """A text per nation: one third JSON, the others sections, with headings of guidance."""
    name, region, key = F.col("n_name"), F.col("n_regionkey").cast("string"), F.col("n_nationkey")
    fenced = F.concat(F.lit('See:\n```json\n{"relationships": [{"source": "'), name, F.lit('", "target": "'), region, F.lit('"}, {"source": "lost"}]}\n```\n'))
    section = F.concat(F.lit("### Relationship: one\nSource: "), name, F.lit("\nTarget: "), region, F.lit("\nType: lies in\nDescription: of "), name, F.lit("\n\n### Relationship: none\nSource: "), name, F.lit("\nTarget:\n\n"))
    rest = F.concat(F.lit("## Files to modify\n- `src/"), F.lower(name), F.lit(".ts`: the map\n- nothing\n## New files\n1. lib/n"), key, F.lit(".py\n## Steps\n1. Add "), name, F.lit("\n2. look at it\n# End\n- Fix nothing\n"))
    return t("nation").select("n_nationkey", F.concat(F.when(key % 3 == 0, fenced).otherwise(section), rest).alias("answer"))


@query("SELECT n_nationkey, n_name AS source, n_regionkey::VARCHAR AS target, CASE WHEN n_nationkey % 3 = 0 THEN 'Undefined' ELSE 'lies in' END AS type, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE 'of ' || n_name END AS description FROM nation")
def answer_relationships(t):
    return responses.relationships(answers(t), "n_nationkey", "answer")


@query("""SELECT n_nationkey, 'modify' AS part, 0 AS place, 'src/' || lower(n_name) || '.ts' AS item FROM nation WHERE NOT contains(n_name, ' ') UNION ALL SELECT n_nationkey, 'modify', 0, split_part(lower(n_name), ' ', -1) || '.ts' FROM nation WHERE contains(n_name, ' ')
    UNION ALL SELECT n_nationkey, 'create', 0, 'lib/n' || n_nationkey || '.py' FROM nation UNION ALL SELECT n_nationkey, 'steps', 0, 'Add ' || n_name FROM nation UNION ALL SELECT n_nationkey, 'steps', 1, 'look at it' FROM nation""")
def answer_guidance(t):
    return responses.guidance(answers(t), "n_nationkey", "answer")


@query("SELECT n_nationkey, x.place, CASE WHEN x.place = 3 THEN 'Add ' || n_name ELSE 'Fix nothing' END AS recommendation FROM nation, (VALUES (3), (5)) x(place)")
def answer_advice(t):
    return responses.advice(responses.recommendations(answers(t), "n_nationkey", "answer"))
