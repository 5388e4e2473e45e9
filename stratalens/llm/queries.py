"""The opN queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ann, bpe, exact_dedup, licenses, packing, pii, quality, runs, sharding, shared, simhash, toxicity, warc


def vocabulary(name: str) -> str:
    """Path of a vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = shared.work_path(spark, "archives")
    warc.write(pages, path)
    read = warc.read(spark, path, pages.schema["page_id"].dataType.simpleString(), payloads=False)
    invalid = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("invalid record: "), "error")).cast("string"))  # ours must all be valid
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", invalid.alias("error"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ann.build(table(spark, sf_dir, "embeddings"))
    return ann.search(index, index.rows.where("vec_id % 20 = 0"))


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text; where h = crc32 of the id ends in 0, the words from a = h // 10 % n on repeat those p from a on, p = 1 + (n - a) // (3 + h // 10 % 8).  A null id plants nothing."""
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, F.floor(h / 10)).alias("g"))
    rows = rows.withColumn("words", F.when(F.col("g").isNotNull(), F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")))
    rows = rows.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.expr("int(g % n)")))
    rows = rows.withColumn("p", F.expr("1 + int(floor((n - a) / (3 + g % 8)))"))
    text = F.expr("array_join(slice(concat(slice(words, 1, a), flatten(array_repeat(slice(words, a + 1, p), int(ceil((n - a) / p))))), 1, n), ' ')")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find(planted(table(spark, sf_dir, "documents")))
    top = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    said = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), F.sha2(said, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length = -F.col("top.less")
    return rows.select("doc_id", "n_runs", F.col("top.start").alias("start"), length.alias("length"), F.col("top.period").alias("period"), F.floor(1000 * length / F.col("top.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    base, own = F.col("places.label"), F.col("spans.label")
    listed = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places.word").alias("first_word"), F.array_max("places.word").alias("last_word"),
        listed(base).alias("base_labels"), listed(F.concat(base, own)).alias("labels"), "score",
    )


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_warc": op2_warc,
    "op3_pii": op3_pii,
    "op4_simhash": op4_simhash,
    "op5_packing": op5_packing,
    "op6_sharding": op6_sharding,
    "op7_toxicity": op7_toxicity,
    "op8_bpe": op8_bpe,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_ann": op10_ann,
    "op11_runs": op11_runs,
    "op12_licenses": op12_licenses,
    "op13_alignment": op13_alignment,
}

ORACLES = {
    "op2_warc": """
        WITH t AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        g AS (SELECT html, min(page_id) AS head FROM t WHERE strlen(html) >= 100 GROUP BY html)
        SELECT page_id, strlen(t.html) AS payload_bytes, sha256(t.html) AS payload_digest,
               CASE WHEN head <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN head <> page_id THEN head END AS refers_to, CAST(NULL AS VARCHAR) AS error
        FROM t LEFT JOIN g ON t.html = g.html""",
    "op9_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
        g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
        FROM t JOIN g ON t.norm = g.norm""",
}
