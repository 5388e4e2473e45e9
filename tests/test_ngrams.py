"""Terms counted in chunks of texts against the SQL, with ids that come again."""

import duckdb
import pyarrow as pa
import pytest

from stratalens.functions import ngrams
from stratalens.plans import catalogue

TEXTS = ["The cat_1 sat; the cat_1 sat", "sat", "", None, "  ", "Ä the ÖL the é", "a b a b a b", "Çx K1 the", "the cat_1 sat on", "x" * 50 + " a"]


@pytest.fixture
def folder(spark, request, tmp_path):
    key, again = request.param
    rows = [(None if i % 17 == 0 else i // 2 if again and i % 3 else i + 1000, TEXTS[i % 10]) for i in range(200)]
    name = {"doc_id": "documents", "conv_id": "conversations"}[key]
    spark.createDataFrame(rows, f"{key} long, text string").coalesce(2).write.parquet(str(tmp_path / f"{name}.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    return str(tmp_path), con


def agree(spark, folder, query):
    path, con = folder
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        df = catalogue.QUERIES[query](spark, path)
        got = sorted(tuple(r) for r in df.select("term", "occurrences", "documents").collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted(con.sql(f"SELECT term, occurrences::BIGINT, documents FROM ({catalogue.ORACLES[query]})").fetchall()) and len(got) > 1
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("folder", [("doc_id", False), ("doc_id", True)], indirect=True)
def test_bigrams(spark, folder):
    assert "Generate explode" not in agree(spark, folder, "bigrams")


@pytest.mark.parametrize("folder", [("doc_id", False), ("doc_id", True)], indirect=True)
def test_key_terms(spark, folder):
    assert "Generate explode" not in agree(spark, folder, "key_terms")


@pytest.mark.parametrize("folder", [("conv_id", False), ("conv_id", True)], indirect=True)
def test_trigrams(spark, folder):
    agree(spark, folder, "trigrams")


def test_chunks_hold_every_text(monkeypatch):
    monkeypatch.setattr(ngrams, "CHUNK_BYTES", 5)
    batch = pa.RecordBatch.from_pydict({"id": [1, 2, 3, 4], "text": ["a b c d e f", "", "a b", "ab"], "again": [False] * 4})
    parts = list(ngrams.chunks(batch))
    assert pa.Table.from_batches(parts)["id"].to_pylist() == [1, 2, 3, 4] and len(parts) > 1
    words, row = ngrams.split(batch["text"].slice(1))
    assert words.to_pylist() == ["a", "b", "ab"] and row.tolist() == [1, 1, 2]
