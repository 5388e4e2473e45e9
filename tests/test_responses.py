from pyspark.sql import functions as F

from stratalens.operators import responses

ANSWERS = [
    (1, 'Here:\n```json\n[{"name": "A", "type": "t", "confidence": 0.9}, {"name": "B"}]\n```'),
    (2, '{"patterns": [{"name": "C", "confidence": 0.7}]}'),
    (3, 'so {"name": "D"} then'),
    (4, "**Pattern 1: Singleton**\ntext\nPattern 2: Factory"),
    (5, "nothing of use [broken"),
    (6, None),
]


def test_patterns(spark):
    df = spark.createDataFrame(ANSWERS, "id long, answer string")
    got = sorted((r.id, r.name, r.confidence) for r in responses.patterns(df, "id", "answer").collect())
    assert [g[:2] for g in got] == [(1, "A"), (1, "B"), (2, "C"), (3, "D"), (4, "Factory"), (4, "Singleton")]


def test_files_prompt_and_recommendations(spark):
    df = spark.createDataFrame([(1, "FILE: [a/b.ts]\nFile: c.py\nFILE: a/b.ts\n1. do x\n- do y", None)], "id long, answer string, context string")
    row = df.select(responses.files(F.col("answer")).alias("f"), responses.prompt(F.lit("why?"), F.lit("bug"), F.col("context")).alias("p")).first()
    assert row.f == ["a/b.ts", "c.py"] and row.p.endswith(responses.NO_CONTEXT)
    assert [r.recommendation for r in responses.recommendations(df, "id", "answer").orderBy("place").collect()] == ["do x", "do y"]
