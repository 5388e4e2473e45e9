import corpus_pipeline

from stratalens.llm import pii

from .test_dedup import brute_components, brute_exact, brute_fingerprint

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "simhash", "pii", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        before = [(r.doc_id, r.text) for r in docs.collect()]
        if name != "packing":
            assert out.schema == docs.schema
            after = {r.doc_id: r.text for r in out.collect()}
        if name == "toxicity":
            assert 0.7 * len(before) < len(after) <= len(before)
        if name == "exact_dedup":
            assert set(after) == {w[0] for w in brute_exact(before) if w[3]}
        if name == "simhash":
            ids = [i for i, _ in before]
            assert set(after) == {i for i, c in zip(ids, brute_components(ids, [brute_fingerprint(t) for _, t in before]), strict=True) if i == c}
        if name == "pii":
            assert after == {i: pii.masked(t) for i, t in before}
            assert not [t for t in after.values() if pii.spans(t)[1]]
        if name == "packing":
            assert {r.doc_id for r in out.collect()} == {i for i, _ in before}
        docs = out
    assert corpus_pipeline.run(spark, SF).count() == docs.count()
