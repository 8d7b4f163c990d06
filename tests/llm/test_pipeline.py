"""The pipeline's stages do what their operators decide, each on what the one before kept."""

import corpus_pipeline
from ferrymass.llm import decontam, exact_dedup, ngram_join, quality

SF = "/root/testdata/sf0.001"


def _ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    decides = [
        lambda d: _ids(quality.classify(d, labels).filter("predicted = 1")),
        lambda d: _ids(exact_dedup.exact_dedup(d).filter("kept")),
        lambda d: _ids(ngram_join.near_copies(d).filter("doc_id = component_id")),
        lambda d: sorted(set(_ids(d)) - set(_ids(decontam.contaminated(d, bench)))),
    ]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "byte-level BPE"]
    for (_, stage), decide in zip(corpus_pipeline.STAGES[:-1], decides, strict=True):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert _ids(out) == decide(docs)
        docs = out.cache()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert _ids(last) == _ids(docs)


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_run_leaves_its_result_alone(spark):
    """The tables between the stages are gone, and what run returns can still be read."""
    from ferrymass import checkpoints

    other, before = checkpoints.persist(spark.range(3), "other"), checkpoints.written()
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0
    assert checkpoints.written() == before + 1 and other.count() == 3
