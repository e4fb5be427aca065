"""The pipeline's stages in their order, and what they keep."""

import corpus_pipeline
from landlens.llm import catalog


def test_stages_keep_columns_and_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "MinHash near-dedup", "best-fit packing"]
    left = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, left, sf_dir)
        assert after.columns == docs.columns
        after = corpus_pipeline.materialise(after, "test-stage")
        assert 0.5 * docs.count() < after.count() <= left.count()
        left = after
    packed = corpus_pipeline.pack_sequences(spark, left, sf_dir)
    assert packed.select("doc_id").distinct().count() == left.select("doc_id").distinct().count()


def test_queries_are_registered_once_each():
    assert [name.split("_")[0] for name in catalog.queries()] == [f"op{n}" for n in range(1, 14)]
