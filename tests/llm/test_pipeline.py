import corpus_pipeline as C


def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = docs
    for name, stage in C.STAGES[:-1]:
        after = stage(spark, before, "/root/testdata/sf0.001").cache()
        assert after.columns == docs.columns, name
        assert after.count() <= before.count()
        before = after
    assert before.count() >= 0.85 * docs.count()
    pieces = C.STAGES[-1][1](spark, before, "/root/testdata/sf0.001")
    assert pieces.select("doc_id").distinct().count() == before.count()


def test_empty_table(spark, no_docs):
    docs = no_docs
    for _, stage in C.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0
