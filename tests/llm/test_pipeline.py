import corpus_pipeline as pipeline
from factweave.llm import catalogue
from factweave.llm.common import written


def test_stages(spark, docs_folder):
    docs = spark.read.parquet(f"{docs_folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for i, (name, stage) in enumerate(pipeline.STAGES):
        before = docs
        docs = written(stage(spark, docs, docs_folder), name)
        kept[name] = docs.count()
        if i < len(pipeline.STAGES) - 1:
            assert docs.columns == columns
        if name == "jaccard_join":
            groups = catalogue.jaccard.join(before).select("component_id").distinct().count()
            assert kept[name] == groups
        if name == "personal_data":
            assert catalogue.pii.find(docs).where("n_email + n_ip + n_card + n_phone > 0").count() == 0
    assert kept["language_id"] >= 0.98 * 200 and kept["pack_sequences"] > 0
    total = docs.selectExpr("sum(length)").first()[0]
    assert docs.selectExpr("count(distinct sequence_id)").first()[0] <= total / 2048 * 1.02 + 1


def test_stages_of_odd_and_no_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in pipeline.STAGES:
            docs = written(stage(spark, docs, ""), name)
        assert "sequence_id" in docs.columns
    assert docs.count() == 0
