from llm_rows import labels, no_docs, no_labels, odd_docs, odd_rows, table  # noqa: F401

import __spark_entry__ as entry
import corpus_pipeline

SF = "/root/testdata/sf0.01"


def test_every_operator_has_a_query():
    names = entry.queries()
    for n in range(1, 11):
        assert [q for q in names if q.startswith(f"op{n}_")], n
    assert "pipeline" in names
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "quality", "near_duplicates", "mixing", "packing"]


def test_stages_take_effect(spark):
    docs = table(spark, "documents", "0.01")
    schema, labels = docs.schema, table(spark, "labels", "0.01")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.schema.simpleString() == schema.simpleString(), name
        now = docs.count()
        if name != "mixing":
            assert now < before, name
        if name == "toxicity":
            assert docs.join(labels.where("toxic = 0"), "doc_id").count() > 0.97 * labels.where("toxic = 0").count()
        if name == "quality":
            assert docs.join(labels.where("quality = 0"), "doc_id").count() == 0
        if name == "near_duplicates":
            assert docs.select("doc_id").distinct().count() == now
        before = now
    assert docs.groupBy("doc_id").count().agg({"count": "max"}).first()[0] in (2, 3)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert (packed.piece == 0).sum() == before
    assert packed.groupby("sequence_id").length.sum().max() <= 2048


def test_stages_on_rows_nobody_likes(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "/root/testdata/sf0.001")
            assert out.schema == docs.schema
            assert out.count() >= 0
        corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").count()


def test_pipeline_runs(spark):
    assert entry.queries()["pipeline"](spark, "/root/testdata/sf0.001").count() > 0
