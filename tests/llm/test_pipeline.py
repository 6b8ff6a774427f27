"""Every stage of the pipeline on the smallest tables, against what it was given."""

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = corpus_pipeline.table(spark, SF, "documents")
    columns, before = docs.columns, docs.count()
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.stash(stage(spark, docs, SF), f"test-{name}")
        if name == "exact_dedup":
            assert out.count() == docs.select("text").distinct().count()
        if name in ("quality", "near_dedup"):
            assert out.join(docs, "doc_id", "left_anti").isEmpty() and 0.5 * docs.count() < out.count() <= docs.count()
        if name == "mix":
            assert out.groupBy("doc_id").count().filter("count > 3").isEmpty()
        if name != "pack":
            assert out.columns == columns
        else:
            assert out.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
        seen.append(out.count())
        docs = out
    assert seen[0] <= before
