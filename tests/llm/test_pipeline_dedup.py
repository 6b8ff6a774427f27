"""The pipeline's deduplicating stages on the smallest tables, by brute force."""

from test_corpus_operators import jaccard_components

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_dedup_stages(spark):
    docs = corpus_pipeline.table(spark, SF, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    last = {}
    for i, text in rows:
        last[text] = max(i, last.get(text, i))
    exact = corpus_pipeline.stash(corpus_pipeline.drop_exact_copies(spark, docs, SF), "test-exact")
    assert sorted(r["doc_id"] for r in exact.select("doc_id").collect()) == sorted(last.values())
    near = corpus_pipeline.drop_near_copies(spark, docs, SF)
    want = {c for _, c in jaccard_components(rows, 5, 80).values()}
    assert sorted(r["doc_id"] for r in near.select("doc_id").collect()) == sorted(want)
    assert len(last) < len(rows) and len(want) < len(rows)
