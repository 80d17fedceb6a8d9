"""Rows that share a doc_id but not a text belong each to its own group."""

import corpus_pipeline


def test_one_doc_id_with_several_texts(spark):
    words = lambda a: " ".join(f"{a}{i}" for i in range(40))
    rows = [(5, words("a")), (5, words("b")), (5, words("b")), (6, words("b")), (7, words("c")), (7, words("a") + " more"), (8, None), (8, None), (None, words("a"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in corpus_pipeline.near_duplicate_groups(spark, docs, "").collect()]
    want = [(5, words("a")), (5, words("b")), (7, words("c")), (8, None), (None, words("a"))]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
