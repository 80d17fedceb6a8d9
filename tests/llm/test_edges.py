"""Clashing columns, empty tables, repeated rows and very long values for operators and pipeline stages."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evalspark.llm import archive, licences, rule_ensemble, topk, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, s string, doc string, score string, ids string, rule string, chain string, label string, text_hash string, first_id string, c_lang string, probability string, bucket string, place string"
N_EXTRA = 13


def _docs(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or ""), *["x"] * N_EXTRA) for r in rows], DOCS)


CLEAN = "The river runs to the sea and all of the people in it see that the day is long for us at this place. " * 12


@pytest.fixture(scope="module")
def rows():
    own = [(i, f"{CLEAN} Number {i} stands by itself with word{i} other{i} more{i} last{i} here{i}.", "en", f"src{i % 3}") for i in range(12)]
    return own + [own[0], (None, own[1][1], None, None), (20, None, "en", None), (21, "", "de", "src1"), (22, "word " * 120_000, "en", "src2"), (22, CLEAN * 300, "en", "src2")]


def test_stages_on_odd_tables(spark, rows):
    docs = _docs(spark, rows)
    labels = [(i, int(i != 22), 0) for i in range(30)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").createOrReplaceTempView("edge_labels")
    stages = {
        "classifier": lambda d: rule_ensemble.keep_predicted(d, spark.table("edge_labels")),
        "rules": lambda d: corpus_pipeline.quality_rules(spark, d, ""),
        "near": lambda d: corpus_pipeline.near_duplicate_groups(spark, d, ""),
        "mix": lambda d: corpus_pipeline.source_mix(spark, d, ""),
    }
    have = collections.Counter(tuple(r) for r in docs.collect())
    for name, stage in stages.items():
        got = stage(docs)
        assert got.columns == docs.columns, name
        kept = collections.Counter(tuple(r) for r in got.collect())
        assert all(n <= have[r] for r, n in kept.items()), name
        assert stage(docs.where("false")).collect() == [], name
    packed = corpus_pipeline.length_buckets(spark, docs, "").collect()
    assert len(packed) == len(rows) and max(r.n_tokens for r in packed) == 120_000


def test_scores_of_odd_texts(spark, rows):
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(12)] + [(20, 0)], "doc_id long, quality int")
    got = rule_ensemble.quality_scores(_docs(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert rule_ensemble.quality_scores(_docs(spark, []), labels).collect() == []


def test_licences_of_odd_tables(spark, rows):
    long_ = "Plain words stand here. " * 40_000 + "\nReleased under the MIT License.\n" + "and more of them " * 40_000
    got = licences.scan_licences(_docs(spark, [*rows, (50, long_, "en", "a"), (50, long_, "en", "a")])).collect()
    assert [(r.licence, r.n_known) for r in got if r.doc_id == 50] == [("MIT", 1)] * 2
    assert all(r.licence is None for r in got if r.doc_id != 50) and len(got) == len(rows) + 2
    assert licences.scan_licences(_docs(spark, [])).collect() == []


def test_urls_of_odd_tables(spark):
    schema = "page_id long, url string, html string, host string, path string, rule string, label string, s string, score string, g string"
    urls = [f"http://a{i}.example.net/en/{i}" for i in range(30)] + [f"http://b{i}.net/x/{i}" for i in range(30)]
    urls += ["http://c.info/" + "ab/" * 30_000, "http://c.info/q", "http://c.info/q", None, "", "x://"]
    df = spark.createDataFrame([(i, u, *["z"] * 8) for i, u in enumerate(urls)], schema)
    got = {r.page_id: r for r in url_filter.judge_urls(df).collect()}
    assert len(got) == len(urls) and len(got[60].path) == 1 + 90_000
    assert (got[61].verdict, got[61].score) == (got[62].verdict, got[62].score) and got[61].score is not None
    assert all(got[i].host == "" == got[i].path for i in (63, 64, 65))


def test_archive_of_odd_tables(spark):
    schema = "page_id long, url string, html string, digest string, payload string, header string, row string, first string, n string"
    long_ = "<p>é</p>" * 200_000
    rows = [(1, "u", long_), (2, "v", long_), (2, "v", long_), (None, "w", long_), (3, None, None), (4, "", "")]
    df = spark.createDataFrame([(*r, *["z"] * 6) for r in rows], schema)
    got = collections.Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in archive.archive_pages(df).collect())
    n = len(long_.encode())
    assert got == collections.Counter([(1, n, "response", None), (2, n, "revisit", 1), (2, n, "revisit", 1), (None, n, "response", None), (3, 0, "response", None), (4, 0, "response", None)])


def test_topk_of_odd_tables(spark):
    schema = "vec_id long, embedding array<double>, id string, vec string, q string, shard string, kind string, floor string, rank string, score string"
    vectors = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (3, [2.0, 0.0]), (3, [2.0, 0.0]), (4, [float("nan"), 1.0]), (5, None), (None, [9.0, 9.0]), (6, [1.0]), (100, [])]
    df = spark.createDataFrame([(*v, *["z"] * 8) for v in vectors], schema)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search_embeddings(df).collect())
    one = 256 * 256
    assert got == [(0, 1, 3, 2 * one), (0, 2, 3, 2 * one), (0, 3, 50, one), (50, 1, 3, 2 * one), (50, 2, 3, 2 * one), (50, 3, 0, one)]
    assert df.select(F.count(F.lit(1))).first()[0] == len(vectors)
