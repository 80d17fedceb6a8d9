"""The archive's query judges records as they come back."""

import hashlib

from pyspark.sql import functions as F

from evalspark.llm import archive


def test_query_reads_rebuilt_records(spark, monkeypatch):
    long_ = "é" * 80
    pages = spark.createDataFrame([(1, "u", long_), (2, "v", long_), (3, "w", "short"), (4, "x", None)], "page_id long, url string, html string")
    cols = lambda df: sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect())
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(1, 160, digest(long_), "response", None), (2, 160, digest(long_), "revisit", 1), (3, 5, digest("short"), "response", None), (4, 0, digest(""), "response", None)]
    assert [x[:4] for x in cols(archive.archive_pages(pages))] == [x[:4] for x in want]
    assert [x[4] for x in cols(archive.archive_pages(pages))] == [x[4] for x in want]
    # a record that comes back with other bytes must show
    read = archive.read_records
    monkeypatch.setattr(archive, "read_records", lambda a: read(a).withColumn("record", F.concat("header", F.lit(b"other"), F.lit(b"\r\n\r\n"))))
    assert [x[2] for x in cols(archive.archive_pages(pages))] == [digest("other"), digest(long_), digest("other"), digest("other")]
