"""Samples round as in the SQL, small negative ones to -0.0."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from evalspark.functions.expressions import round_scaled
from evalspark.queries import sources


def told(rows):
    """Text of doubles, in which -0.0 isn't 0.0."""
    return sorted((tuple(map(repr, r)) for r in rows))


def test_read_waveforms(spark, tmp_path):
    rng = np.random.default_rng(4)
    vectors = rng.normal(0, 0.125, (120, 64)).astype("float32")
    vectors[:, :6] = [-8.903178e-08, -0.0, 3 / 128, -3 / 128, -5e-07, 4.9e-07]
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    df = sources.s5_read_waveforms(spark, str(tmp_path))
    rel = con.sql(sources.ORACLE_SQL["s5_read_waveforms"])
    at = [rel.columns.index(c) for c in df.columns]
    got = told(df.collect())
    assert got == told(tuple(r[i] for i in at) for r in rel.fetchall())
    assert sum(r[-1] == "-0.0" for r in got) >= 2 * 12 * 5


def test_halves_and_odd_numbers(spark):
    values = [0.285, -0.285, 0.145, 0.575, 1.005, 48.3 / 60, -0.0, 0.0, -0.004, 1e300, float("inf"), float("-inf"), float("nan"), None, 0.0049999999999999994]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double")
    got = df.select("k", round_scaled(F.col("v"), 2)).collect()
    want = [duckdb.sql(f"SELECT {k}, round({'NULL' if v is None else repr(repr(v))}::DOUBLE, 2)").fetchall()[0] for k, v in enumerate(values)]
    assert told(got) == told(want)
