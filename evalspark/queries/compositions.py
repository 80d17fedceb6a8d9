"""Composed operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.operators import compositions as c
from evalspark.operators import joins as j
from evalspark.operators import waves as w
from evalspark.plans.fixtures import fixture, with_fixtures
from evalspark.queries.metrics import rounded
from evalspark.queries.series import _cases


def m14_source_calibration(spark, d):
    return rounded(c.source_calibration(fixture(spark, d, "pred").where("seed = 2026"), "salt", 0.8, 0.1), 4)


def q18_candidate_gate(spark, d):
    wave = fixture(spark, d, "wave")
    cand = w.corrupt(wave, _cases(spark).where("kind = 'clip'"))
    quality = w.record_quality(w.lead_time_metrics(wave), (("clip_fraction", 0.08, 0.20),))
    return c.candidate_gate(wave, cand, quality, 0.05, 0.25)


def a32_explanation_summary(spark, d):
    n = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: i / 63.0)
    curves = fixture(spark, d, "wave").select(F.when(F.col("lead_idx") % 2 == 0, "guided").otherwise("random").alias("method"), (F.col("record_id") % 3).alias("label"), n.alias("fractions"), w.doubles(F.col("samples")).alias("values"))
    return rounded(c.explanation_summary(curves))


def x1_udtf_explode_wave(spark, d):
    spark.udtf.register("ev_explode_wave", c.ExplodeWave)
    fixture(spark, d, "wave").createOrReplaceTempView("ev_wave")
    return spark.sql("SELECT record_id, lead_idx, x.i, x.t, round(x.value, 6) AS value FROM ev_wave, LATERAL ev_explode_wave(samples, fs) x")


def c4_mapping_status(spark, d):
    k = F.col("record_id")
    return fixture(spark, d, "manifest").select("record_id", j.mapping_status((k % 3).cast("int"), (k % 2).cast("int")).alias("status"))


QUERIES = {f.__name__: f for f in (m14_source_calibration, q18_candidate_gate, a32_explanation_summary, x1_udtf_explode_wave, c4_mapping_status)}

ORACLE_SQL = {
    "a32_explanation_summary": with_fixtures(["wave"], "WITH a AS (SELECT CASE WHEN lead_idx % 2 = 0 THEN 'guided' ELSE 'random' END AS method, record_id % 3 AS label, list_sum(list_transform(range(1, len(samples)), lambda i: (CAST(samples[i] AS DOUBLE) + CAST(samples[i + 1] AS DOUBLE)) / 2 / 63.0)) AS area FROM wave), g AS (SELECT method, label, count(*) AS n, avg(area) AS area FROM a GROUP BY ALL) SELECT g.method, g.label, g.n, round(g.area, 6) AS area, round(g.area - b.area, 6) AS advantage FROM g JOIN g b ON g.label = b.label AND b.method = 'random'"),
    "x1_udtf_explode_wave": with_fixtures(["wave"], "SELECT record_id, lead_idx, CAST(i - 1 AS INTEGER) AS i, (i - 1) / 100.0 AS t, round(CAST(samples[i] AS DOUBLE), 6) AS value FROM wave, range(1, 65) r(i)"),
    "c4_mapping_status": with_fixtures(["manifest"], "SELECT record_id, CASE WHEN record_id % 3 > 0 AND record_id % 2 > 0 THEN 'mapped_with_ambiguous' WHEN record_id % 3 > 0 THEN 'mapped' WHEN record_id % 2 > 0 THEN 'ambiguous_only' ELSE 'unmapped' END AS status FROM manifest"),
}
