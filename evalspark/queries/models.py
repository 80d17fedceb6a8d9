"""Fit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.operators import fits as f
from evalspark.operators import scaling as sc
from evalspark.operators import selective as s
from evalspark.plans.fixtures import fixture, with_fixtures
from evalspark.plans.scratch import table
from evalspark.queries.metrics import rounded


def _one(spark, d):
    return fixture(spark, d, "pred").where("seed = 2026")


def m2_fit_temperature(spark, d):
    return rounded(f.fit_temperature(_one(spark, d).where("fold = 8"), ["model_id"]), 4)


def m3_fit_sigmoid_scaling(spark, d):
    return rounded(f.fit_sigmoid_scaling(_one(spark, d).where("fold = 8"), ["label"]), 4)


def a12_weak_calibration(spark, d):
    return rounded(f.weak_calibration(_one(spark, d).where("fold = 10"), ["label"]), 4)


def a10_brier_decomposition(spark, d):
    return rounded(f.brier_decomposition(_one(spark, d), ["model_id", "label"]))


def m9_label_shift(spark, d):
    rows = _one(spark, d).where("fold = 10").withColumn("prior", F.lit(0.2))
    return rounded(f.estimate_label_shift(rows, ["label"], "prior", rounds=20), 4)


def m11_m12_mahalanobis(spark, d):
    emb = table(spark, d, "embeddings").where("embedding IS NOT NULL")
    mean, precision = f.fit_mahalanobis(emb.where("vec_id % 5 < 3"), "embedding")
    scored = f.score_mahalanobis(emb, "embedding", mean, precision)
    calibration = scored.where("vec_id % 5 = 3").select(F.lit("all").alias("k"), "vec_id", F.round("distance", 6).alias("distance"))
    cut = s.kth_smallest(calibration, ["k"], "distance", F.ceil(F.round((F.col("n") + 1) * 0.95, 9)))
    return scored.where("vec_id % 5 = 4").join(F.broadcast(cut.select("cutoff")), F.lit(True)).select("vec_id", F.round("distance", 4).alias("distance"), (F.round("distance", 6) > F.col("cutoff")).alias("is_ood"))


#: Factors on the logits of every model that give it slopes inside and beyond both bounds.
FACTORS = {"own": 1.0, "sharp": 4.0, "sharper": 8.0}
BOUNDS = (0.5, 2.0)


def m3_bounded_sigmoid(spark, d):
    kinds = spark.createDataFrame(list(FACTORS.items()), "kind string, factor double")
    rows = fixture(spark, d, "pred").where("fold = 8").join(F.broadcast(kinds), F.lit(True)).withColumn("logit", F.col("logit") * F.col("factor"))
    fit = sc.fit_bounded_sigmoid(rows, ["model_id", "kind", "label"], 1e-3, BOUNDS)
    return rounded(fit.select("model_id", "kind", "label", "slope", "intercept", "status", "active_bound", "converged", "nll_before", "nll_after"), 5)


QUERIES = {q.__name__: q for q in (m3_bounded_sigmoid, m2_fit_temperature, m3_fit_sigmoid_scaling, a12_weak_calibration, a10_brier_decomposition, m9_label_shift, m11_m12_mahalanobis)}

_NEWTON = f"""h AS (SELECT model_id, kind, label, logit * factor AS x, CAST(count(*) AS DOUBLE) AS n, CAST(sum(target) AS DOUBLE) AS y FROM pred, (VALUES {", ".join(f"('{k}', {float(v)})" for k, v in FACTORS.items())}) f(kind, factor) WHERE fold = 8 GROUP BY ALL),
it AS (SELECT DISTINCT model_id, kind, label, CAST(1 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b, 0 AS i FROM h UNION ALL
  SELECT model_id, kind, label, CASE WHEN stuck THEN a ELSE greatest(least(a - greatest(least((hbb * ga - hab * gb) / (haa * hbb - hab * hab), 0.2), -0.2), {BOUNDS[1]}), {BOUNDS[0]}) END, b - greatest(least(CASE WHEN stuck THEN gb / hbb ELSE (haa * gb - hab * ga) / (haa * hbb - hab * hab) END, 0.2), -0.2), i + 1 FROM (
    SELECT *, (a <= {BOUNDS[0]} AND ga >= 0) OR (a >= {BOUNDS[1]} AND ga <= 0) AS stuck FROM (
      SELECT model_id, kind, label, a, b, i, sum((n * p - y) * x) / sum(n) + 0.002 * (a - 1) AS ga, sum(n * p - y) / sum(n) + 0.002 * b AS gb, sum(n * p * (1 - p) * x * x) / sum(n) + 0.002 AS haa, sum(n * p * (1 - p) * x) / sum(n) AS hab, sum(n * p * (1 - p)) / sum(n) + 0.002 AS hbb
      FROM (SELECT it.*, x, n, y, 1 / (1 + exp(-(a * x + b))) AS p FROM it JOIN h USING (model_id, kind, label) WHERE i < 120) GROUP BY model_id, kind, label, a, b, i))),
nl AS (SELECT model_id, kind, label, a, b, sum(y * ln(1 + exp(-(a * x + b))) + (n - y) * ln(1 + exp(a * x + b))) / sum(n) AS after, sum(y * ln(1 + exp(-x)) + (n - y) * ln(1 + exp(x))) / sum(n) AS before, sum(y) AS pos, sum(n - y) AS neg FROM it JOIN h USING (model_id, kind, label) WHERE i = 120 GROUP BY ALL),
st AS (SELECT *, pos > 0 AND neg > 0 AS two, pos > 0 AND neg > 0 AND after + 0.001 * ((a - 1) ** 2 + b * b) < before - 1e-12 AS better FROM nl)"""

ORACLE_SQL = {
    "m3_bounded_sigmoid": "WITH RECURSIVE" + with_fixtures(["pred"], f"""WITH {_NEWTON} SELECT model_id, kind, label, CASE WHEN better THEN round(a, 5) ELSE 1.0 END AS slope, CASE WHEN better THEN round(b, 5) ELSE 0.0 END AS intercept, CASE WHEN NOT two THEN 'one_class' WHEN better THEN 'optimized' ELSE 'identity_optimal' END AS status,
CASE WHEN better AND a <= {BOUNDS[0]} THEN 'lower' WHEN better AND a >= {BOUNDS[1]} THEN 'upper' END AS active_bound, CASE WHEN two THEN true END AS converged, CASE WHEN two THEN round(before, 5) END AS nll_before, CASE WHEN better THEN round(after, 5) WHEN two THEN round(before, 5) END AS nll_after FROM st""").removeprefix("WITH"),
    "a10_brier_decomposition": "WITH RECURSIVE" + with_fixtures(["pred"], """WITH h AS (SELECT model_id, label, prob, count(*) AS n, sum(target) AS y FROM pred WHERE seed = 2026 GROUP BY ALL),
c AS (SELECT *, sum(n) OVER o AS seen, row_number() OVER o AS d, sum(n) OVER g AS t, count(*) OVER g - 1 AS m FROM h WINDOW g AS (PARTITION BY model_id, label), o AS (PARTITION BY model_id, label ORDER BY prob)),
k AS (SELECT DISTINCT model_id, label, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS cut FROM h UNION ALL
  SELECT k.model_id, k.label, k.i + 1, min({'away': abs(c.seen - (k.i + 1) * c.t / 10.0), 'd': c.d}).d FROM k JOIN c ON c.model_id = k.model_id AND c.label = k.label AND c.d > k.cut AND c.d <= c.m - (9 - (k.i + 1)) WHERE k.i < 9 GROUP BY k.model_id, k.label, k.i),
b AS (SELECT c.model_id, c.label, (SELECT count(*) FROM k WHERE k.model_id = c.model_id AND k.label = c.label AND k.i > 0 AND k.cut < c.d) AS bin, n, y, prob FROM c),
e AS (SELECT model_id, label, bin, sum(n) AS m, sum(prob * n) AS sp, sum(y) AS sy, sum(prob * prob * n) AS spp, sum(prob * y) AS spy FROM b GROUP BY ALL), g AS (SELECT *, sum(sy) OVER w / sum(m) OVER w AS base, sp / m AS mp, sy / m AS my FROM e WINDOW w AS (PARTITION BY model_id, label))
SELECT model_id, label, count(*) AS bins, round(sum(m * (mp - my) ** 2) / sum(m), 6) AS reliability, round(sum(m * (my - base) ** 2) / sum(m), 6) AS resolution, round(max(base * (1 - base)), 6) AS uncertainty, round(sum(spp - m * mp * mp) / sum(m), 6) AS within_variance, round(sum(spy - m * mp * my) / sum(m), 6) AS within_covariance,
(SELECT round(avg((p.prob - p.target) ** 2), 6) FROM pred p WHERE p.seed = 2026 AND p.label = g.label) AS brier FROM g GROUP BY model_id, label""").removeprefix("WITH"),
}
