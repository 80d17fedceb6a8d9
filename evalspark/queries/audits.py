"""Audits over one histogram of scores, exact bounds and gate plans, and problems of inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.operators import intervals as b
from evalspark.operators import metrics as m
from evalspark.plans.fixtures import fixture, with_fixtures
from evalspark.queries.metrics import rounded
from evalspark.sources import tables as s


def a19_probability_audit(spark, d):
    return rounded(m.probability_audit(fixture(spark, d, "pred"), ["model_id", "label"]))


def a20_subgroup_metrics(spark, d):
    pred = fixture(spark, d, "pred").withColumn("uncertainty", m.entropy(F.col("prob")))
    gates = pred.groupBy("model_id").agg(F.lit(0.8).alias("maximum_entropy"))
    return rounded(m.subgroup_audit(pred, fixture(spark, d, "subgroups"), ["model_id", "label"], gates, 30))


def a23_metric_deltas(spark, d):
    return rounded(m.metric_deltas(fixture(spark, d, "pred"), "model_id", "m2026", ["label"]))


def b5_exact_bound(spark, d):
    g = fixture(spark, d, "binary_events").groupBy("cohort").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("event").cast("long")).alias("k"))
    return rounded(g.select("cohort", "k", "n", b.exact_upper(F.col("k"), F.col("n")).alias("upper")))


def _plans(spark, d):
    """Designs are the sizes and rates that blocks of 40 clusters have; every second block has dependent events."""
    events = fixture(spark, d, "binary_events").withColumn("block", F.expr("cluster_id DIV 40"))
    designs = events.groupBy("cohort", "block").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("event").cast("double")).alias("rate"))
    designs = designs.withColumn("concentration", F.when(F.col("block") % 2 == 1, 25.0))
    return b.gate_plan(designs, ["cohort", "block"], 0.55, 0.8, method="wilson")


def b7_gate_plan(spark, d):
    return rounded(_plans(spark, d))


def b7_least_sample_size(spark, d):
    return b.least_sample_size(_plans(spark, d), ["cohort"])


def s1_manifest_problems(spark, d):
    man = fixture(spark, d, "manifest").select(F.when(F.col("record_id") % 50 != 0, F.expr("record_id DIV 2")).alias("record_id"), "fold", "site")
    return s.manifest_problems(man, ["record_id", "fold", "site", "age"], "record_id")


def s6_prediction_problems(spark, d):
    rows = fixture(spark, d, "pred").where("seed = 2026").where("record_id % 9 > 0 OR li < 5")
    wide = rows.groupBy("record_id").agg(F.collect_list("target").alias("targets"), F.collect_list("logit").alias("logits"))
    wide = wide.withColumn("logits", F.when(F.col("record_id") % 10 > 0, F.col("logits")))
    return s.prediction_problems(wide, ["1", "2", "3", "4", "5"])


_FUNCTIONS = (
    a19_probability_audit, a20_subgroup_metrics, a23_metric_deltas, b5_exact_bound, b7_gate_plan, b7_least_sample_size,
    s1_manifest_problems, s6_prediction_problems,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}


def metrics_sql(source: str, keys: str) -> str:
    """Common table expressions that end in ``mt``: A1 to A6 of the rows (prob, target) of ``source`` by ``keys``."""
    return f"""hh AS (SELECT {keys}, prob, CAST(count(*) AS DOUBLE) AS n, CAST(sum(target) AS DOUBLE) AS pos FROM {source} GROUP BY ALL),
rr AS (SELECT *, sum(n - pos) OVER w - (n - pos) / 2 AS before, sum(pos) OVER g - sum(pos) OVER w + pos AS up_pos, sum(n) OVER g - sum(n) OVER w + n AS up_n, least(greatest(prob, 1e-12), 1 - 1e-12) AS q, least(floor(prob * 15), 14) AS bin
  FROM hh WINDOW g AS (PARTITION BY {keys}), w AS (PARTITION BY {keys} ORDER BY prob)),
ee AS (SELECT {keys}, sum(abs(gap)) AS gap FROM (SELECT {keys}, bin, sum(pos - n * prob) AS gap FROM rr GROUP BY ALL) GROUP BY ALL),
mt AS (SELECT {keys}, CAST(sum(n) AS BIGINT) AS n, CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(n - pos) AS BIGINT) AS negatives, sum(pos) / sum(n) AS rate,
  CASE WHEN sum(pos) = 0 THEN 'no_positives' WHEN sum(pos) = sum(n) THEN 'no_negatives' END AS reason, CASE WHEN sum(pos) > 0 AND sum(n - pos) > 0 THEN sum(pos * before) / (sum(pos) * sum(n - pos)) END AS auroc,
  CASE WHEN sum(pos) > 0 THEN sum(pos * up_pos / up_n) / sum(pos) END AS average_precision, sum(pos * (1 - prob) * (1 - prob) + (n - pos) * prob * prob) / sum(n) AS brier, sum(-pos * ln(q) - (n - pos) * ln(1 - q)) / sum(n) AS log_loss, max(gap) / sum(n) AS ece
  FROM rr JOIN ee USING ({keys}) GROUP BY {keys})"""


_ALL = ", ".join(f"round({x}, 6) AS {x}" for x in m.METRICS)
_SIX = ", ".join(f"CASE WHEN n >= 30 THEN round({x}, 6) END AS {x}" for x in m.METRICS[1:])
_CHANCE = """exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + CASE WHEN concentration IS NULL THEN CASE WHEN k > 0 THEN k * ln(rate) ELSE 0 END + CASE WHEN n > k THEN (n - k) * ln(1 - rate) ELSE 0 END
  ELSE lgamma(k + rate * concentration) + lgamma(n - k + (1 - rate) * concentration) - lgamma(n + concentration) - lgamma(rate * concentration) - lgamma((1 - rate) * concentration) + lgamma(concentration) END)"""
_PLAN = f"""WITH g AS (SELECT cohort, cluster_id // 40 AS block, count(*) AS n, avg(CAST(event AS DOUBLE)) AS rate FROM binary_events GROUP BY ALL), dz AS (SELECT *, CASE WHEN block % 2 = 1 THEN 25.0 END AS concentration, 1.6448536269514722 AS z FROM g),
kk AS (SELECT *, unnest(range(n + 1)) AS k FROM dz), wl AS (SELECT *, (k / n + z * z / (2 * n) + z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n) <= 0.55 AS ok,
  CASE WHEN concentration IS NOT NULL AND (rate = 0 OR rate = 1) THEN CASE WHEN k = rate * n THEN 1.0 ELSE 0.0 END WHEN rate = 0 THEN CASE WHEN k = 0 THEN 1.0 ELSE 0.0 END WHEN rate = 1 THEN CASE WHEN k = n THEN 1.0 ELSE 0.0 END ELSE {_CHANCE} END AS chance FROM kk),
pl AS (SELECT cohort, block, n, rate, concentration, CAST(max(k) FILTER (WHERE ok) AS INTEGER) AS max_events, least(coalesce(sum(chance) FILTER (WHERE ok), 0), 1) AS pass_probability FROM wl GROUP BY ALL)"""

ORACLE_SQL = {
    "a19_probability_audit": with_fixtures(["pred"], f"WITH {metrics_sql('pred', 'model_id, label')} SELECT model_id, label, n, positives, negatives, reason, {_ALL} FROM mt UNION ALL BY NAME SELECT model_id, NULL AS label, CAST(sum(n) AS BIGINT) AS n, CAST(sum(positives) AS BIGINT) AS positives, CAST(sum(negatives) AS BIGINT) AS negatives, NULL AS reason, {', '.join(f'round(avg({x}), 6) AS {x}' for x in m.METRICS)} FROM mt GROUP BY model_id"),
    "a20_subgroup_metrics": with_fixtures(["pred", "subgroups"], f"""WITH j AS (SELECT p.*, attribute, coalesce(group_value, 'unknown') AS group_value, -(prob * ln(prob) + (1 - prob) * ln(1 - prob)) / ln(2) AS u FROM pred p JOIN subgroups USING (record_id)),
{metrics_sql('j', 'model_id, label, attribute, group_value')}, gt AS (SELECT model_id, label, attribute, group_value, avg(CASE WHEN u <= 0.8 THEN 1.0 ELSE 0.0 END) AS coverage, avg((prob - target) ** 2) FILTER (WHERE u <= 0.8) AS accepted_brier FROM j GROUP BY ALL)
SELECT model_id, label, attribute, group_value, n, positives, negatives, round(rate, 6) AS rate, CASE WHEN n < 30 THEN 'too_few' ELSE reason END AS reason, {_SIX}, round(coverage, 6) AS coverage, round(accepted_brier, 6) AS accepted_brier FROM mt JOIN gt USING (model_id, label, attribute, group_value)"""),
    "a23_metric_deltas": with_fixtures(["pred"], f"WITH {metrics_sql('pred', 'model_id, label')} SELECT c.label, c.model_id, {', '.join(f'round(c.{x} - z.{x}, 6) + 0.0 AS delta_{x}' for x in m.METRICS)} FROM mt c JOIN mt z ON c.label = z.label AND z.model_id = 'm2026' AND c.model_id <> 'm2026'"),
    "b5_exact_bound": "WITH RECURSIVE" + with_fixtures(["binary_events"], """WITH g AS (SELECT cohort, count(*) AS n, CAST(sum(event) AS BIGINT) AS k FROM binary_events GROUP BY 1),
it AS (SELECT cohort, k, n, CAST(k AS DOUBLE) / n AS lo, CAST(1 AS DOUBLE) AS hi, 0 AS i FROM g UNION ALL SELECT cohort, k, n, CASE WHEN c > 0.05 THEN mid ELSE lo END, CASE WHEN c > 0.05 THEN hi ELSE mid END, i + 1 FROM (
  SELECT *, (lo + hi) / 2 AS mid, list_sum(list_transform(range(k + 1), lambda x: exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + x * ln((lo + hi) / 2) + (n - x) * ln(1 - (lo + hi) / 2)))) AS c FROM it WHERE i < 40))
SELECT cohort, k, n, round((lo + hi) / 2, 6) AS upper FROM it WHERE i = 40""").removeprefix("WITH"),
    "b7_gate_plan": with_fixtures(["binary_events"], f"{_PLAN} SELECT cohort, block, n, round(rate, 6) AS rate, CAST(concentration AS DOUBLE) AS concentration, max_events, round(pass_probability, 6) AS pass_probability, pass_probability >= 0.8 AS reaches FROM pl"),
    "b7_least_sample_size": with_fixtures(["binary_events"], f"{_PLAN}, ms AS (SELECT cohort, max(n) FILTER (WHERE pass_probability < 0.8) AS missed FROM pl GROUP BY 1) SELECT cohort, min(n) FILTER (WHERE pass_probability >= 0.8 AND (missed IS NULL OR n > missed)) AS least_n FROM pl JOIN ms USING (cohort) GROUP BY cohort"),
    "s1_manifest_problems": with_fixtures(["manifest"], "WITH i AS (SELECT CASE WHEN record_id % 50 <> 0 THEN record_id // 2 END AS id FROM manifest), c AS (SELECT id, count(*) AS n FROM i GROUP BY 1) SELECT id, CASE WHEN id IS NULL THEN 'null id' ELSE 'repeated id' END AS problem, n FROM c WHERE id IS NULL OR n > 1 UNION ALL SELECT NULL, 'missing column age', 1"),
    "s6_prediction_problems": with_fixtures(["pred"], "WITH w AS (SELECT record_id, count(*) AS n FROM pred WHERE seed = 2026 AND (record_id % 9 > 0 OR li < 5) GROUP BY 1) SELECT record_id, CASE WHEN record_id % 10 = 0 THEN 'missing array' ELSE 'wrong length' END AS problem, CAST(n AS INTEGER) AS targets, CASE WHEN record_id % 10 = 0 THEN -1 ELSE CAST(n AS INTEGER) END AS logits FROM w WHERE n <> 5 OR record_id % 10 = 0"),
}
