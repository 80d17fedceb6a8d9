"""Bootstrap queries over the prediction fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.operators import intervals as b
from evalspark.operators.metrics import METRICS, record_losses
from evalspark.plans.fixtures import fixture, with_fixtures
from evalspark.plans.prims import draw_sql
from evalspark.queries.metrics import rounded


def b2_bootstrap_metrics(spark, d):
    return rounded(b.bootstrap_metrics(fixture(spark, d, "pred").where("seed = 2026"), ["label"], "patient_id", 10, 5))


def b2_intervals(spark, d):
    reps = b.bootstrap_metrics(fixture(spark, d, "pred").where("seed = 2026"), ["label"], "patient_id", 20, 5)
    return rounded(b.intervals_of(reps, ["label"], "auroc", 10))


def b3_paired_bootstrap(spark, d):
    return rounded(b.paired_bootstrap(fixture(spark, d, "pred"), "model_id", "m2026", "m2027", ["label"], "patient_id", 10, 5))


def b2_macro_replicates(spark, d):
    pred = fixture(spark, d, "pred").where("seed = 2026")
    return rounded(b.macro_replicates(b.bootstrap_metrics(pred, ["label"], "patient_id", 10, 5), ["label"]))


def b4_paired_risk(spark, d):
    """Risk curve and gate deltas between two models; the gate of both is an entropy of 0.9."""
    pred = fixture(spark, d, "pred").where("seed < 2028")
    decided = pred.withColumn("decision", (F.col("prob") >= 0.5).cast("int"))
    losses = record_losses(decided, ["model_id", "patient_id"]).withColumns(
        {"uncertainty": F.round("uncertainty", 4), "maximum_entropy": F.lit(0.9)}
    )
    return rounded(b.paired_risk(losses, "model_id", "m2026", "m2027", [], "patient_id", "brier", 10, 5))


QUERIES = {f.__name__: f for f in (b2_bootstrap_metrics, b2_intervals, b2_macro_replicates, b3_paired_bootstrap, b4_paired_risk)}

_REPS = lambda n: f"""c AS (SELECT patient_id, row_number() OVER (ORDER BY patient_id) - 1 AS i, count(*) OVER () AS c FROM (SELECT DISTINCT patient_id FROM pred)),
dr AS (SELECT b, {draw_sql(5, 'b', 'j')} % c AS i FROM (SELECT max(c) AS c FROM c), range({n}) t(b), LATERAL (SELECT unnest(range(c)) AS j)), w AS (SELECT b, patient_id, count(*) AS w FROM dr JOIN c USING (i) GROUP BY 1, 2),
h AS (SELECT b, model_id, label, prob, sum(w) AS n, sum(w * target) AS pos FROM pred JOIN w USING (patient_id) GROUP BY ALL), r AS (SELECT *, sum(n - pos) OVER w - (n - pos) / 2.0 AS before, sum(pos) OVER g - sum(pos) OVER w + pos AS up_pos, sum(n) OVER g - sum(n) OVER w + n AS up_n, least(greatest(prob, 1e-12), 1 - 1e-12) AS q, least(floor(prob * 15), 14) AS bin FROM h WINDOW g AS (PARTITION BY b, model_id, label), w AS (PARTITION BY b, model_id, label ORDER BY prob)),
e AS (SELECT b, model_id, label, sum(abs(gap)) AS gap FROM (SELECT b, model_id, label, bin, sum(pos - n * prob) AS gap FROM r GROUP BY ALL) GROUP BY ALL),
m AS (SELECT b, model_id, label, sum(pos) / sum(n) AS rate, sum(CAST(pos AS DOUBLE) * before) / (sum(pos) * CAST(sum(n - pos) AS DOUBLE)) AS auroc, sum(CAST(pos AS DOUBLE) * up_pos / up_n) / sum(pos) AS average_precision, sum(pos * (1 - prob) * (1 - prob) + (n - pos) * prob * prob) / sum(n) AS brier,
  sum(-pos * ln(q) - (n - pos) * ln(1 - q)) / sum(n) AS log_loss, max(gap) / sum(n) AS ece FROM r JOIN e USING (b, model_id, label) GROUP BY ALL)"""  # noqa: E731

ORACLE_SQL = {
    "b2_bootstrap_metrics": with_fixtures(["pred"], f"WITH {_REPS(10)} SELECT CAST(b AS INTEGER) AS b, label, {', '.join(f'round({x}, 6) AS {x}' for x in METRICS)} FROM m WHERE model_id = 'm2026'"),
    "b2_macro_replicates": with_fixtures(["pred"], f"WITH {_REPS(10)} SELECT CAST(b AS INTEGER) AS b, {', '.join(f'CASE WHEN count({x}) = count(*) THEN round(avg({x}), 6) END AS {x}' for x in METRICS)} FROM m WHERE model_id = 'm2026' GROUP BY b"),
    "b2_intervals": with_fixtures(["pred"], f"WITH {_REPS(20)} SELECT label, count(auroc) AS valid, count(*) - count(auroc) AS invalid, round(quantile_cont(auroc, 0.025), 6) AS low, round(quantile_cont(auroc, 0.975), 6) AS high, 'ok' AS status FROM m WHERE model_id = 'm2026' GROUP BY label"),
    "b3_paired_bootstrap": with_fixtures(["pred"], f"WITH {_REPS(10)} SELECT CAST(x.b AS INTEGER) AS b, x.label, {', '.join(f'round(x.{c} - y.{c}, 6) + 0.0 AS {c}' for c in METRICS)} FROM m x JOIN m y ON x.b = y.b AND x.label = y.label AND x.model_id = 'm2026' AND y.model_id = 'm2027'"),
    "b4_paired_risk": with_fixtures(["pred"], f"""WITH c AS (SELECT patient_id, row_number() OVER (ORDER BY patient_id) - 1 AS i, count(*) OVER () AS c FROM (SELECT DISTINCT patient_id FROM pred)),
dr AS (SELECT b, {draw_sql(5, 'b', 'j')} % c AS i FROM (SELECT max(c) AS c FROM c), range(10) t(b), LATERAL (SELECT unnest(range(c)) AS j)), w AS (SELECT b, patient_id, count(*) AS w FROM dr JOIN c USING (i) GROUP BY 1, 2),
l AS (SELECT model_id, patient_id, record_id, avg((prob - target) ** 2) AS loss, round(avg(-(prob * ln(prob) + (1 - prob) * ln(1 - prob)) / ln(2)), 4) AS u FROM pred WHERE seed < 2028 GROUP BY ALL),
h AS (SELECT b, model_id, u, CAST(sum(w) AS DOUBLE) AS m, sum(w * loss) AS l FROM l JOIN w USING (patient_id) GROUP BY ALL), r AS (SELECT *, sum(m) OVER o AS k, sum(l) OVER o AS s FROM h WINDOW o AS (PARTITION BY b, model_id ORDER BY u)),
p AS (SELECT *, l / m AS mean, k - m AS k0, s - l AS s0, list_sum(list_transform(range(CAST(k - m AS BIGINT) + 1, CAST(k AS BIGINT) + 1), lambda j: 1.0 / j)) AS hs FROM r),
a AS (SELECT b, model_id, sum(mean * m + (s0 - mean * k0) * hs) / max(k) AS aurc, sum(m * s0 + mean * m * (m + 1) / 2) / max(k) / max(k) AS augrc, sum(m) FILTER (WHERE u <= 0.9) / sum(m) AS coverage, sum(l) FILTER (WHERE u <= 0.9) / sum(m) FILTER (WHERE u <= 0.9) AS accepted_loss FROM p GROUP BY ALL)
SELECT CAST(x.b AS INTEGER) AS b, {', '.join(f'round(x.{c} - y.{c}, 6) + 0.0 AS {c}' for c in ('aurc', 'augrc', 'coverage', 'accepted_loss'))} FROM a x JOIN a y ON x.b = y.b AND x.model_id = 'm2026' AND y.model_id = 'm2027'"""),
}
