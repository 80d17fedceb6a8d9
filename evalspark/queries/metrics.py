"""Metric, threshold, conformal and selective-risk queries over the prediction fixture."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.operators import metrics as m
from evalspark.operators import selective as s
from evalspark.plans.fixtures import fixture, with_fixtures
from evalspark.plans.prims import cluster_draws, draw_sql, prefix_scan, score_hist

KEYS = ["model_id", "label"]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _pred(spark, d):
    return fixture(spark, d, "pred")


def _one(spark, d):
    return _pred(spark, d).where("seed = 2026")


def _decided(spark, d):
    return _one(spark, d).withColumn("decision", (F.col("prob") >= 0.5).cast("int"))


def _losses(spark, d):
    """One model's record losses; uncertainty rounded so that both engines see the same ties."""
    losses = m.record_losses(_decided(spark, d), ["model_id"])
    return losses.withColumn("uncertainty", F.round("uncertainty", 6)).withColumn("hamming", F.round("hamming", 6))


LOSSES = """
losses AS (SELECT model_id, record_id, avg(-(CASE WHEN target = 1 THEN ln(prob) ELSE ln(1 - prob) END)) AS log_loss,
  round(avg(CASE WHEN (prob >= 0.5) <> (target = 1) THEN 1.0 ELSE 0.0 END), 6) AS hamming, max(CASE WHEN (prob >= 0.5) <> (target = 1) THEN 1.0 ELSE 0.0 END) AS exact_error,
  avg((prob - target) * (prob - target)) AS brier, round(avg(-(prob * ln(prob) + (1 - prob) * ln(1 - prob)) / ln(2.0)), 6) AS uncertainty,
  least(max(-(prob * ln(prob) + (1 - prob) * ln(1 - prob)) / ln(2.0)), 1.0) AS max_entropy
  FROM pred WHERE seed = 2026 GROUP BY model_id, record_id)"""

HIST = "hist AS (SELECT model_id, label, prob, count(*) AS n, sum(target) AS pos FROM pred GROUP BY ALL)"
AUC = """auc AS (SELECT model_id, label, round(CASE WHEN max(all_pos) > 0 AND max(all_neg) > 0 THEN sum(pos * (before + (n - pos) / 2.0)) / (max(all_pos) * max(all_neg)) END, 6) AS auroc FROM (
  SELECT *, coalesce(sum(n - pos) OVER (PARTITION BY model_id, label ORDER BY prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  CAST(sum(pos) OVER (PARTITION BY model_id, label) AS DOUBLE) AS all_pos, CAST(sum(n - pos) OVER (PARTITION BY model_id, label) AS DOUBLE) AS all_neg FROM hist) GROUP BY model_id, label)"""
AP = """ap AS (SELECT model_id, label, round(CASE WHEN max(P) > 0 THEN sum(pos * tp / seen) / max(P) END, 6) AS average_precision FROM (
  SELECT *, CAST(sum(pos) OVER (PARTITION BY model_id, label ORDER BY prob DESC) AS DOUBLE) AS tp, CAST(sum(n) OVER (PARTITION BY model_id, label ORDER BY prob DESC) AS DOUBLE) AS seen,
  CAST(sum(pos) OVER (PARTITION BY model_id, label) AS DOUBLE) AS P FROM hist) GROUP BY model_id, label)"""
POINT = "pw AS (SELECT model_id, label, round(avg((prob - target) * (prob - target)), 6) AS brier, round(avg(-(CASE WHEN target = 1 THEN ln(prob) ELSE ln(1 - prob) END)), 6) AS log_loss FROM pred GROUP BY ALL)"
ECE = """ece AS (SELECT model_id, label, round(sum(n * abs(acc - conf)) / sum(n), 6) AS ece FROM (
  SELECT model_id, label, least(floor(prob * 15), 14) AS bin, count(*) AS n, avg(prob) AS conf, avg(CAST(target AS DOUBLE)) AS acc FROM pred GROUP BY ALL) GROUP BY model_id, label)"""
PREV = """prev AS (SELECT model_id, label, count(*) AS n, CAST(sum(target) AS BIGINT) AS positives, CAST(count(*) - sum(target) AS BIGINT) AS negatives, round(sum(target) / count(*), 6) AS rate,
  CASE WHEN sum(target) = 0 THEN 'no_positives' WHEN sum(target) = count(*) THEN 'no_negatives' END AS reason FROM pred GROUP BY ALL)"""
RANKED = """ranked AS (SELECT model_id, label, record_id, prob, target, row_number() OVER (PARTITION BY model_id, label ORDER BY prob, record_id) - 1 AS r, count(*) OVER (PARTITION BY model_id, label) AS n FROM pred WHERE seed = 2026)"""
BINS = """binned AS (SELECT *, CASE WHEN r < (n % 15) * (floor(n / 15) + 1) THEN floor(r / (floor(n / 15) + 1)) ELSE (n % 15) + floor((r - (n % 15) * (floor(n / 15) + 1)) / greatest(floor(n / 15), 1)) END AS bin FROM ranked),
curve AS (SELECT model_id, label, CAST(bin AS BIGINT) AS bin, count(*) AS n, round(min(prob), 6) AS p_min, round(max(prob), 6) AS p_max, avg(prob) AS p_mean, avg(CAST(target AS DOUBLE)) AS event_rate FROM binned GROUP BY ALL)"""


def p2_prefix_scan(spark, d):
    hist = score_hist(_one(spark, d), ["label"], "prob", "target")
    return prefix_scan(hist, ["label"], [F.col("prob")], {"seen": F.col("n"), "tp": F.col("pos")}).select("label", F.round("prob", 6).alias("prob"), "n", "seen", "tp", "seen_total")


def p3_cluster_draws(spark, d):
    n = fixture(spark, d, "binary_events").select("cluster_id").distinct().count()
    return cluster_draws(spark, n, 20, 7)


def a1_prevalence(spark, d):
    return rounded(m.prevalence(_pred(spark, d), KEYS))


def a2_roc_auc(spark, d):
    return rounded(m.roc_auc(_pred(spark, d), KEYS))


def a3_average_precision(spark, d):
    return rounded(m.average_precision(_pred(spark, d), KEYS))


def a4_a5_pointwise(spark, d):
    return rounded(m.pointwise(_pred(spark, d), KEYS))


def a6_ece_fixed(spark, d):
    return rounded(m.ece_fixed(_pred(spark, d), KEYS))


def a7_macro_metrics(spark, d):
    both = m.roc_auc(_pred(spark, d), KEYS).join(m.average_precision(_pred(spark, d), KEYS), KEYS)
    return rounded(m.macro(both, ["model_id"], ["auroc", "average_precision"]), 5)


def a8_ace_equal_mass(spark, d):
    return rounded(m.ace_equal_mass(_one(spark, d), KEYS))


def a9_ece_sweep(spark, d):
    return rounded(m.ece_sweep(_one(spark, d), KEYS))


def a11_reliability_curve(spark, d):
    return rounded(m.reliability_curve(_one(spark, d), KEYS))


def a13_decision_metrics(spark, d):
    return rounded(m.decision_metrics(_decided(spark, d), ["model_id"]))


def a16_evaluate_sets(spark, d):
    pred = _one(spark, d)
    fit = s.fit_conformal(pred.where("fold = 9"), ["label"], 0.1)
    return rounded(s.evaluate_sets(s.predict_sets(pred.where("fold = 10"), fit, ["label"]), ["model_id"]))


def a18_frozen_gate_audit(spark, d):
    gates = spark.createDataFrame([("m2026", 0.5, 0.6), ("m2026", 0.8, 0.7), ("m2026", 0.01, 0.0)], "model_id string, target_coverage double, maximum_entropy double")
    return rounded(s.frozen_gate_audit(_losses(spark, d), gates, ["model_id"], ["hamming", "exact_error", "brier"]))


def a21_seed_summary(spark, d):
    return rounded(m.seed_summary(m.pointwise(_pred(spark, d), KEYS), ["label"], "brier"))


def evaluate_members(spark, d):
    return rounded(m.evaluate_members(_pred(spark, d), KEYS))


def c17_record_losses(spark, d):
    return rounded(_losses(spark, d))


def m1_fit_thresholds(spark, d):
    return rounded(s.fit_thresholds(_one(spark, d), KEYS))


def m4_fit_entropy_gate(spark, d):
    return rounded(s.fit_entropy_gate(_losses(spark, d), ["model_id"], 0.8))


def m5_fit_conformal(spark, d):
    return rounded(s.fit_conformal(_one(spark, d).where("fold = 9"), ["label"], 0.1))


def m6_fit_conformal_class(spark, d):
    return rounded(s.fit_conformal(_one(spark, d).where("fold = 9"), ["label", "target"], 0.001))


def m7_fit_conformal_group(spark, d):
    groups = fixture(spark, d, "subgroups").where("attribute = 'segment'").select("record_id", "group_value")
    return rounded(s.fit_conformal(_one(spark, d).where("fold = 9").join(groups, "record_id"), ["label", "group_value"], 0.1))


def m8_predict_sets(spark, d):
    pred = _one(spark, d)
    sets = s.predict_sets(pred.where("fold = 10"), s.fit_conformal(pred.where("fold = 9"), ["label"], 0.1), ["label"])
    return sets.select("record_id", "label", "has_negative", "has_positive", "decision_set")


def m13_select_architecture(spark, d):
    aucs = m.roc_auc(_pred(spark, d), KEYS)
    trials = aucs.select(F.col("label").alias("architecture"), F.substring("model_id", 2, 4).cast("long").alias("trial"), F.lit(1).alias("epochs"), F.round("auroc", 6).alias("score"))
    return rounded(s.select_architecture(trials, 0.005), 5)


def w1_stable_rank(spark, d):
    return rounded(s.stable_rank(_one(spark, d).select("label", "record_id", "prob"), ["label"], "prob", "record_id"))


def w2_selective_points(spark, d):
    return rounded(s.selective_points(_losses(spark, d), ["model_id"], ["hamming", "exact_error"], [0.5, 0.8, 1.0]))


def w3_risk_coverage(spark, d):
    return rounded(s.dense_curve(_losses(spark, d), ["model_id"], ["hamming", "brier"]), 9)


def w4_w5_aurc(spark, d):
    return rounded(s.excess_aurc(_losses(spark, d), ["model_id"], "hamming"))


def w13_first_per_entity(spark, d):
    return s.first_per_entity(_one(spark, d).where("fold = 10"), "patient_id", "record_id", 25)


QUERIES = {f.__name__: f for f in (
    evaluate_members, p2_prefix_scan, p3_cluster_draws, a1_prevalence, a2_roc_auc, a3_average_precision, a4_a5_pointwise, a6_ece_fixed, a7_macro_metrics, a8_ace_equal_mass, a9_ece_sweep,
    a11_reliability_curve, a13_decision_metrics, a16_evaluate_sets, a18_frozen_gate_audit, a21_seed_summary, c17_record_losses, m1_fit_thresholds, m4_fit_entropy_gate, m5_fit_conformal,
    m6_fit_conformal_class, m7_fit_conformal_group, m8_predict_sets, m13_select_architecture, w1_stable_rank, w2_selective_points, w3_risk_coverage, w4_w5_aurc, w13_first_per_entity,
)}


def _sql(body: str, *more: str) -> str:
    return with_fixtures(["pred", *more], body)


def _conformal(keys: str, where: str, alpha: float, source: str = "pred") -> str:
    part = f"PARTITION BY {keys}"
    return f"""fit AS (SELECT {keys}, max(n) AS n, CAST(max(k) AS BIGINT) AS k, round(coalesce(max(CASE WHEN r = k THEN nc END), 1.0), 6) AS cutoff, max(k) <= max(n) AS attainable FROM (
  SELECT *, row_number() OVER ({part} ORDER BY nc, record_id) AS r, count(*) OVER ({part}) AS n, ceil(round((count(*) OVER ({part}) + 1) * {1 - alpha}, 9)) AS k FROM (
    SELECT *, round(CASE WHEN target = 1 THEN 1 - prob ELSE prob END, 9) AS nc FROM {source} WHERE seed = 2026 AND {where})) GROUP BY {keys})"""


SETS = """sets AS (SELECT p.model_id, p.record_id, p.label, p.target, round(prob, 9) <= cutoff AS has_negative, round(1 - prob, 9) <= cutoff AS has_positive FROM pred p JOIN fit USING (label) WHERE seed = 2026 AND fold = 10)"""
_TIES = """{name}_t AS (SELECT model_id, {order} AS o, count(*) AS m, sum(hamming) AS l FROM losses GROUP BY ALL),
{name}_x AS (SELECT l.model_id, t.l / t.m AS loss, row_number() OVER (PARTITION BY l.model_id ORDER BY {order}, record_id) AS k FROM losses l JOIN {name}_t t ON l.model_id = t.model_id AND l.{order} = t.o),
{name}_c AS (SELECT model_id, k, sum(loss) OVER (PARTITION BY model_id ORDER BY k) AS s, count(*) OVER (PARTITION BY model_id) AS n FROM {name}_x),
{name} AS (SELECT model_id, avg(s / k) AS aurc, avg(s / n) AS augrc FROM {name}_c GROUP BY model_id)"""

ORACLE_SQL = {
    "p2_prefix_scan": _sql("""WITH h AS (SELECT label, prob, count(*) AS n, CAST(sum(target) AS BIGINT) AS pos FROM pred WHERE seed = 2026 GROUP BY ALL)
SELECT label, round(prob, 6) AS prob, n, CAST(sum(n) OVER (PARTITION BY label ORDER BY prob) AS BIGINT) AS seen, CAST(sum(pos) OVER (PARTITION BY label ORDER BY prob) AS BIGINT) AS tp, CAST(sum(n) OVER (PARTITION BY label) AS BIGINT) AS seen_total FROM h"""),
    "p3_cluster_draws": f"""WITH c AS (SELECT count(DISTINCT o_custkey) AS n FROM orders), g AS (SELECT b, j, {draw_sql(7, 'b', 'j')} % n AS cluster FROM c, range(20) t(b), LATERAL (SELECT unnest(range(n)) AS j))
SELECT b, cluster, count(*) AS weight FROM g GROUP BY b, cluster""",
    "a1_prevalence": _sql(f"WITH {PREV} SELECT * FROM prev"),
    "a2_roc_auc": _sql(f"WITH {HIST}, {AUC} SELECT * FROM auc"),
    "a3_average_precision": _sql(f"WITH {HIST}, {AP} SELECT * FROM ap"),
    "a4_a5_pointwise": _sql(f"WITH {POINT} SELECT * FROM pw"),
    "a6_ece_fixed": _sql(f"WITH {ECE} SELECT * FROM ece"),
    "a7_macro_metrics": _sql(f"WITH {HIST}, {AUC}, {AP} SELECT model_id, round(avg(auroc), 5) AS macro_auroc, round(avg(average_precision), 5) AS macro_average_precision, count(auroc) AS labels_auroc, count(average_precision) AS labels_average_precision FROM auc JOIN ap USING (model_id, label) GROUP BY model_id"),
    "a8_ace_equal_mass": _sql(f"WITH {RANKED}, {BINS} SELECT model_id, label, round(sum(n * abs(p_mean - event_rate)) / sum(n), 6) AS ace FROM curve GROUP BY ALL"),
    "a9_ece_sweep": _sql(f"""WITH {RANKED}, g AS (SELECT model_id, label, prob, target, n, b,
  CASE WHEN r < (n % b) * (floor(n / b) + 1) THEN floor(r / (floor(n / b) + 1)) ELSE (n % b) + floor((r - (n % b) * (floor(n / b) + 1)) / greatest(floor(n / b), 1)) END AS bin FROM ranked, range(1, 101) t(b) WHERE b <= n),
c AS (SELECT model_id, label, b, n, bin, sum(target) AS y, sum(prob) AS p, avg(CAST(target AS DOUBLE)) AS rate FROM g GROUP BY ALL), f AS (SELECT *, rate < lag(rate) OVER (PARTITION BY model_id, label, b ORDER BY bin) AS fell FROM c),
e AS (SELECT model_id, label, b, coalesce(bool_or(fell), false) AS fell, sum(abs(y - p)) / max(n) AS error FROM f GROUP BY ALL)
SELECT model_id, label, max(b) AS bins, round(arg_max(error, b), 6) AS ece_sweep FROM e WHERE NOT fell GROUP BY ALL"""),
    "a11_reliability_curve": _sql(f"WITH {RANKED}, {BINS} SELECT model_id, label, bin, n, p_min, p_max, round(p_mean, 6) AS p_mean, round(event_rate, 6) AS event_rate FROM curve"),
    "a13_decision_metrics": _sql(f"WITH {LOSSES} SELECT model_id, round(avg(hamming), 6) AS hamming, round(avg(1 - exact_error), 6) AS exact_match FROM losses GROUP BY model_id"),
    "a16_evaluate_sets": _sql(f"""WITH {_conformal('label', 'fold = 9', 0.1)}, {SETS}, x AS (SELECT *, CAST(has_negative AS INT) + CAST(has_positive AS INT) AS size, CASE WHEN target = 1 THEN has_positive ELSE has_negative END AS covered FROM sets),
j AS (SELECT model_id, record_id, min(CAST(covered AS INT)) AS a FROM x GROUP BY ALL)
SELECT x.model_id, round(avg(CAST(covered AS INT)), 6) AS coverage, round(avg(size), 6) AS mean_size, round(avg(CASE WHEN size = 0 THEN 1.0 ELSE 0 END), 6) AS empty, round(avg(CASE WHEN size = 1 THEN 1.0 ELSE 0 END), 6) AS singleton,
  round(avg(CASE WHEN size = 2 THEN 1.0 ELSE 0 END), 6) AS both, (SELECT round(avg(a), 6) FROM j) AS joint_coverage FROM x GROUP BY x.model_id"""),
    "a18_frozen_gate_audit": _sql(f"""WITH {LOSSES}, g AS (SELECT * FROM (VALUES (0.5, 0.6), (0.8, 0.7), (0.01, 0.0)) AS t(target_coverage, maximum_entropy))
SELECT model_id, CAST(target_coverage AS DOUBLE) AS target_coverage, count(*) AS n, count(*) FILTER (uncertainty <= maximum_entropy) AS accepted, round(avg(CASE WHEN uncertainty <= maximum_entropy THEN 1.0 ELSE 0 END), 6) AS coverage,
  round(avg(hamming) FILTER (uncertainty <= maximum_entropy), 6) AS accepted_hamming, round(avg(exact_error) FILTER (uncertainty <= maximum_entropy), 6) AS accepted_exact_error, round(avg(brier) FILTER (uncertainty <= maximum_entropy), 6) AS accepted_brier
FROM losses, g GROUP BY model_id, target_coverage"""),
    "a21_seed_summary": _sql("WITH b AS (SELECT model_id, label, avg((prob - target) * (prob - target)) AS v FROM pred GROUP BY ALL) SELECT label, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, round(median(v), 6) AS median, round(min(v), 6) AS low, round(max(v), 6) AS high, count(v) AS seeds FROM b GROUP BY label"),
    "evaluate_members": _sql(f"WITH {PREV}, {HIST}, {AUC}, {AP}, {POINT}, {ECE} SELECT * FROM prev JOIN auc USING (model_id, label) JOIN ap USING (model_id, label) JOIN pw USING (model_id, label) JOIN ece USING (model_id, label)"),
    "c17_record_losses": _sql(f"WITH {LOSSES} SELECT model_id, record_id, round(log_loss, 6) AS log_loss, hamming, CAST(exact_error AS DOUBLE) AS exact_error, round(brier, 6) AS brier, uncertainty, round(max_entropy, 6) AS max_entropy FROM losses"),
    "m1_fit_thresholds": _sql(f"""WITH {HIST}, h AS (SELECT model_id, label, prob, n, pos FROM hist WHERE model_id = 'm2026' UNION ALL SELECT DISTINCT model_id, label, c, 0, 0 FROM hist, (VALUES (0.0), (1.0), (0.5)) AS t(c) WHERE model_id = 'm2026'),
p AS (SELECT model_id, label, prob, sum(n) AS n, sum(pos) AS pos FROM h GROUP BY ALL), c AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS called, sum(pos) OVER (PARTITION BY model_id, label) AS P FROM p WINDOW w AS (PARTITION BY model_id, label ORDER BY prob DESC)),
f AS (SELECT *, 2.0 * tp / (P + called) AS f1 FROM c), b AS (SELECT *, max(f1) OVER (PARTITION BY model_id, label) AS top FROM f), o AS (SELECT *, row_number() OVER (PARTITION BY model_id, label ORDER BY round(abs(prob - 0.5), 12), prob DESC) AS i FROM b WHERE f1 >= top - 1e-12)
SELECT model_id, label, round(CAST(prob AS DOUBLE), 6) AS threshold, round(CAST(top AS DOUBLE), 6) AS f1 FROM o WHERE i = 1"""),
    "m4_fit_entropy_gate": _sql(f"""WITH {LOSSES}, r AS (SELECT *, row_number() OVER (ORDER BY uncertainty, record_id) AS i, count(*) OVER () AS n FROM losses), c AS (SELECT max(n) AS n, CAST(max(ceil(round(0.8 * n, 9))) AS BIGINT) AS k, max(CASE WHEN i = ceil(round(0.8 * n, 9)) THEN uncertainty END) AS cutoff FROM r)
SELECT 'm2026' AS model_id, n, k, cutoff, (SELECT count(*) FROM losses WHERE uncertainty <= cutoff) AS kept FROM c"""),
    "m5_fit_conformal": _sql(f"WITH {_conformal('label', 'fold = 9', 0.1)} SELECT * FROM fit"),
    "m6_fit_conformal_class": _sql(f"WITH {_conformal('label, target', 'fold = 9', 0.001)} SELECT * FROM fit"),
    "m7_fit_conformal_group": _sql(f"WITH g AS (SELECT p.*, group_value FROM pred p JOIN subgroups s ON p.record_id = s.record_id AND attribute = 'segment'), {_conformal('label, group_value', 'fold = 9', 0.1, 'g')} SELECT * FROM fit", "subgroups"),
    "m8_predict_sets": _sql(f"WITH {_conformal('label', 'fold = 9', 0.1)}, {SETS} SELECT record_id, label, has_negative, has_positive, CASE WHEN has_positive AND NOT has_negative THEN 'supported' WHEN has_negative AND NOT has_positive THEN 'not_supported' ELSE 'uncertain' END AS decision_set FROM sets"),
    "m13_select_architecture": _sql(f"""WITH {HIST}, {AUC}, b AS (SELECT label AS architecture, avg(auroc) AS mean_score FROM auc GROUP BY label), t AS (SELECT label AS architecture, CAST(substr(model_id, 2, 4) AS BIGINT) AS best_trial, row_number() OVER (PARTITION BY label ORDER BY auroc DESC, model_id) AS i FROM auc),
r AS (SELECT *, CAST(row_number() OVER w AS INT) AS place, mean_score - lead(mean_score) OVER w AS lead_ FROM b WINDOW w AS (ORDER BY mean_score DESC, architecture))
SELECT architecture, best_trial, round(mean_score, 5) AS mean_score, place, CASE WHEN place = 1 AND lead_ > 0.005 THEN 'winner' WHEN place = 1 THEN 'tie' ELSE 'other' END AS verdict FROM r JOIN t USING (architecture) WHERE i = 1"""),
    "w1_stable_rank": _sql("WITH r AS (SELECT label, record_id, prob, row_number() OVER (PARTITION BY label ORDER BY prob, record_id) AS rank FROM pred WHERE seed = 2026) SELECT label, record_id, round(prob, 6) AS prob, rank, round(avg(rank) OVER (PARTITION BY label, prob), 6) AS average_rank FROM r"),
    "w2_selective_points": _sql(f"""WITH {LOSSES}, r AS (SELECT *, row_number() OVER w AS k, count(*) OVER () AS n, sum(hamming) OVER w AS h, sum(exact_error) OVER w AS e FROM losses WINDOW w AS (ORDER BY uncertainty, record_id)), c AS (SELECT * FROM (VALUES (0.5), (0.8), (1.0)) AS t(target_coverage))
SELECT model_id, k, round(k / n, 6) AS coverage, uncertainty AS cutoff, round(h / k, 6) AS risk_hamming, round(CAST(e AS DOUBLE) / k, 6) AS risk_exact_error, CAST(target_coverage AS DOUBLE) AS target_coverage FROM r, c WHERE k = ceil(round(target_coverage * n, 9))"""),
    "w3_risk_coverage": _sql(f"""WITH {LOSSES}, r AS (SELECT *, row_number() OVER w AS k, count(*) OVER () AS n, sum(hamming) OVER w AS h, sum(brier) OVER w AS b FROM losses WINDOW w AS (ORDER BY uncertainty, record_id))
SELECT model_id, record_id, k, round(k / n, 9) AS coverage, uncertainty AS cutoff, round(h / k, 9) AS risk_hamming, round(b / k, 9) AS risk_brier FROM r"""),
    "w4_w5_aurc": _sql(f"WITH {LOSSES}, {_TIES.format(name='own', order='uncertainty')}, {_TIES.format(name='best', order='hamming')} SELECT model_id, round(own.aurc, 6) AS aurc, round(best.aurc, 6) AS oracle_aurc, round(own.aurc - best.aurc, 6) AS excess_aurc, round(own.augrc, 6) AS augrc FROM own JOIN best USING (model_id)"),
    "w13_first_per_entity": _sql("SELECT patient_id, min(record_id) AS record_id FROM pred WHERE seed = 2026 AND fold = 10 GROUP BY patient_id ORDER BY 2, 1 LIMIT 25"),
}
