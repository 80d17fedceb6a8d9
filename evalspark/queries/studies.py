"""Review, study, log and Arrow-backed signal queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.operators import metrics as m
from evalspark.operators import selective as sel
from evalspark.operators import studies as s
from evalspark.operators import summaries as sm
from evalspark.operators import waves as w
from evalspark.plans.fixtures import fixture, with_fixtures
from evalspark.plans.scratch import table
from evalspark.queries.metrics import LOSSES, _losses, rounded


def a17_error_detection(spark, d):
    rows = _losses(spark, d).select("model_id", "record_id", F.col("exact_error").cast("int").alias("target"), F.col("uncertainty").alias("prob"))
    return rounded(m.roc_auc(rows, ["model_id"]).join(m.average_precision(rows, ["model_id"]), "model_id"))


def a22_risk_curve_mean(spark, d):
    curve = sel.selective_points(_losses(spark, d), ["model_id"], ["hamming"], [k / 10 for k in range(1, 11)])
    return rounded(curve.groupBy("target_coverage").agg(F.avg("risk_hamming").alias("risk"), F.count(F.lit(1)).alias("seeds")))


def a28_review_summary(spark, d):
    reviews = table(spark, d, "lineitem").select(F.col("l_partkey").alias("proposal"), (F.col("l_quantity").cast("long") % 5).alias("rating"))
    return rounded(s.review_summary(reviews, 5))


def _answers(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("participant"), F.col("l_linestatus").alias("arm"), (F.col("l_quantity") > 20).cast("int").alias("correct"), F.col("l_extendedprice").alias("time_ms"), F.col("l_discount").alias("confidence")
    )


def a29_study_summary(spark, d):
    return rounded(s.study_summary(_answers(spark, d), 5), 4)


def a29_paired_differences(spark, d):
    return rounded(s.paired_differences(_answers(spark, d), "O", "F"))


def a33_route_counts(spark, d):
    tel = fixture(spark, d, "telemetry")
    return s.route_counts(tel, ["release_id", "decision"], [spark.createDataFrame([(f"r{i}",) for i in range(6)], "release_id string"), tel.select("decision").distinct()])


def c9_pseudonymize(spark, d):
    return table(spark, d, "customer").select("c_custkey", s.pseudonymize(F.col("c_custkey"), b"not a secret", "patient").alias("token"))


def c20_row_identity(spark, d):
    return table(spark, d, "customer").select("c_custkey", s.row_identity(["c_custkey", "c_mktsegment"]).alias("h"))


def _log(spark, d):
    h = lambda c: F.sha2(c.cast("string"), 256)
    i = F.col("event_id")
    return table(spark, d, "events").where("event_id % 500 <> 250").select(i.alias("sequence"), h(i).alias("entry_hash"), F.when(i == 0, "").when(i % 777 == 5, "broken").otherwise(h(i - 1)).alias("previous_entry_hash"))


def w10_verify_chain(spark, d):
    return s.verify_chain(_log(spark, d))


def w9_keyed_order(spark, d):
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("participant"))
    return s.keyed_order(people, table(spark, d, "nation").select(F.col("n_nationkey").alias("case_id")), "k")


def w7_greedy_cells(spark, d):
    return s.greedy_cells(table(spark, d, "orders"), "o_orderstatus", "o_custkey", "o_orderkey", 10, "salt")


def w6_compare_scores(spark, d):
    losses = _losses(spark, d).withColumn("max_entropy", F.round("max_entropy", 6))
    out = sm.compare_scores(losses, ["model_id"], ["uncertainty", "max_entropy"], ["hamming", "exact_error"])
    return rounded(out.select("model_id", "loss", "score", "rank", "aurc", "excess_aurc", "augrc"))


def w12_top_violations(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy("l_orderkey", "l_linenumber").limit(8)


def j12_nearest_lead(spark, d):
    return rounded(s.nearest_earlier_lead(fixture(spark, d, "wave")), 5)


def q14_curve_auc(spark, d):
    n = F.sequence(F.lit(0), F.size("samples") - 1)
    x = F.transform(n, lambda i: i / 63.0)
    return fixture(spark, d, "wave").select("record_id", "lead_idx", F.round(w.curve_auc(x, w.doubles(F.col("samples"))), 6).alias("auc"))


def q15_batch_score(spark, d):
    import numpy as np

    def predictor(x):
        return np.stack([x.mean(1), x.std(1)], 1)

    return rounded(s.batch_score(fixture(spark, d, "wave"), predictor, ["level", "spread"], 12, 64), 6)


def q17_normalize_attributions(spark, d):
    return s.normalize_attributions(fixture(spark, d, "wave")).groupBy("record_id").agg(F.round(F.max(F.array_max(F.transform("samples", lambda v: F.abs(v)))), 6).alias("top"), F.count(F.lit(1)).alias("leads"))


QUERIES = {f.__name__: f for f in (
    a17_error_detection, a22_risk_curve_mean, a28_review_summary, a29_study_summary, a29_paired_differences, a33_route_counts, c9_pseudonymize, c20_row_identity, w10_verify_chain, w9_keyed_order, w7_greedy_cells,
    w6_compare_scores, w12_top_violations, j12_nearest_lead, q14_curve_auc, q15_batch_score, q17_normalize_attributions,
)}

_ANS = "a AS (SELECT l_suppkey AS participant, l_linestatus AS arm, CASE WHEN l_quantity > 20 THEN 1 ELSE 0 END AS correct, l_extendedprice AS time_ms, l_discount AS confidence FROM lineitem)"

ORACLE_SQL = {
    "w6_compare_scores": with_fixtures(["pred"], f"""WITH {LOSSES}, long AS (SELECT model_id, record_id, s.score, s.u, l.loss, l.v FROM losses, LATERAL (SELECT unnest(['uncertainty', 'max_entropy']) AS score, unnest([uncertainty, round(max_entropy, 6)]) AS u) s,
  LATERAL (SELECT unnest(['hamming', 'exact_error']) AS loss, unnest([CAST(hamming AS DOUBLE), CAST(exact_error AS DOUBLE)]) AS v) l),
both_ AS (SELECT model_id, record_id, loss, score, u AS o, v, 'own' AS kind FROM long UNION ALL SELECT model_id, record_id, loss, score, v, v, 'best' FROM long),
tt AS (SELECT model_id, loss, score, kind, o, avg(v) AS mean FROM both_ GROUP BY ALL), xx AS (SELECT b.*, mean, row_number() OVER (PARTITION BY b.model_id, b.loss, b.score, b.kind ORDER BY b.o, record_id) AS k FROM both_ b JOIN tt USING (model_id, loss, score, kind, o)),
cc AS (SELECT model_id, loss, score, kind, k, sum(mean) OVER (PARTITION BY model_id, loss, score, kind ORDER BY k) AS s, count(*) OVER (PARTITION BY model_id, loss, score, kind) AS n FROM xx),
aa AS (SELECT model_id, loss, score, avg(s / k) FILTER (kind = 'own') AS aurc, avg(s / n) FILTER (kind = 'own') AS augrc, avg(s / k) FILTER (kind = 'own') - avg(s / k) FILTER (kind = 'best') AS excess_aurc FROM cc GROUP BY ALL)
SELECT model_id, loss, score, CAST(row_number() OVER (PARTITION BY model_id, loss ORDER BY round(excess_aurc, 12), score) AS INTEGER) AS rank, round(aurc, 6) AS aurc, round(excess_aurc, 6) AS excess_aurc, round(augrc, 6) AS augrc FROM aa"""),
    "a17_error_detection": with_fixtures(["pred"], f"""WITH {LOSSES}, h AS (SELECT model_id, uncertainty AS u, count(*) AS n, sum(exact_error) AS pos FROM losses GROUP BY ALL), c AS (SELECT *, sum(n - pos) OVER (PARTITION BY model_id ORDER BY u) - (n - pos) AS before, sum(pos) OVER (PARTITION BY model_id ORDER BY u DESC) AS tp, sum(n) OVER (PARTITION BY model_id ORDER BY u DESC) AS seen, sum(pos) OVER (PARTITION BY model_id) AS ap, sum(n - pos) OVER (PARTITION BY model_id) AS an FROM h)
SELECT model_id, round(sum(CAST(pos AS DOUBLE) * (before + (n - pos) / 2.0)) / (max(ap) * CAST(max(an) AS DOUBLE)), 6) AS auroc, round(sum(CAST(pos AS DOUBLE) * tp / seen) / max(ap), 6) AS average_precision FROM c GROUP BY model_id"""),
    "a22_risk_curve_mean": with_fixtures(["pred"], f"WITH {LOSSES}, r AS (SELECT *, row_number() OVER w AS k, count(*) OVER () AS n, sum(hamming) OVER w AS h FROM losses WINDOW w AS (ORDER BY uncertainty, record_id)) SELECT c / 10.0 AS target_coverage, round(avg(h / k), 6) AS risk, count(*) AS seeds FROM r, range(1, 11) t(c) WHERE k = ceil(round(c / 10.0 * n, 9)) GROUP BY 1"),
    "a28_review_summary": "WITH c AS (SELECT l_partkey AS proposal, CAST(l_quantity AS BIGINT) % 5 AS r, count(*) AS n FROM lineitem GROUP BY ALL), s AS (SELECT proposal, CAST(sum(n) AS BIGINT) AS reviews, sum(n * r) AS t, sum(n * r * r) AS q, sum(n * (n - 1) / 2) AS same FROM c GROUP BY proposal HAVING sum(n) >= 5) SELECT proposal, reviews, round(t / reviews, 6) AS mean, round(sqrt(greatest(q / reviews - (t / reviews) ** 2, 0)), 6) AS sd, round(same / (reviews * (reviews - 1) / 2), 6) AS agreement FROM s",
    "a29_study_summary": f"WITH {_ANS} SELECT arm, count(DISTINCT participant) AS participants, round(avg(correct), 4) AS accuracy, round(avg(time_ms), 4) AS mean_time, round(median(time_ms), 4) AS median_time, round(avg((confidence - correct) ** 2), 4) AS confidence_brier FROM a GROUP BY arm",
    "a29_paired_differences": f"WITH {_ANS} SELECT participant, round(avg(correct) FILTER (arm = 'O') - avg(correct) FILTER (arm = 'F'), 6) AS difference FROM a GROUP BY participant HAVING count(*) FILTER (arm = 'O') > 0 AND count(*) FILTER (arm = 'F') > 0",
    "a33_route_counts": with_fixtures(["telemetry"], "WITH g AS (SELECT 'r' || CAST(i AS VARCHAR) AS release_id, decision FROM range(6) t(i), (SELECT DISTINCT decision FROM telemetry)) SELECT g.release_id, g.decision, count(t.event_id) AS n FROM g LEFT JOIN telemetry t ON g.release_id = t.release_id AND g.decision = t.decision GROUP BY 1, 2"),
    "c20_row_identity": "SELECT c_custkey, sha256('{\"c_custkey\":' || CAST(c_custkey AS VARCHAR) || ',\"c_mktsegment\":\"' || c_mktsegment || '\"}') AS h FROM customer",
    "w10_verify_chain": "WITH l AS (SELECT event_id AS s FROM events WHERE event_id % 500 <> 250) SELECT s AS sequence, CASE WHEN s <> 0 AND (s - 1) % 500 = 250 THEN 'gap' ELSE 'hash' END AS fault FROM l WHERE s <> 0 AND ((s - 1) % 500 = 250 OR s % 777 = 5)",
    "w9_keyed_order": "SELECT c_custkey AS participant, n_nationkey AS case_id, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY sha256('k|' || CAST(c_custkey AS VARCHAR) || '|' || CAST(n_nationkey AS VARCHAR))) AS INTEGER) AS ordinal FROM customer, nation",
    "w12_top_violations": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1 ORDER BY 1, 2 LIMIT 8",
    "j12_nearest_lead": with_fixtures(["wave"], "WITH p AS (SELECT b.record_id, b.lead_idx, a.lead_idx AS earlier, list_max(list_transform(range(1, len(a.samples) + 1), lambda i: abs(CAST(a.samples[i] AS DOUBLE) - CAST(b.samples[i] AS DOUBLE)))) AS x FROM wave a JOIN wave b ON a.record_id = b.record_id AND a.lead_idx < b.lead_idx) SELECT record_id, lead_idx, round(min(x), 5) AS distance, arg_min(earlier, (x, earlier)) AS earlier FROM p GROUP BY ALL"),
    "q14_curve_auc": with_fixtures(["wave"], "SELECT record_id, lead_idx, round(list_sum(list_transform(range(1, len(samples)), lambda i: (CAST(samples[i] AS DOUBLE) + CAST(samples[i + 1] AS DOUBLE)) / 2 / 63.0)), 6) AS auc FROM wave"),
    "q17_normalize_attributions": with_fixtures(["wave"], "SELECT record_id, CAST(1.0 AS DOUBLE) AS top, count(*) AS leads FROM wave GROUP BY record_id"),
}
