"""Queries of corruptions, duplicated leads, perturbation reports and conformal groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.operators import corruptions as c
from evalspark.operators.selective import fit_conformal
from evalspark.plans.fixtures import fixture, with_fixtures
from evalspark.plans.scratch import table
from evalspark.queries.metrics import rounded


def _sums(wave):
    """Sum and position-weighted sum of each lead, which show a moved or changed sample."""
    s = F.transform("samples", lambda v: v.cast("double"))
    at = F.aggregate(F.transform(s, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return wave.select("record_id", "lead_idx", F.round(F.aggregate(s, F.lit(0.0), lambda a, v: a + v), 5).alias("total"), F.round(at, 4).alias("placed"))


def _wave(spark, d):
    return fixture(spark, d, "wave")


def q10_time_shift(spark, d):
    return _sums(c.time_shift(_wave(spark, d), 7))


def q10_permute_leads(spark, d):
    return _sums(c.permute_leads(_wave(spark, d), [1, 0, 2, 5, 4, 3, 7, 8, 6, 9, 11, 10]))


def q10_random_mask(spark, d):
    return _sums(c.masked_at_random(_wave(spark, d), 12, 5))


def q10_noise_at_snr(spark, d):
    """The ratio that the noise added to each record really has, in decibels."""
    key = ["record_id", "lead_idx"]
    met = _wave(spark, d).select(*key, "samples").join(c.noise_at_snr(_wave(spark, d), 12.0, 3).select(*key, F.col("samples").alias("noisy")), key)
    power = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v * v)
    added = F.zip_with("noisy", "samples", lambda x, y: x - y.cast("double"))
    sums = met.groupBy("record_id").agg(F.sum(power(F.transform("samples", lambda v: v.cast("double")))).alias("s"), F.sum(power(added)).alias("q"))
    return sums.select("record_id", F.round(10 * F.log10(F.col("s") / F.col("q")), 6).alias("snr_db"))


def j12_duplicated_leads(spark, d):
    wave = _wave(spark, d)
    copies = wave.where("record_id % 3 = 0 AND lead_idx = 2").withColumn("lead_idx", F.lit(9))
    flat = wave.where("record_id % 5 = 0 AND lead_idx = 4").withColumn("samples", F.transform("samples", lambda v: v * 0))
    rest = wave.join(copies.unionByName(flat).select("record_id", "lead_idx"), ["record_id", "lead_idx"], "left_anti")
    out = c.duplicated_leads(rest.unionByName(copies, True).unionByName(flat, True), 0.25, 1e-6)
    return out.select("record_id", "lead_idx", "earlier", F.round("distance", 5).alias("distance"))


def q12_perturbation_report(spark, d):
    wave = _wave(spark, d)
    cand = c.masked_at_random(wave.where("record_id % 10 < 9"), 12, 5)
    return rounded(c.perturbation_report(wave, cand, {"rms": 0.05, "changed": 0.1, "step": 0.2, "limb": 0.01}), 5)


def m6_fit_by_class(spark, d):
    return rounded(c.fit_by_class(fixture(spark, d, "pred").where("seed = 2026 AND fold = 9"), "label", {0: 0.05, 1: 0.2}))


def _groups(spark, d, fold):
    g = fixture(spark, d, "subgroups").where("attribute = 'status'").select("record_id", F.concat_ws("-", "group_value", (F.col("record_id") % 40).cast("string")).alias("cell"))
    return fixture(spark, d, "pred").where(f"seed = 2026 AND fold = {fold}").join(g, "record_id")


def m7_trivial_groups(spark, d):
    return c.trivial_groups(fit_conformal(_groups(spark, d, 9), ["label", "cell"], 0.1), ["label", "cell"])


def m7_unknown_groups(spark, d):
    fit = fit_conformal(_groups(spark, d, 9).where("record_id % 40 < 35"), ["label", "cell"], 0.1)
    return c.unknown_groups(_groups(spark, d, 10), fit, ["label", "cell"])


def s13_value_at_epoch(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("run"), (F.col("event_id") % 100).alias("epoch"), "value")
    history = e.groupBy("run", "epoch").agg(F.max("value").alias("value"))
    return c.value_at_epoch(history, "run", "value", 60).select("run", "epoch", F.round("value", 6).alias("value"))


def w9_counterbalanced_order(spark, d):
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("participant"))
    cases = table(spark, d, "nation").select(F.col("n_nationkey").alias("case_id"))
    return c.counterbalanced_order(people, cases, ["guided", "plain"], "k")


_FUNCTIONS = (
    q10_time_shift, q10_permute_leads, q10_random_mask, q10_noise_at_snr, j12_duplicated_leads, q12_perturbation_report, m6_fit_by_class,
    m7_trivial_groups, m7_unknown_groups, s13_value_at_epoch, w9_counterbalanced_order,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_S = "list_transform(samples, lambda v: CAST(v AS DOUBLE))"
_OUT = "SELECT record_id, lead_idx, round(list_sum(x), 5) AS total, round(list_sum(list_transform(range(1, len(x) + 1), lambda i: x[i] * i)), 4) AS placed FROM w"
_MASK = "m AS (SELECT record_id, lead_idx, s, floor(CAST('0x' || substr(md5('5|' || record_id), 1, 8) AS UBIGINT) / 4294967296.0 * (len(s) - 11)) AS st FROM a), w AS (SELECT record_id, lead_idx, s, list_transform(range(1, len(s) + 1), lambda i: CASE WHEN i - 1 >= st AND i - 1 < st + 12 THEN 0.0 ELSE s[i] END) AS x FROM m)"
_NC = "round(CASE WHEN target = 1 THEN 1 - prob ELSE prob END, 9)"


def _wave_sql(body: str) -> str:
    return with_fixtures(["wave"], f"WITH a AS (SELECT record_id, lead_idx, {_S} AS s FROM wave), {body}")


def _cells(fold: int) -> str:
    return f"(SELECT p.*, concat_ws('-', group_value, CAST(record_id % 40 AS VARCHAR)) AS cell FROM pred p JOIN subgroups USING (record_id) WHERE attribute = 'status' AND seed = 2026 AND fold = {fold})"


ORACLE_SQL = {
    "q10_time_shift": _wave_sql(f"w AS (SELECT record_id, lead_idx, list_concat([0.0 for i in range(7)], s[1:len(s) - 7]) AS x FROM a) {_OUT}"),
    "q10_permute_leads": _wave_sql(f"w AS (SELECT record_id, CAST(list_position([1, 0, 2, 5, 4, 3, 7, 8, 6, 9, 11, 10], lead_idx) - 1 AS INTEGER) AS lead_idx, s AS x FROM a) {_OUT}"),
    "q10_random_mask": _wave_sql(f"{_MASK} {_OUT}"),
    "q10_noise_at_snr": with_fixtures(["wave"], "SELECT DISTINCT record_id, CAST(12 AS DOUBLE) AS snr_db FROM wave"),
    "j12_duplicated_leads": _wave_sql("""k AS (SELECT record_id, lead_idx, CASE WHEN record_id % 5 = 0 AND lead_idx = 4 THEN list_transform(s, lambda v: v * 0) ELSE s END AS s FROM a WHERE NOT (record_id % 3 = 0 AND lead_idx = 9) UNION ALL SELECT record_id, 9, s FROM a WHERE record_id % 3 = 0 AND lead_idx = 2),
f AS (SELECT *, list_max(s) - list_min(s) <= 1e-6 AS flat FROM k), g AS (SELECT *, bool_or(flat AND lead_idx < 6) OVER (PARTITION BY record_id) AS limb_flat FROM f),
p AS (SELECT b.record_id, b.lead_idx, e.lead_idx AS earlier, list_max(list_transform(range(1, len(b.s) + 1), lambda i: abs(e.s[i] - b.s[i]))) AS distance FROM g b JOIN g e ON b.record_id = e.record_id AND e.lead_idx < b.lead_idx AND NOT b.flat AND NOT e.flat AND NOT (b.limb_flat AND b.lead_idx < 6 AND e.lead_idx < 6)),
n AS (SELECT *, row_number() OVER (PARTITION BY record_id, lead_idx ORDER BY distance, earlier) AS r FROM p) SELECT record_id, lead_idx, earlier, round(distance, 5) AS distance FROM n WHERE r = 1 AND distance <= 0.25"""),
    "q12_perturbation_report": _wave_sql(f"""{_MASK}, d AS (SELECT record_id, lead_idx, list_transform(range(1, len(s) + 1), lambda i: x[i] - s[i]) AS d, len(s) AS n FROM w), l AS (SELECT record_id, lead_idx, n, list_sum(list_transform(d, lambda v: v * v)) AS q, list_max(list_transform(d, lambda v: abs(v))) AS m, len(list_filter(d, lambda v: abs(v) > 1e-9)) AS c,
  list_max(list_transform(range(1, len(d)), lambda i: abs(d[i + 1] - d[i]))) AS step FROM d), t AS (SELECT record_id, sqrt(sum(q) / sum(n)) AS rms, max(m) AS largest, sum(c) / sum(n) AS changed, max(step) AS step, arg_max(lead_idx, (sqrt(q / n), -lead_idx)) AS worst_lead FROM l GROUP BY 1),
{', '.join(f"{v} AS (SELECT record_id, CASE WHEN l0 IS NOT NULL AND l1 IS NOT NULL AND l2 IS NOT NULL AND l3 IS NOT NULL AND l4 IS NOT NULL AND l5 IS NOT NULL THEN sqrt(list_avg(list_transform(range(1, len(l0) + 1), lambda i: ((l0[i] + l2[i] - l1[i]) ** 2 + (l3[i] + (l0[i] + l1[i]) / 2) ** 2 + (l4[i] - (l0[i] - l1[i] / 2)) ** 2 + (l5[i] - (l1[i] - l0[i] / 2)) ** 2) / 4))) / sqrt(list_avg(list_transform(list_concat(l0, l1, l2, l3, l4, l5), lambda v: v * v))) END AS r FROM (SELECT record_id, " + ', '.join(f"max({col}) FILTER (WHERE lead_idx = {i}) AS l{i}" for i in range(6)) + " FROM w GROUP BY 1))" for v, col in (('r0', 's'), ('r1', 'x')))},
z AS (SELECT t.*, abs(r1.r - r0.r) AS limb, record_id % 10 < 9 AS whole FROM t JOIN r0 USING (record_id) JOIN r1 USING (record_id))
SELECT record_id, CASE WHEN whole THEN round(rms, 5) END AS rms, CASE WHEN whole THEN round(largest, 5) END AS largest, CASE WHEN whole THEN round(changed, 5) END AS changed, CASE WHEN whole THEN round(step, 5) END AS step, CASE WHEN whole THEN round(limb, 5) END AS limb, CASE WHEN whole THEN worst_lead END AS worst_lead,
CASE WHEN NOT whole THEN 'unmatched' ELSE array_to_string(list_filter([CASE WHEN rms > 0.05 THEN 'rms' END, CASE WHEN changed > 0.1 THEN 'changed' END, CASE WHEN step > 0.2 THEN 'step' END, CASE WHEN limb > 0.01 THEN 'limb' END], lambda r: r IS NOT NULL), ',') END AS reasons FROM z"""),
    "m6_fit_by_class": with_fixtures(["pred"], f"WITH s AS (SELECT label, target, {_NC} AS nc, CASE WHEN target = 0 THEN 0.05 ELSE 0.2 END AS al FROM pred WHERE seed = 2026 AND fold = 9), r AS (SELECT *, row_number() OVER (PARTITION BY label, target ORDER BY nc) AS i, count(*) OVER (PARTITION BY label, target) AS n FROM s), k AS (SELECT *, CAST(ceil(round((n + 1) * (1 - al), 9)) AS BIGINT) AS k FROM r) SELECT label, target, n, k, round(coalesce(max(nc) FILTER (i = k), 1), 6) AS cutoff, k <= n AS attainable FROM k GROUP BY label, target, n, k"),
    "m7_trivial_groups": with_fixtures(["pred", "subgroups"], f"WITH g AS (SELECT label, cell, count(*) AS n FROM {_cells(9)} GROUP BY ALL) SELECT label, cell, n FROM g WHERE ceil(round((n + 1) * 0.9, 9)) > n"),
    "m7_unknown_groups": with_fixtures(["pred", "subgroups"], f"WITH k AS (SELECT DISTINCT label, cell FROM {_cells(9)} WHERE record_id % 40 < 35), p AS (SELECT label, cell, count(*) AS n FROM {_cells(10)} GROUP BY ALL) SELECT label, cell, n FROM p WHERE (label, cell) NOT IN (SELECT (label, cell) FROM k)"),
    "s13_value_at_epoch": "WITH h AS (SELECT user_id AS run, event_id % 100 AS epoch, max(value) AS value FROM events GROUP BY ALL) SELECT run, max(epoch) AS epoch, round(arg_max(value, epoch), 6) AS value FROM h WHERE epoch <= 60 GROUP BY run",
    "w9_counterbalanced_order": """WITH f AS (SELECT c_custkey AS participant, (row_number() OVER (ORDER BY sha256('k|' || CAST(c_custkey AS VARCHAR)), c_custkey) - 1) % 2 AS first FROM customer),
a AS (SELECT participant, arm, CAST((i - first + 2) % 2 + 1 AS INTEGER) AS arm_place FROM f, (VALUES (0, 'guided'), (1, 'plain')) t(i, arm))
SELECT participant, arm, arm_place, n_nationkey AS case_id, CAST(row_number() OVER (PARTITION BY participant, arm ORDER BY sha256('k|' || CAST(participant AS VARCHAR) || '|' || arm || '|' || CAST(n_nationkey AS VARCHAR)), n_nationkey) AS INTEGER) AS ordinal FROM a, nation""",
}
