"""Telemetry windows against a frozen reference, by one severity model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.plans.scratch import table
from evalspark.streaming import alerts as al
from evalspark.streaming.telemetry import STATES

LIMITS = al.Limits(least_reference=100, least_window=20, least_scores=15)


def monitored_events(spark, d) -> DataFrame:
    """Events with a decision, up to two reasons, and a score for most; after 20 January one reason becomes frequent."""
    kinds = {"view": "ACCEPT", "click": "REVIEW", "purchase": "ABSTAIN", "signup": "REACQUIRE"}
    decision = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in kinds.items()], F.lit("INVALID"))
    late = F.col("ts") >= F.lit("2024-01-20").cast("timestamp")
    reasons = F.array_compact(F.array(F.when(F.col("value") > 100, "large"), F.when(late & (F.col("event_id") % 3 == 0), "clipped")))
    return table(spark, d, "events").select("event_id", "ts", decision.alias("decision"), reasons.alias("reasons"), F.when(F.col("event_id") % 7 != 0, F.least(F.col("value") / 500.0, F.lit(1.0))).alias("score"))


def _compared(spark, d):
    events = monitored_events(spark, d)
    reference = al.profile(events.where(F.col("ts") < F.lit("2024-01-08").cast("timestamp")), LIMITS)
    return al.compare_profiles(al.window_profiles(events, "1 day", LIMITS), reference, LIMITS)


def t3_window_severity(spark, d):
    return _compared(spark, d).select("start", "total", "status", "severity", "action", F.array_join("evidence", ",").alias("evidence"))


def t3_window_comparisons(spark, d):
    rows = _compared(spark, d).select("start", F.inline("comparisons"))
    return rows.withColumn("value", F.round("value", 6))


QUERIES = {f.__name__: f for f in (t3_window_severity, t3_window_comparisons)}

_BINS = range(LIMITS.bins)
_LADDER = lambda v, steps: f"CASE WHEN round({v}, 9) >= {steps[0]} THEN 1 + " + " + ".join(f"CASE WHEN round({v}, 9) >= {s} THEN 1 ELSE 0 END" for s in steps) + " ELSE 0 END"
_RAISED = lambda r, k: f"({r}.b{k} + {LIMITS.smoothing!r}) / ({r}.scored + {LIMITS.smoothing * LIMITS.bins!r})"
_PSI = " + ".join(f"({_RAISED('w', k)} - {_RAISED('r', k)}) * (ln({_RAISED('w', k)}) - ln({_RAISED('r', k)}))" for k in _BINS)
_COMPARED = f"""WITH e AS (SELECT ts, date_trunc('day', ts) AS start, CASE event_type WHEN 'view' THEN 'ACCEPT' WHEN 'click' THEN 'REVIEW' WHEN 'purchase' THEN 'ABSTAIN' WHEN 'signup' THEN 'REACQUIRE' ELSE 'INVALID' END AS decision,
  list_filter([CASE WHEN value > 100 THEN 'large' END, CASE WHEN ts >= TIMESTAMP '2024-01-20' AND event_id % 3 = 0 THEN 'clipped' END], lambda x: x IS NOT NULL) AS reasons, CASE WHEN event_id % 7 <> 0 THEN least(floor(least(value / 500.0, 1.0) * {LIMITS.bins}), {LIMITS.bins - 1}) END AS bin FROM events),
k AS (SELECT start, ts, 'state' AS family, decision AS key FROM e UNION ALL SELECT start, ts, 'reason', unnest(reasons) FROM e),
r AS (SELECT count(*) AS total, count(bin) AS scored, {", ".join(f"count(*) FILTER (bin = {k}) AS b{k}" for k in _BINS)} FROM e WHERE ts < TIMESTAMP '2024-01-08'),
w AS (SELECT start, count(*) AS total, count(bin) AS scored, {", ".join(f"count(*) FILTER (bin = {k}) AS b{k}" for k in _BINS)} FROM e GROUP BY start),
rk AS (SELECT family, key, count(*) AS n FROM k WHERE ts < TIMESTAMP '2024-01-08' GROUP BY ALL), wk AS (SELECT start, family, key, count(*) AS n FROM k GROUP BY ALL),
keys AS (SELECT start, 'state' AS family, unnest({list(STATES)!r}) AS key FROM w UNION SELECT start, family, key FROM wk UNION SELECT start, family, key FROM w, rk),
ok AS (SELECT w.start, w.total >= {LIMITS.least_window} AND r.total >= {LIMITS.least_reference} AS rates, w.total >= {LIMITS.least_window} AND r.total >= {LIMITS.least_reference} AND w.scored >= {LIMITS.least_scores} AND r.scored >= {LIMITS.least_scores} AS scores FROM w, r),
d AS (SELECT keys.*, coalesce(rk.n, 0) AS reference_count, coalesce(wk.n, 0) AS current_count, coalesce(wk.n, 0) / w.total - coalesce(coalesce(rk.n, 0) / nullif(r.total, 0), 0) AS delta FROM keys JOIN w USING (start) CROSS JOIN r LEFT JOIN rk USING (family, key) LEFT JOIN wk USING (start, family, key)),
f AS (SELECT *, greatest(CASE WHEN family = 'state' AND key = 'ACCEPT' THEN -delta ELSE delta END, 0.0) AS value FROM d),
c AS (SELECT start, family, key, reference_count, current_count, value, CASE WHEN rates THEN {_LADDER('value', LIMITS.rate)} ELSE 1 END AS rank FROM f JOIN ok USING (start) UNION ALL
  SELECT start, 'score', 'psi', r.scored, w.scored, CASE WHEN scores THEN {_PSI} END, CASE WHEN scores THEN {_LADDER('(' + _PSI + ')', LIMITS.psi)} ELSE 1 END FROM w JOIN ok USING (start) CROSS JOIN r),
n AS (SELECT {list(al.SEVERITY)!r} AS s, {list(al.ACTION)!r} AS a)"""

ORACLE_SQL = {
    "t3_window_comparisons": f"{_COMPARED} SELECT start, family, key, reference_count, current_count, round(value, 6) AS value, s[rank + 1] AS severity FROM c, n",
    "t3_window_severity": f"""{_COMPARED}, x AS (SELECT start, max(rank) AS rank FROM c GROUP BY start)
SELECT start, w.total, CASE WHEN rank >= 2 THEN 'alert' WHEN NOT rates THEN 'evidence_insufficient' WHEN NOT scores THEN 'partial_evidence' ELSE 'ok' END AS status, s[rank + 1] AS severity, a[rank + 1] AS action,
array_to_string(list_filter([CASE WHEN r.total < {LIMITS.least_reference} THEN 'reference_window_below_minimum' END, CASE WHEN w.total < {LIMITS.least_window} THEN 'current_window_below_minimum' END, CASE WHEN r.scored < {LIMITS.least_scores} THEN 'reference_score_histogram_below_minimum' END,
  CASE WHEN w.scored < {LIMITS.least_scores} THEN 'current_score_histogram_below_minimum' END], lambda v: v IS NOT NULL), ',') AS evidence FROM x JOIN w USING (start) JOIN ok USING (start), r, n""",
}
