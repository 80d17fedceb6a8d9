"""Queries of cohorts with an index for each patient, follow-up fractions and reasons in telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.operators import longitudinal as lo
from evalspark.plans.fixtures import fixture, with_fixtures
from evalspark.plans.scratch import table
from evalspark.queries.metrics import rounded
from evalspark.queries.series import _OBS, _obs
from evalspark.streaming import telemetry as t


def _cohort(spark, d, policy):
    enc = fixture(spark, d, "encounters").withColumn("observed_through", F.greatest("observed_through", F.expr("max(occurred_at) over (partition by patient_id)") - F.expr("make_dt_interval(int(patient_id % 4))")))
    day = F.expr("make_dt_interval(int(patient_id % 5))")
    index = enc.select("patient_id").distinct().withColumn("index_at", F.lit("2024-01-12 00:00:00").cast("timestamp") + day)
    return lo.build_cohort(enc, index, 8, 10, 6, policy)


def l1_build_cohort(spark, d):
    rows = _cohort(spark, d, "exclude_below_minimum")
    return rows.select("patient_id", F.size("history").alias("n_history"), F.size("future").alias("n_future"), "last_history_at", "follow_up", "excluded")


def l1_cohort_summary(spark, d):
    return lo.cohort_summary(_cohort(spark, d, "require_complete_horizon"))


def l6_follow_up_fractions(spark, d):
    return rounded(lo.follow_up_fractions(_obs(spark, d), 12, 3))


def _events(spark, d):
    kind, big = F.col("event_type"), F.when(F.col("value") > 100, "large")
    return table(spark, d, "events").select("ts", F.array_compact(F.array(kind, big)).alias("reasons"))


def t1_reason_counts(spark, d):
    return t.reason_counts(_events(spark, d), "1 day")


def t3_reason_deltas(spark, d):
    events = _events(spark, d)
    totals = events.groupBy(F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("total")).select(F.col("w.start").alias("start"), "total")
    every = events.agg(F.count(F.lit(1)).alias("all"))
    # one row beside a few reasons
    reference = events.select(F.explode("reasons").alias("reason")).where("reason <> 'click'").groupBy("reason").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(every), F.col("n") > 0)
    return rounded(t.reason_deltas(t.reason_counts(events, "1 day"), totals, reference.select("reason", (F.col("n") / F.col("all")).alias("rate"))))


def t4_order_faults(spark, d):
    rows = table(spark, d, "events").select((F.col("user_id") % 20).alias("series"), F.col("event_id").alias("arrival"), F.to_date("ts").alias("day"))
    return t.order_faults(rows.withColumn("day", F.col("day").cast("string")), ["series"], "day")


_FUNCTIONS = (l1_build_cohort, l1_cohort_summary, l6_follow_up_fractions, t1_reason_counts, t3_reason_deltas, t4_order_faults)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_EVENTS = "e AS (SELECT ts, list_filter([event_type, CASE WHEN value > 100 THEN 'large' END], lambda r: r IS NOT NULL) AS reasons FROM events), x AS (SELECT date_trunc('day', ts) AS start, unnest(reasons) AS reason FROM e)"


def _cohort_sql(strict: str) -> str:
    return f"""en AS (SELECT *, greatest(observed_through, max(occurred_at) OVER (PARTITION BY patient_id) - to_days(CAST(patient_id % 4 AS INTEGER))) AS ob FROM encounters), ix AS (SELECT *, TIMESTAMP '2024-01-12 00:00:00' + to_days(CAST(patient_id % 5 AS INTEGER)) AS index_at FROM en),
gr AS (SELECT patient_id, count(*) FILTER (occurred_at BETWEEN index_at - INTERVAL 8 DAY AND index_at) AS n_history, count(*) FILTER (occurred_at > index_at AND occurred_at <= index_at + INTERVAL 10 DAY) AS n_future, max(occurred_at) FILTER (occurred_at BETWEEN index_at - INTERVAL 8 DAY AND index_at) AS last_history_at, max(occurred_at) AS latest, max(ob) AS ob, max(index_at) AS index_at FROM ix GROUP BY 1),
st AS (SELECT *, CASE WHEN ob >= index_at + INTERVAL 10 DAY THEN 'complete' WHEN ob >= index_at + INTERVAL 6 DAY THEN 'right_censored' ELSE 'insufficient' END AS follow_up FROM gr),
co AS (SELECT *, CASE WHEN ob < latest THEN 'observation_ends_early' WHEN n_history = 0 THEN 'no_history' WHEN {strict} THEN 'censoring' END AS excluded FROM st)"""


ORACLE_SQL = {
    "l1_build_cohort": with_fixtures(["encounters"], "WITH " + _cohort_sql("follow_up = 'insufficient'") + " SELECT patient_id, CAST(n_history AS INTEGER) AS n_history, CAST(n_future AS INTEGER) AS n_future, last_history_at, follow_up, excluded FROM co"),
    "l1_cohort_summary": with_fixtures(["encounters"], "WITH " + _cohort_sql("follow_up <> 'complete'") + " SELECT count(*) AS patients, count(*) FILTER (excluded IS NULL) AS included, " + ", ".join(f"count(*) FILTER (excluded = '{r}') AS excluded_{r}" for r in ("no_history", "censoring", "observation_ends_early")) + ", " + ", ".join(f"count(*) FILTER (excluded IS NULL AND follow_up = '{s}') AS {s}" for s in ("complete", "right_censored", "insufficient")) + " FROM co"),
    "l6_follow_up_fractions": with_fixtures(["encounters"], f"""WITH {_OBS}, cc AS (SELECT CAST(len(list_filter(range(1, 12), lambda k: CAST(k AS DOUBLE) / 12 <= risk)) AS INTEGER) AS bin, count(*) FILTER (target_status = 'observed') AS o, count(*) FILTER (target_status = 'censored') AS c, count(*) FILTER (target_status = 'insufficient') AS i FROM ob GROUP BY 1),
dm AS (SELECT CAST(unnest(range(12)) AS INTEGER) AS bin), mm AS (SELECT dm.bin, coalesce(o, 0) AS o, coalesce(c, 0) AS c, coalesce(i, 0) AS i FROM dm LEFT JOIN cc USING (bin)), ss AS (SELECT *, o + c + i AS t, (o BETWEEN 1 AND 2) OR (c BETWEEN 1 AND 2) OR (i BETWEEN 1 AND 2) AS hidden FROM mm)
SELECT bin, CASE WHEN NOT hidden THEN o END AS observed, CASE WHEN NOT hidden THEN c END AS censored, CASE WHEN NOT hidden THEN i END AS insufficient, CASE WHEN NOT hidden AND t > 0 THEN round(o / t, 6) END AS observed_fraction, CASE WHEN NOT hidden AND t > 0 THEN round(c / t, 6) END AS censored_fraction, CASE WHEN NOT hidden AND t > 0 THEN round(i / t, 6) END AS insufficient_fraction, CASE WHEN hidden THEN 'suppressed' WHEN t = 0 THEN 'empty' ELSE 'reported' END AS status FROM ss"""),
    "t1_reason_counts": f"WITH {_EVENTS} SELECT start, reason, count(*) AS n FROM x GROUP BY ALL",
    "t3_reason_deltas": f"WITH {_EVENTS}, tt AS (SELECT date_trunc('day', ts) AS start, count(*) AS total FROM e GROUP BY 1), rf AS (SELECT reason, count(*) / (SELECT count(*) FROM e) AS rate FROM x WHERE reason <> 'click' GROUP BY 1), ct AS (SELECT start, reason, count(*) AS n FROM x GROUP BY ALL), kn AS (SELECT DISTINCT reason FROM x) SELECT tt.start, kn.reason, round(coalesce(n, 0) / total - coalesce(rate, 0), 6) + 0.0 AS delta FROM tt CROSS JOIN kn LEFT JOIN ct ON ct.start = tt.start AND ct.reason = kn.reason LEFT JOIN rf ON rf.reason = kn.reason",
    "t4_order_faults": "WITH r AS (SELECT user_id % 20 AS series, event_id AS arrival, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events), l AS (SELECT *, lag(day) OVER (PARTITION BY series ORDER BY arrival) AS before FROM r) SELECT series, arrival, day, before FROM l WHERE before >= day",
}
