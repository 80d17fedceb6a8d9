"""Queries of review panels, reader studies and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.operators import panels as p
from evalspark.plans.scratch import table
from evalspark.queries.metrics import rounded


def _reviews(spark, d):
    q = F.col("l_quantity").cast("long")
    return table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("proposal"), F.col("l_suppkey").alias("reviewer"), (q % 5 + 1).alias("rating"),
        (q % 3 > 0).cast("int").alias("useful"), (F.col("l_linenumber") % 4 == 0).cast("int").alias("artifact"),
    )


def a28_panel_summary(spark, d):
    return rounded(p.panel_summary(_reviews(spark, d), 5, 10, 100, 5, 0.6))


def a28_repeated_reviews(spark, d):
    return p.repeated_reviews(_reviews(spark, d))


def a29_arm_summary(spark, d):
    q = F.col("l_quantity")
    answers = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("participant"), F.col("l_linestatus").alias("arm"), (q > 20).cast("int").alias("correct"),
        F.col("l_extendedprice").cast("double").alias("time_ms"), (F.col("l_discount") * 10).cast("double").alias("confidence"),
        (F.col("l_linenumber") < 4).alias("comprehended"), (q > 40).alias("blocked"), (F.col("l_linenumber") % 2 == 0).alias("relied"),
    )
    return rounded(p.arm_summary(answers, 5), 4)


def w10_chain_faults(spark, d):
    """A log over events, some of its entries broken, dropped or repeated."""
    i = F.col("event_id")
    said = lambda c: F.sha2(F.concat(F.lit("entry "), c.cast("string")), 256)
    previous = F.when(i == 0, "").when(i % 777 == 5, "broken").otherwise(said(i - 1))
    rows = table(spark, d, "events").where("event_id % 500 <> 250").select(i.alias("sequence"), previous.alias("previous_entry_hash"), F.col("event_type").alias("content"))
    # every second hash is the entry's own, the others are of another form
    kept = F.when(F.col("sequence") % 2 == 0, p.entry_hash(F.col("previous_entry_hash"), F.col("content"))).otherwise(said(F.col("sequence")))
    log = rows.withColumn("entry_hash", kept)
    return p.chain_faults(log.unionByName(log.where("sequence % 400 = 399")), F.col("content"), (7, "none"))


QUERIES = {f.__name__: f for f in (a28_panel_summary, a28_repeated_reviews, a29_arm_summary, w10_chain_faults)}

_REVIEWS = "rv AS (SELECT l_partkey AS proposal, l_suppkey AS reviewer, CAST(l_quantity AS BIGINT) % 5 + 1 AS rating, CASE WHEN CAST(l_quantity AS BIGINT) % 3 > 0 THEN 1 ELSE 0 END AS useful, CASE WHEN l_linenumber % 4 = 0 THEN 1 ELSE 0 END AS artifact FROM lineitem)"

ORACLE_SQL = {
    "a28_panel_summary": f"""WITH {_REVIEWS}, el AS (SELECT *, row_number() OVER () AS id FROM rv WHERE proposal IN (SELECT proposal FROM rv GROUP BY 1 HAVING count(*) >= 5)),
pr AS (SELECT count(*) AS pairs, avg(CASE WHEN a.useful = b.useful THEN 1.0 ELSE 0.0 END) AS agreement, avg(abs(a.rating - b.rating)) AS distance FROM el a JOIN el b ON a.proposal = b.proposal AND a.id < b.id),
ag AS (SELECT count(*) AS n, count(DISTINCT proposal) AS proposals, count(DISTINCT reviewer) AS reviewers, avg(rating) AS mean, median(rating) AS med, stddev_pop(rating) AS sd, avg(artifact) AS art, avg(useful) AS u FROM el)
SELECT CASE WHEN proposals >= 10 AND n >= 100 AND reviewers >= 5 AND u >= 0.6 THEN 'threshold_met' WHEN proposals >= 10 AND n >= 100 AND reviewers >= 5 THEN 'descriptive_only' ELSE 'insufficient' END AS status, (SELECT count(*) FROM rv) AS total_reviews, n AS eligible_reviews, proposals AS eligible_proposals, reviewers AS unique_reviewers,
round(mean, 6) AS mean_rating, med AS median_rating, round(sd, 6) AS rating_sd, round(art, 6) AS artifact_rate, round(u, 6) AS useful_rate, round(agreement, 6) AS agreement, round((agreement - (u * u + (1 - u) * (1 - u))) / (1 - (u * u + (1 - u) * (1 - u))), 6) AS kappa, round(distance, 6) AS rating_distance FROM ag, pr""",
    "a28_repeated_reviews": f"WITH {_REVIEWS} SELECT proposal, reviewer, count(*) AS n FROM rv GROUP BY ALL HAVING count(*) > 1",
    "a29_arm_summary": """WITH a AS (SELECT l_suppkey AS participant, l_linestatus AS arm, CASE WHEN l_quantity > 20 THEN 1.0 ELSE 0.0 END AS correct, CAST(l_extendedprice AS DOUBLE) AS time_ms, CAST(l_discount * 10 AS DOUBLE) AS c, l_linenumber < 4 AS comprehended, l_quantity > 40 AS blocked, l_linenumber % 2 = 0 AS relied FROM lineitem),
e AS (SELECT arm, sum(gap) / sum(n) AS ece FROM (SELECT arm, least(floor(c * 10), 9) AS bin, count(*) AS n, abs(sum(c - correct)) AS gap FROM a GROUP BY ALL) GROUP BY arm)
SELECT arm, count(DISTINCT participant) AS participants, round(avg(correct), 4) AS accuracy, round(avg(CAST(comprehended AS INT)), 4) AS comprehension, round(avg(CAST(relied AS INT)) FILTER (blocked), 4) AS over_reliance, round(avg(time_ms), 4) AS mean_time, round(median(time_ms), 4) AS median_time, round(avg((c - correct) ** 2), 4) AS confidence_brier, round(max(ece), 4) AS confidence_ece FROM a JOIN e USING (arm) GROUP BY arm""",
    "w10_chain_faults": """WITH r AS (SELECT event_id AS s, event_type AS content, CASE WHEN event_id = 0 THEN '' WHEN event_id % 777 = 5 THEN 'broken' ELSE sha256('entry ' || (event_id - 1)) END AS p FROM events WHERE event_id % 500 <> 250),
o AS (SELECT *, sha256(p || '|' || content) AS own FROM r), l AS (SELECT *, CASE WHEN s % 2 = 0 THEN own ELSE sha256('entry ' || s) END AS h FROM o), d AS (SELECT * FROM l UNION ALL SELECT * FROM l WHERE s % 400 = 399),
m AS (SELECT d.*, b.h AS before, (SELECT min(s) FROM l) AS first FROM d LEFT JOIN l b ON b.s + 1 = d.s)
SELECT s AS sequence, 'self' AS fault FROM m WHERE h <> own UNION ALL SELECT s, 'gap' FROM m WHERE s <> first AND before IS NULL UNION ALL SELECT s, 'genesis' FROM m WHERE s = first AND p <> '' UNION ALL SELECT s, 'hash' FROM m WHERE before IS NOT NULL AND p <> before
UNION ALL SELECT s, 'repeated' FROM d GROUP BY s HAVING count(*) > 1 UNION ALL SELECT max(s), 'head' FROM d""",
}
