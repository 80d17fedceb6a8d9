"""Evaluation tables derived from the given ones, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evalspark.plans.scratch import table

SEEDS = (2026, 2027, 2028)

FIXTURES: dict[str, tuple[tuple[str, ...], str]] = {
    "labels_dim": (("orders",), "SELECT DISTINCT o_orderpriority AS label, CAST(substr(o_orderpriority, 1, 1) AS INT) AS li FROM orders"),
    "pred": (
        ("orders",),
        """SELECT record_id, patient_id, fold, model_id, seed, label, li, target, prob, ln(prob / (1 - prob)) AS logit FROM (
  SELECT o_orderkey AS record_id, o_custkey AS patient_id, CAST(o_custkey % 10 + 1 AS INT) AS fold, concat('m', CAST(s.seed AS STRING)) AS model_id, s.seed, l.label, l.li,
    CASE WHEN o_orderpriority = l.label THEN 1 ELSE 0 END AS target,
    CAST(round(least(0.999, greatest(0.001, 0.35 * (CASE WHEN o_orderpriority = l.label THEN 1 ELSE 0 END)
      + 0.65 * (((o_orderkey * 7919 + l.li * 104729 + s.seed) % 10007) / 10007.0))), 3) AS DOUBLE) AS prob
  FROM orders CROSS JOIN (SELECT DISTINCT o_orderpriority AS label, CAST(substr(o_orderpriority, 1, 1) AS INT) AS li FROM orders) l
  CROSS JOIN (SELECT * FROM (VALUES (2026), (2027), (2028)) AS t(seed)) s) x""",
    ),
    "subgroups": (
        ("orders", "customer"),
        """SELECT o_orderkey AS record_id, a.attribute, CASE WHEN a.attribute = 'status' THEN CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderstatus END ELSE c_mktsegment END AS group_value
  FROM orders JOIN customer ON o_custkey = c_custkey CROSS JOIN (SELECT * FROM (VALUES ('status'), ('segment')) AS t(attribute)) a""",
    ),
    "binary_events": (("orders",), "SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'source' ELSE 'external' END AS cohort, o_custkey AS cluster_id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS event FROM orders"),
    "encounters": (
        ("events",),
        """SELECT user_id AS patient_id, event_id AS encounter_id, ts AS occurred_at, event_type AS event_label, value,
    CASE user_id % 3 WHEN 0 THEN CAST('2024-02-10 00:00:00' AS TIMESTAMP) WHEN 1 THEN CAST('2024-01-22 00:00:00' AS TIMESTAMP) ELSE CAST('2024-01-16 00:00:00' AS TIMESTAMP) END AS observed_through
  FROM events""",
    ),
    "telemetry": (
        ("events",),
        """SELECT event_id, ts, concat('r', CAST(user_id % 4 AS STRING)) AS release_id,
    CASE event_type WHEN 'view' THEN 'ACCEPT' WHEN 'click' THEN 'REVIEW' WHEN 'purchase' THEN 'ABSTAIN' WHEN 'signup' THEN 'REACQUIRE' ELSE 'INVALID' END AS decision,
    least(value / 500.0, 1.0) AS score FROM events""",
    ),
    "wave": (
        ("embeddings",),
        """SELECT CAST(floor(vec_id / 12.0) AS BIGINT) AS record_id, CAST(vec_id % 12 AS INT) AS lead_idx, concat('L', CAST(vec_id % 12 AS STRING)) AS lead_name, 100.0 AS fs, embedding AS samples FROM embeddings""",
    ),
    "manifest": (
        ("documents",),
        """SELECT doc_id AS record_id, CAST(doc_id % 997 AS BIGINT) AS patient_id, CAST(doc_id % 997 % 10 + 1 AS INT) AS fold, source AS site, lang AS dataset,
    CASE WHEN doc_id % 11 = 0 THEN 300 ELSE CAST(18 + doc_id * 7 % 83 AS INT) END AS age, CAST(CASE WHEN doc_id % 13 = 0 THEN 9 ELSE doc_id % 2 END AS INT) AS sex,
    concat('{', '''C', CAST(doc_id % 5 AS STRING), ''': ', CAST(doc_id % 100 AS STRING), '.0, ''C', CAST(5 + doc_id % 3 AS STRING), ''': 50.0}') AS scp_codes,
    concat('rec/', CAST(doc_id % 10 AS STRING), '/', CAST(doc_id AS STRING)) AS record_path, CAST(10 + doc_id % 3 AS INT) AS n_samples,
    concat(CAST(doc_id % 7 + 1 AS STRING), '+2', CAST(doc_id % 3 AS STRING), '0;', CAST(501 + doc_id % 4 AS STRING)) AS code_string FROM documents""",
    ),
}


def fixture_sql(name: str) -> str:
    """The fixture for DuckDB."""
    return FIXTURES[name][1].replace(" AS STRING)", " AS VARCHAR)")


def with_fixtures(names: list[str], body: str) -> str:
    """DuckDB SQL: ``body`` with the named fixtures as common table expressions."""
    ctes = ",\n".join(f"{n} AS ({fixture_sql(n)})" for n in names)
    rest = body.strip()
    return f"WITH {ctes},\n{rest[5:]}" if rest.upper().startswith("WITH ") else f"WITH {ctes}\n{rest}"


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables, sql = FIXTURES[name]
    for t in tables:
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(sql)
