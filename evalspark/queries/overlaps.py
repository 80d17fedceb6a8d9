"""Overlaps with pretraining data, problems of codes and dates, and the summary of an event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.functions.expressions import composite_code_problems
from evalspark.operators import overlaps as o
from evalspark.operators.checks import is_iso_date
from evalspark.operators.panels import event_log_summary
from evalspark.plans.fixtures import fixture, with_fixtures
from evalspark.plans.scratch import table

PRETRAIN = (("E-N", "v1"), ("web", "2024"), ("FR", "v9"))
DISCLOSED = (
    ("de", "v0", "web", "2024", "none_known"), ("de", "v0", "E-N", "v1", "none_known"), ("de", "v0", "FR", "v9", "none_known"), ("de", "v1", "web", "2024", "possible"),
    ("es", "v0", "web", "2024", "confirmed"), ("es", "v0", "web", "2024", "none_known"), ("en", "v1", "E-N", "v1", "none_known"), ("fr", "v0", "FR", "v9", "none_known"),
)


def _pairs(spark, d):
    local = fixture(spark, d, "manifest").select("dataset", F.concat(F.lit("v"), (F.col("record_id") % 2).cast("string")).alias("version"))
    disclosed = spark.createDataFrame(list(DISCLOSED), "dataset string, version string, pre_dataset string, pre_version string, status string")
    return o.overlap_pairs(local, spark.createDataFrame(list(PRETRAIN), "dataset string, version string"), disclosed)


def j10_overlap_levels(spark, d):
    return o.overlap_levels(_pairs(spark, d), ["dataset", "version"]).withColumn("reasons", F.array_join("reasons", ","))


def j10_overlap_plan(spark, d):
    return o.overlap_levels(_pairs(spark, d), []).withColumn("reasons", F.array_join("reasons", ","))


KNOWN_CODES = [*range(1, 8), *range(200, 221, 10), 501, 502]


def c2_code_problems(spark, d):
    """The manifest's codes, many of them with a code too many, twice, or none at all."""
    k, code = F.col("record_id") % 8, F.col("code_string")
    odd = F.when(k == 1, F.concat(code, F.lit("+210+210"))).when(k == 2, F.concat(code, F.lit(";"), code)).when(k == 3, F.lit("200")).when(k == 4, F.lit("1+x")).when(k == 5, F.lit(None).cast("string")).otherwise(code)
    rows = fixture(spark, d, "manifest").select("record_id", odd.alias("c"))
    return rows.select("record_id", F.array_join(composite_code_problems(F.col("c"), KNOWN_CODES), ",").alias("problems"))


def v8_iso_dates(spark, d):
    """Order dates, some of them without zeros, with a time, on a day that doesn't exist, or missing."""
    k, day = F.col("o_orderkey") % 7, F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(k == 1, F.concat(day, F.lit(" 00:00"))).when(k == 2, F.concat(F.substring(day, 1, 4), F.lit("-2-3"))).when(k == 3, F.concat(F.substring(day, 1, 5), F.lit("02-30"))).when(k == 4, F.lit(None).cast("string")).otherwise(day)
    return table(spark, d, "orders").select("o_orderkey", is_iso_date(text).alias("valid"))


KNOWN = {"action": ["score", "review", "export"], "actor_type": ["system", "human"], "outcome": ["ok", "failed"], "decision": ["ACCEPT", "REVIEW", "OTHER"]}


def a31_event_log_summary(spark, d):
    k = F.col("event_id")
    log = table(spark, d, "events").select(
        F.when(k % 3 == 0, "review").otherwise("score").alias("action"), F.when(k % 4 > 0, "system").alias("actor_type"), F.when(k % 11 == 0, "late").otherwise("ok").alias("outcome"),
        F.when(F.col("event_type") == "view", "ACCEPT").when(F.col("event_type") == "click", "REVIEW").alias("decision"), F.array_compact(F.array(F.when(F.col("value") > 100, "large"), F.when(k % 5 == 0, "fifth"))).alias("reason_codes"),
    )
    return event_log_summary(log, KNOWN)


QUERIES = {f.__name__: f for f in (j10_overlap_levels, j10_overlap_plan, c2_code_problems, v8_iso_dates, a31_event_log_summary)}

_ROWS = lambda rows: "(VALUES " + ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows) + ")"
_PAIRS = f"""WITH l AS (SELECT DISTINCT dataset, 'v' || CAST(record_id % 2 AS VARCHAR) AS version FROM manifest), p AS (SELECT * FROM {_ROWS(PRETRAIN)} t(pre_dataset, pre_version)),
d AS (SELECT dataset, version, pre_dataset, pre_version, arg_max(status, list_position(['none_known', 'possible', 'confirmed'], status)) AS status FROM {_ROWS(DISCLOSED)} t(dataset, version, pre_dataset, pre_version, status) GROUP BY ALL),
j AS (SELECT *, lower(regexp_replace(dataset, '[^a-zA-Z0-9]', '', 'g')) = lower(regexp_replace(pre_dataset, '[^a-zA-Z0-9]', '', 'g')) AS same FROM l CROSS JOIN p LEFT JOIN d USING (dataset, version, pre_dataset, pre_version)),
k AS (SELECT *, CASE WHEN same AND version = pre_version THEN 3 WHEN status = 'confirmed' THEN 3 WHEN same OR status = 'possible' THEN 2 WHEN status IS NULL THEN 1 ELSE 0 END AS level,
  CASE {" ".join(f"WHEN {test} THEN '{reason}'" for test, _, reason in o.RULES)} END AS reason FROM j),
e AS (SELECT dataset, version, level, unnest([reason, CASE WHEN same AND version = pre_version AND status = 'none_known' THEN '{o.OVERRIDDEN}' END]) AS reason FROM k)"""


def _levels(keys: str, group: str) -> str:
    named = lambda i: "[" + ", ".join(f"'{x[i]}'" for x in o.LEVELS) + "][max(level) + 1]"
    return f"""{_PAIRS} SELECT {keys}{named(0)} AS overlap, {named(1)} AS assessment, {named(2)} AS claim,
CASE WHEN max(level) = 0 THEN '{o.ALL_DISCLOSED}' ELSE string_agg(DISTINCT reason, ',' ORDER BY reason) END AS reasons FROM e {group}"""


ORACLE_SQL = {
    "j10_overlap_levels": with_fixtures(["manifest"], _levels("dataset, version, ", "GROUP BY dataset, version")),
    "j10_overlap_plan": with_fixtures(["manifest"], _levels("", "")),
    "c2_code_problems": with_fixtures(["manifest"], f"""WITH c AS (SELECT record_id, CASE record_id % 8 WHEN 1 THEN code_string || '+210+210' WHEN 2 THEN code_string || ';' || code_string WHEN 3 THEN '200' WHEN 4 THEN '1+x' WHEN 5 THEN NULL ELSE code_string END AS c FROM manifest),
s AS (SELECT record_id, i, list_transform(string_split(t, '+'), lambda x: TRY_CAST(x AS INTEGER)) AS codes FROM (SELECT record_id, unnest(string_split(c, ';')) AS t, generate_subscripts(string_split(c, ';'), 1) AS i FROM c)),
g AS (SELECT record_id, bool_or(len(list_filter(codes, lambda x: x IS NULL)) > 0) AS bad, bool_or(len(list_filter(codes, lambda x: x < 200 OR x >= 500)) <> 1) AS prim, bool_or(len(list_filter(codes, lambda x: x BETWEEN 200 AND 499)) <> len(list_distinct(list_filter(codes, lambda x: x BETWEEN 200 AND 499)))) AS rm,
  count(*) <> count(DISTINCT list_sort(codes)) AS rs, bool_or(len(list_filter(codes, lambda x: NOT list_contains({KNOWN_CODES}, x))) > 0) AS unk FROM s GROUP BY record_id)
SELECT record_id, CASE WHEN coalesce(bad, true) THEN 'no_number' ELSE array_to_string(list_filter([CASE WHEN prim THEN 'primary' END, CASE WHEN rm THEN 'repeated_modifier' END, CASE WHEN rs THEN 'repeated_statement' END, CASE WHEN unk THEN 'unknown_code' END], lambda x: x IS NOT NULL), ',') END AS problems FROM c LEFT JOIN g USING (record_id)"""),
    "v8_iso_dates": """WITH d AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders), t AS (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 1 THEN day || ' 00:00' WHEN 2 THEN substr(day, 1, 4) || '-2-3' WHEN 3 THEN substr(day, 1, 5) || '02-30' WHEN 4 THEN NULL ELSE day END AS text FROM d)
SELECT o_orderkey, coalesce(length(text) = 10 AND strftime(try_strptime(text, '%Y-%m-%d'), '%Y-%m-%d') = text, false) AS valid FROM t""",
    "a31_event_log_summary": f"""WITH l AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'review' ELSE 'score' END AS action, CASE WHEN event_id % 4 > 0 THEN 'system' END AS actor_type, CASE WHEN event_id % 11 = 0 THEN 'late' ELSE 'ok' END AS outcome, CASE event_type WHEN 'view' THEN 'ACCEPT' WHEN 'click' THEN 'REVIEW' END AS decision,
  list_filter([CASE WHEN value > 100 THEN 'large' END, CASE WHEN event_id % 5 = 0 THEN 'fifth' END], lambda r: r IS NOT NULL) AS reasons FROM events),
c AS (SELECT 'event' AS kind, NULL AS value, 1 AS n FROM l UNION ALL SELECT 'without_decision', NULL, 1 FROM l WHERE decision IS NULL {" ".join(f"UNION ALL SELECT '{k}', {k}, 1 FROM l WHERE {k} IS NOT NULL" for k in KNOWN)} UNION ALL SELECT 'reason_code', unnest(reasons), 1 FROM l
  UNION ALL SELECT * FROM (VALUES ('event', NULL, 0), ('without_decision', NULL, 0), {", ".join(f"('{k}', '{v}', 0)" for k, vs in KNOWN.items() for v in vs)}) z(kind, value, n)) SELECT kind, value, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY ALL""",
}
