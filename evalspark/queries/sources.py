"""Source and sink queries: tables are written by Spark from the given ones and read back strictly."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evalspark.functions.expressions import round_scaled
from evalspark.operators.joins import table_fingerprint
from evalspark.plans.fixtures import fixture, with_fixtures
from evalspark.plans.scratch import scratch_root, table
from evalspark.sources import publishing as pb
from evalspark.sources import tables as s
from evalspark.sources import waveforms as wf


def _path(spark, name: str) -> str:
    return f"{scratch_root(spark).rstrip('/')}/evalspark-{name}-{uuid.uuid4().hex}"


def s1_read_manifest(spark, d):
    path = _path(spark, "manifest")
    fixture(spark, d, "manifest").select("record_id", "fold", "site").write.option("header", True).csv(path)
    return s.read_manifest(spark, path, "record_id long, fold int, site string", "record_id")


def s2_read_label_free(spark, d):
    path = _path(spark, "pred")
    s.write_table(fixture(spark, d, "pred").where("seed = 2026"), path)
    return s.read_label_free(spark, path, ["record_id", "fold", "label"], 9).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


def s3_read_code_dictionary(spark, d):
    codes = table(spark, d, "part").select((F.col("p_partkey") % 600).cast("int").alias("code"), F.when(F.col("p_partkey") % 3 == 0, "modifier").otherwise("primary").alias("kind"))
    return s.read_code_dictionary(codes).distinct()


def s4_read_statement_map(spark, d):
    rows = table(spark, d, "part").select(F.concat(F.lit("C"), F.col("p_partkey").cast("string")).alias("code"), (F.col("p_partkey") % 2).cast("int").alias("diagnostic"), F.concat(F.lit("L"), (F.col("p_partkey") % 7).cast("string")).alias("label"))
    return s.read_statement_map(rows, ["L1", "L2", "L3"])


def s6_read_predictions(spark, d):
    wide = fixture(spark, d, "pred").where("seed = 2026").groupBy("record_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("li", "target", "logit"))), lambda x: x["target"]).alias("targets"), F.transform(F.array_sort(F.collect_list(F.struct("li", "target", "logit"))), lambda x: x["logit"]).alias("logits"))
    return s.long_predictions(wide, ["1", "2", "3", "4", "5"]).select("record_id", "label", "target", F.round("logit", 6).alias("logit"))


def s7_read_attributes(spark, d):
    path = _path(spark, "attributes")
    table(spark, d, "customer").select(F.col("c_custkey").alias("Patient ID"), F.col("c_mktsegment").alias("Segment")).write.option("header", True).option("sep", ";").csv(path)
    return s.read_attributes_csv(spark, path, {"patient_id": "Patient ID", "segment": "Segment"}, ";")


def s8_read_id_lists(spark, d):
    ids = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    paths = {n: _path(spark, n) for n in ("all", "good", "bad")}
    for name, cond in (("all", "true"), ("good", "k % 3 = 0"), ("bad", "k % 5 = 0")):
        ids.where(cond).select(F.concat(F.col("k").cast("string"), F.lit(" "))).unionByName(ids.limit(1).select(F.lit("# note").alias(ids.select(F.concat(F.col("k").cast("string"), F.lit(" "))).columns[0]))).write.text(paths[name])
    return s.classified_ids(*[s.read_list(spark, paths[n]) for n in ("all", "good", "bad")])


def s9_read_sha256sums(spark, d):
    path = _path(spark, "sums")
    rows = table(spark, d, "supplier").select(F.concat(F.sha2(F.col("s_name"), 256), F.lit("  ./f"), (F.col("s_suppkey") % 40).cast("string")))
    rows.write.text(path)
    return s.read_sha256sums(spark, path)


def s10_a31_event_log(spark, d):
    path = _path(spark, "log")
    ev = fixture(spark, d, "telemetry").select(F.col("event_id").alias("sequence"), F.col("event_id").cast("string").alias("event_id"), F.lit("score").alias("action"), F.lit("ok").alias("outcome"), "decision", F.array(F.when(F.col("score") > 0.5, "high").otherwise("low")).alias("reason_codes"))
    ev.write.json(path)
    return s.read_event_log(spark, path).select("decision", F.explode("reason_codes").alias("reason")).groupBy("decision", "reason").agg(F.count(F.lit(1)).alias("n"))


def s12_write_public_csv(spark, d):
    path = _path(spark, "public")
    s.write_public_csv(table(spark, d, "customer"), path, ["c_custkey", "c_acctbal"], 2)
    return spark.read.schema("c_custkey long, c_acctbal string").option("header", True).csv(path)


def s13_read_history(spark, d):
    path = _path(spark, "history")
    table(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("run"), (F.col("event_id") % 100).cast("int").alias("epoch"), F.col("value").alias("auroc")).write.json(path)
    return s.read_history(spark, path, "auroc")


def s14_verify_files(spark, d):
    """Of 12 files one kind in three is dropped from the list, changed in it, or listed though it isn't there."""
    path = _path(spark, "files")
    nations = table(spark, d, "nation").select("n_nationkey", "n_name")
    named = nations.select(F.concat(F.lit("f"), (F.col("n_nationkey") % 12).cast("string")).alias("name"), "n_name")
    named.groupBy("name").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ";").alias("line")).repartition("name").write.partitionBy("name").text(path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    folder = files.withColumn("path", F.element_at(F.split("path", "/"), -2))
    known = folder.select(F.col("path"), F.sha2("content", 256).alias("digest"), F.regexp_extract("path", r"(\d+)$", 1).cast("int").alias("k"))
    odd = known.where("k % 3 <> 0").withColumn("digest", F.when(F.col("k") % 3 == 1, F.reverse("digest")).otherwise(F.col("digest")))
    gone = known.where("k % 4 = 2").withColumn("path", F.concat("path", F.lit(".old")))
    return s.verify_files(odd.unionByName(gone), folder)


#: Rates, lengths and leads that a record of the fixture has to have.
_EXPECTED = wf.Expected(fs=100.0, n_samples=64, leads=tuple(f"L{i}" for i in range(12)))


def decode_lines(content: bytes) -> wf.Decoded:
    """A line for each lead: name, rate, samples."""
    lines = [line.split(",") for line in content.decode().splitlines()]
    return wf.Decoded([x[0] for x in lines], [[float(v) for v in x[2:]] for x in lines], float(lines[0][1]))


def s5_read_waveforms(spark, d):
    """A file for each record with leads in reverse order and lower case; some have another rate, a strange or a missing
    lead, a sample too few, or are no record at all."""
    path = _path(spark, "waves")
    k = F.col("record_id") % 9
    name = F.when((k == 2) & (F.col("lead_idx") == 5), "Z").otherwise(F.concat(F.lit(" "), F.lower("lead_name")))
    values = F.when((k == 3) & (F.col("lead_idx") == 1), F.slice("samples", 1, 63)).otherwise(F.col("samples"))
    line = F.concat_ws(",", name, F.when(k == 1, "50").otherwise("100"), F.array_join(F.transform(values, lambda v: v.cast("double").cast("string")), ","))
    waves = fixture(spark, d, "wave").where(~((k == 4) & (F.col("lead_idx") == 7)))
    text = waves.groupBy("record_id").agg(F.array_join(F.reverse(F.transform(F.array_sort(F.collect_list(F.struct("lead_idx", line.alias("line")))), lambda x: x["line"])), "\n").alias("text"))
    text.withColumn("text", F.when(F.col("record_id") % 9 == 5, "no record").otherwise(F.col("text"))).repartition("record_id").write.partitionBy("record_id").text(path)
    rows = wf.read_waveform_files(spark, path, decode_lines, _EXPECTED, ".txt", 16)
    record = F.regexp_extract("path", r"record_id=(\d+)", 1).cast("long").alias("record_id")
    return rows.select(record, "lead_idx", "lead_name", "problem", F.posexplode_outer("samples").alias("i", "value")).withColumn("value", round_scaled(F.col("value"), 6))


def s11_publish_table(spark, d):
    """What the writing tasks summed, and what the rows that are read back add up to."""
    path = _path(spark, "published")
    man = fixture(spark, d, "manifest").select("record_id", "fold", F.when(F.col("age") < 100, F.col("age")).alias("age"), "record_path")
    summary = pb.publish_table(man, path)
    back = table_fingerprint(pb.read_published(spark, path), ["record_id", "fold", "age", "record_path"])
    told = F.lit(summary["rows"]).cast("long").alias("rows"), F.lit(summary["fingerprint"]).alias("summed"), F.lit(summary["nulls"]["age"]).cast("long").alias("null_ages")
    faults = pb.published_faults(spark, path).agg(F.count(F.lit(1)).alias("faults"))
    return back.join(F.broadcast(faults), F.lit(True)).select("n", "fingerprint", *told, "faults")


QUERIES = {f.__name__: f for f in (s1_read_manifest, s2_read_label_free, s3_read_code_dictionary, s4_read_statement_map, s5_read_waveforms, s6_read_predictions, s7_read_attributes, s8_read_id_lists, s9_read_sha256sums, s10_a31_event_log, s11_publish_table, s12_write_public_csv, s13_read_history, s14_verify_files)}

ORACLE_SQL = {
    "s1_read_manifest": with_fixtures(["manifest"], "SELECT record_id, fold, site FROM manifest"),
    "s2_read_label_free": with_fixtures(["pred"], "SELECT fold, count(*) AS n FROM pred WHERE seed = 2026 AND fold <= 9 GROUP BY fold"),
    "s3_read_code_dictionary": "WITH c AS (SELECT CAST(p_partkey % 600 AS INTEGER) AS code, p_partkey % 3 = 0 AS m FROM part) SELECT DISTINCT code, 'category' AS problem FROM c WHERE m <> (code BETWEEN 200 AND 499) UNION ALL SELECT code, 'repeated' FROM c GROUP BY code HAVING count(*) > 1",
    "s4_read_statement_map": "SELECT 'C' || CAST(p_partkey AS VARCHAR) AS code, 'L' || CAST(p_partkey % 7 AS VARCHAR) AS label FROM part WHERE p_partkey % 2 = 1 AND p_partkey % 7 IN (1, 2, 3)",
    "s5_read_waveforms": with_fixtures(["wave"], """WITH g AS (SELECT record_id, count(*) AS n FROM wave GROUP BY 1), p AS (SELECT record_id, CASE record_id % 9 WHEN 1 THEN 'sampling_rate' WHEN 2 THEN CASE WHEN n > 5 THEN 'unexpected_lead Z' END WHEN 3 THEN CASE WHEN n > 1 THEN 'length' END
  WHEN 4 THEN 'missing_lead L7' WHEN 5 THEN 'undecodable IndexError' END AS q, CASE WHEN n < 12 THEN 'missing_lead L' || CAST(n AS VARCHAR) END AS short FROM g)
SELECT record_id, CAST(lead_idx AS INTEGER) AS lead_idx, lead_name, CAST(NULL AS VARCHAR) AS problem, CAST(i - 1 AS INTEGER) AS i, round(CAST(samples[i] AS DOUBLE), 6) AS value FROM wave JOIN p USING (record_id), range(1, 65) r(i) WHERE coalesce(q, short) IS NULL
UNION ALL SELECT record_id, NULL, NULL, coalesce(q, short), NULL, NULL FROM p WHERE coalesce(q, short) IS NOT NULL"""),
    "s11_publish_table": with_fixtures(["manifest"], """WITH m AS (SELECT record_id, fold, CASE WHEN age < 100 THEN age END AS age, record_path FROM manifest), h AS (SELECT age, CAST('0x' || substr(sha256(concat('{"record_id":"', record_id, '","fold":"', fold, '","age":', coalesce('"' || age || '"', 'null'), ',"record_path":"', record_path, '"}')), 1, 12) AS UBIGINT) AS x FROM m)
SELECT count(*) AS n, CAST(sum(x) AS VARCHAR) AS fingerprint, count(*) AS rows, CAST(sum(x) AS VARCHAR) AS summed, count(*) - count(age) AS null_ages, CAST(0 AS BIGINT) AS faults FROM h"""),
    "s14_verify_files": "WITH f AS (SELECT DISTINCT n_nationkey % 12 AS k FROM nation) SELECT 'name=f' || CAST(k AS VARCHAR) AS path, CASE WHEN k % 3 = 0 THEN 'extra' ELSE 'changed' END AS status FROM f WHERE k % 3 < 2 UNION ALL SELECT 'name=f' || CAST(k AS VARCHAR) || '.old', 'missing' FROM f WHERE k % 4 = 2",
    "s6_read_predictions": with_fixtures(["pred"], "SELECT record_id, CAST(li AS VARCHAR) AS label, target, round(logit, 6) AS logit FROM pred WHERE seed = 2026"),
    "s7_read_attributes": "SELECT CAST(c_custkey AS VARCHAR) AS patient_id, c_mktsegment AS segment FROM customer",
    "s8_read_id_lists": "SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 15 = 0 THEN 'conflicting' WHEN o_orderkey % 3 = 0 THEN 'acceptable' WHEN o_orderkey % 5 = 0 THEN 'unacceptable' ELSE 'indeterminate' END AS quality FROM orders",
    "s9_read_sha256sums": "SELECT 'f' || CAST(s_suppkey % 40 AS VARCHAR) AS path, min(sha256(s_name)) AS digest, count(DISTINCT s_name) AS n_digests FROM supplier GROUP BY 1",
    "s10_a31_event_log": with_fixtures(["telemetry"], "SELECT decision, CASE WHEN score > 0.5 THEN 'high' ELSE 'low' END AS reason, count(*) AS n FROM telemetry GROUP BY 1, 2"),
    "s12_write_public_csv": "SELECT c_custkey, printf('%.2f', c_acctbal) AS c_acctbal FROM customer",
    "s13_read_history": "WITH r AS (SELECT 'u' || CAST(user_id AS VARCHAR) AS run, CAST(event_id % 100 AS INTEGER) AS epoch, value FROM events) SELECT run, arg_max(epoch, (value, -epoch)) AS epoch, max(value) AS auroc FROM r GROUP BY run",
}
