"""Validation, projection, join and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.functions import expressions as x
from evalspark.operators import checks as c
from evalspark.operators import cohorts as co
from evalspark.operators import joins as j
from evalspark.operators import summaries as sm
from evalspark.plans.fixtures import fixture, with_fixtures
from evalspark.plans.scratch import table


def _man(spark, d):
    return fixture(spark, d, "manifest")


def _pred(spark, d, seed=2026):
    return fixture(spark, d, "pred").where(f"seed = {seed}")


def v1_check_unique(spark, d):
    return c.check_unique(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


def v2_check_one_role(spark, d):
    return c.check_one_role_per_entity(table(spark, d, "events"), "user_id", "event_type")


def v3_check_disjoint(spark, d):
    return c.check_one_role_per_entity(_man(spark, d).withColumn("role", x.split_for_fold(F.col("fold"))), "patient_id", "role")


def v4_check_values(spark, d):
    v = F.col("value")
    return c.check_values(table(spark, d, "events"), "event_id", {"finite": c.is_finite(v), "unit": v.between(0, 1), "whole": v == F.floor(v)})


def v5_check_expected_counts(spark, d):
    seen = table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    expected = spark.createDataFrame([("F", 1), ("X", 2)], "o_orderstatus string, n long")
    return c.check_expected_counts(seen, expected, "o_orderstatus", "n")


def v6_check_aligned(spark, d):
    a, b = _pred(spark, d).where("fold <= 9"), _pred(spark, d, 2027).where("fold >= 2 AND record_id % 5 <> 0")
    return c.check_aligned(a, b, ["record_id", "label"], ["patient_id", "target"])


def v7_check_relative_path(spark, d):
    path = F.when(F.col("record_id") % 7 == 0, F.concat(F.lit("/"), "record_path")).when(F.col("record_id") % 7 == 1, F.concat("record_path", F.lit("/../x"))).otherwise(F.col("record_path"))
    return c.check_values(_man(spark, d).withColumn("p", path), "record_id", {"relative_path": c.is_relative_path(F.col("p"))})


def v8_check_id_format(spark, d):
    rules = {"id": F.format_string("A%05d", "record_id").rlike(r"^A\d{5}$"), "age": F.col("age").between(18, 100), "sex": F.col("sex").isin(0, 1)}
    return c.check_values(_man(spark, d), "record_id", rules)


def v10_check_source_overlap(spark, d):
    return c.check_source_overlap(_man(spark, d), "site", ["src-7", "SRC_99"])


def v11_check_public_columns(spark, d):
    return c.check_public_columns(table(spark, d, "customer"), ["custkey", "customer#00000000"])


def _cohort(spark, d):
    mapped = F.size(x.parse_code_map(F.col("scp_codes")))
    i = F.col("record_id")
    return co.cohort_status(F.col("n_samples"), 10, mapped, F.when(i % 9 == 0, 1).otherwise(0), i % 8 == 0)


def f1_select_cohort(spark, d):
    mapped = F.size(x.parse_code_map(F.col("scp_codes")))
    return co.select_cohort(_man(spark, d), co.cohort_status(F.col("n_samples"), 10, mapped, None, None)).select("record_id", "fold")


def f1_cohort_exclusions(spark, d):
    return co.cohort_exclusions(_man(spark, d), _cohort(spark, d))


def _rules():
    return [("bad_length", F.col("n_samples") > 11), ("bad_sex", ~F.col("sex").isin(0, 1)), ("too_old", F.col("age") > 80), ("never", F.col("record_id") < 0)]


def f2_eligibility(spark, d):
    return c.eligibility_counts(_man(spark, d), _rules())


def f3_require_labeled(spark, d):
    positive = F.col("prob") >= 0.6
    kept = co.require_labeled(_pred(spark, d), "record_id", positive)
    return kept.groupBy("record_id").agg(F.count_if(positive).alias("n_labels"))


def c1_parse_code_map(spark, d):
    m = x.parse_code_map(F.col("scp_codes"))
    return _man(spark, d).select("record_id", F.array_join(F.map_keys(m), ",").alias("codes"), F.round(F.aggregate(F.map_values(m), F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


def c2_parse_composite_codes(spark, d):
    parts = x.parse_composite_codes(F.col("code_string"))
    return _man(spark, d).select("record_id", F.array_join(F.transform(parts, lambda s: s["primary_code"].cast("string")), ",").alias("primaries"), F.array_join(F.transform(parts, lambda s: F.array_join(s["modifiers"].cast("array<string>"), "+")), ",").alias("modifiers"))


def _dim(spark):
    return spark.createDataFrame([("C0", "NORM", "map"), ("C1", "MI", "map"), ("C2", "MI", "map"), ("C3", "CD", "map"), ("C5", "HYP", "map"), ("C6", "STTC", "exclude")], "code string, label string, action string")


def c3_map_codes(spark, d):
    rows = _man(spark, d).withColumn("codes", F.map_keys(x.parse_code_map(F.col("scp_codes"))))
    return j.map_codes_to_labels(rows, "record_id", "codes", _dim(spark))


def c5_c6_bands(spark, d):
    return _man(spark, d).select("record_id", x.split_for_fold(F.col("fold")).alias("split"), x.age_band(F.col("age")).alias("age_band"), x.sex_group(F.col("sex")).alias("sex_group"))


def c7_hash_split(spark, d):
    return _man(spark, d).select("record_id", x.hash_split(F.col("record_id"), "salt").alias("role"))


def c8_stateless_seed(spark, d):
    return _man(spark, d).select("record_id", x.stateless_seed(7, F.col("record_id"), "noise").alias("seed"))


def _by_label(spark, d, **values):
    """A table of parameters with a row for each label."""
    return fixture(spark, d, "labels_dim").select("label", *[F.lit(v).alias(k) for k, v in values.items()])


def c10_c16_maps(spark, d):
    p, rows = F.col("prob"), _pred(spark, d)
    rows = sm.apply_temperature(rows, _by_label(spark, d, temperature=1.7), ["label"]).withColumnRenamed("calibrated", "tempered")
    rows = sm.apply_sigmoid_scaling(rows, _by_label(spark, d, slope=1.2, intercept=-0.3), ["label"]).withColumnRenamed("calibrated", "scaled")
    rows = sm.decide(rows, _by_label(spark, d, threshold=0.5), ["label"])
    out = rows.select(
        "record_id", "label", "tempered", "scaled", x.logit(p).alias("logit"), x.symmetric_energy(F.col("logit"), 1.0).alias("energy"),
        x.adjust_to_prior(p, F.lit(0.2), F.lit(0.4)).alias("adjusted"), "decision",
    )
    return out.select(*[F.round(k, 6).alias(k) if t == "double" else F.col(k) for k, t in out.dtypes])


def c14_record_energy(spark, d):
    return sm.record_energy(_pred(spark, d), ["record_id"], 1.5).select("record_id", F.round("energy", 6).alias("energy"))


def a13_label_errors(spark, d):
    decided = sm.decide(_pred(spark, d), _by_label(spark, d, threshold=0.4), ["label"])
    return sm.label_errors(decided, [], "label").select("label", "n", F.round("error", 6).alias("error"))


def c15_threshold_proximity(spark, d):
    out = sm.threshold_proximity(_pred(spark, d), _by_label(spark, d, threshold=0.5), ["label"], ["record_id"])
    return out.select("record_id", F.round("proximity", 6).alias("proximity"))


def c18_trust_decision(spark, d):
    """Evidence from record ids, label decisions from the predictions: above 0.6 supported, below 0.4 not."""
    i, p = F.col("record_id"), F.col("prob")
    said = F.when(p >= 0.6, "SUPPORTED").when(p < 0.4, "NOT_SUPPORTED").otherwise("UNCERTAIN")
    label = F.element_at(F.array(*[F.lit(n) for n in _LABELS]), F.col("li").cast("int"))
    lists = _pred(spark, d).groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("li", label.alias("label"), said.alias("decision")))).alias("l"))
    lists = lists.select("record_id", F.transform("l", lambda x_: F.struct(x_["label"].alias("label"), x_["decision"].alias("decision"))).alias("decisions"))
    quality = F.when(i % 37 == 0, None).when(i % 7 == 0, "INVALID").when(i % 13 == 0, "LIMITED").otherwise("PASS")
    support, gate = F.when(i % 17 == 0, None).otherwise(i % 11 != 0), F.when(i % 23 == 0, None).otherwise(i % 5 != 0)
    t = x.trust_decision(i % 31 != 0, i % 29 != 0, quality, support, gate, F.col("decisions"))
    rows = lists.select("record_id", t.alias("t"))
    joined = lambda c: F.concat_ws(",", c)
    return rows.select("record_id", "t.decision", "t.reason", joined("t.uncertain_labels").alias("uncertain"), joined("t.incoherent_labels").alias("incoherent"))


_LABELS = ("NORM", "MI", "STTC", "CD", "HYP")


def c19_incoherent_labels(spark, d):
    label = F.element_at(F.array(*[F.lit(n) for n in _LABELS]), F.col("li").cast("int"))
    yes = F.array_sort(F.collect_list(F.when(F.col("prob") >= 0.5, F.struct("li", label.alias("label")))))
    lists = _pred(spark, d).groupBy("record_id").agg(F.transform(yes, lambda x_: x_["label"]).alias("l"))
    return lists.select("record_id", F.concat_ws(",", x.incoherent_labels(F.col("l"))).alias("incoherent")).where("incoherent <> ''")


def c21_aliased_frequency(spark, d):
    return table(spark, d, "events").select("event_id", F.round(x.aliased_frequency(F.round(F.col("value"), 2), F.lit(100.0)), 4).alias("f"))


def x2_sql_functions(spark, d):
    x.register_sql_functions(spark)
    _pred(spark, d).createOrReplaceTempView("ev_pred")
    return spark.sql("SELECT record_id, label, round(ev_sigmoid(logit), 6) AS s, round(ev_binary_entropy(prob), 6) AS h, round(ev_energy(logit), 6) AS e FROM ev_pred")


def j2_ontology_coverage(spark, d):
    used = _man(spark, d).select("dataset", F.explode(F.map_keys(x.parse_code_map(F.col("scp_codes")))).alias("code"))
    decided = spark.createDataFrame([(ds, f"C{k}") for ds in ("en", "de", "it") for k in range(7)], "dataset string, code string")
    return j.ontology_coverage(used, decided, ["dataset", "code"])


def j3_paired_models(spark, d):
    out = j.paired(_pred(spark, d), _pred(spark, d, 2027), ["record_id", "label"], "prob")
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("prob_a") - F.col("prob_b")), 6).alias("mean_difference"))


def _by_record(pred, groups, held):
    """Predictions with ``held`` of their record's groups, and the pieces that both were dealt into."""
    n = j.in_pieces(pred)
    g = groups.repartition(n, "record_id").groupBy("record_id").agg(*held)
    return pred.repartition(n, "record_id").join(g.hint("merge"), "record_id"), n


def j6_subgroup_join(spark, d):
    held = F.collect_list(F.struct("attribute", F.coalesce("group_value", F.lit("<MISSING>")).alias("group_value"))).alias("groups")
    met, n = _by_record(_pred(spark, d), fixture(spark, d, "subgroups"), [held])
    return j.patient_counts(met.withColumn("positives", F.col("target").cast("long")), ["label"], "patient_id", "groups", ["positives"], n)


def j7_completed(spark, d):
    conv = table(spark, d, "conversations")
    schedule = conv.where("turn < 4").select(F.col("conv_id").alias("participant"), F.col("turn").alias("trial")).distinct()
    response = conv.where("role <> 'assistant' OR conv_id % 3 = 0").select(F.col("conv_id").alias("participant"), F.col("turn").alias("trial")).distinct()
    return j.completed_participants(schedule, response)


def j8_co_occurrence(spark, d):
    return j.co_occurrence(_pred(spark, d).where("prob >= 0.5"), "record_id", "label")


def j9_frozen_set_diff(spark, d):
    m = _man(spark, d).select("record_id", "fold", "age")
    changed = m.where("record_id % 10 <> 0").withColumn("age", F.when(F.col("record_id") % 10 == 1, F.col("age") + 1).otherwise(F.col("age")))
    added = m.where("record_id % 50 = 0").withColumn("record_id", -F.col("record_id") - 1)
    return j.frozen_set_diff(m, changed.unionByName(added), "record_id", ["fold", "age"])


def j10_dataset_overlap(spark, d):
    pre = spark.createDataFrame([("en",), ("other",)], "pretrain string")
    told = spark.createDataFrame([("de", "en", "clean"), ("de", "other", "clean"), ("fr", "other", "used")], "dataset string, pretrain string, status string")
    return j.dataset_overlap(_man(spark, d), pre, told)


def j11_cohort_fan_out(spark, d):
    man = table(spark, d, "orders").select(F.col("o_orderkey").alias("record_id"), F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.col("o_orderstatus") == "F", "final"), F.when(F.col("o_totalprice") > 200000, "large")))).alias("cohort"))
    joined = fixture(spark, d, "pred").join(man, "record_id")
    return joined.groupBy("cohort", "model_id", "label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("prob") - F.col("target")) * (F.col("prob") - F.col("target"))), 6).alias("brier"))


def a14_class_balance(spark, d):
    out = co.class_balance(_pred(spark, d).where("fold <= 7"), "label", "target", 3.5)
    return out.select("label", F.round("pos_weight", 6).alias("pos_weight"))


def a14_balance_violations(spark, d):
    return co.balance_violations(_pred(spark, d), "fold", [1, 2, 3, 4, 5, 6, 7])


def a15_ensemble_uncertainty(spark, d):
    out = sm.ensemble_uncertainty(fixture(spark, d, "pred"), ["record_id"], "label")
    return out.select("record_id", *[F.round(c, 6).alias(c) for c in out.columns if c != "record_id"])


def a20_subgroup_audit(spark, d):
    of = lambda name: F.coalesce(F.max(F.when(F.col("attribute") == name, F.col("group_value"))), F.lit("<MISSING>")).alias(name)
    met, n = _by_record(_pred(spark, d), fixture(spark, d, "subgroups"), [of("status"), of("segment")])
    none = F.lit(None).cast("string")
    sets = [F.struct(s.alias("status"), g.alias("segment")) for s, g in ((F.col("status"), none), (none, F.col("segment")), (none, none))]
    rows = met.withColumns({"groups": F.array(*sets), "squares": (F.col("prob") - F.col("target")) * (F.col("prob") - F.col("target"))})
    out = j.patient_counts(rows, ["label"], "patient_id", "groups", ["squares"], n)
    size = F.when((F.col("n") < 30) | (F.col("patients") < 20), "small").otherwise("ok")
    return out.select("status", "segment", "label", "n", "patients", F.round(F.col("squares") / F.col("n"), 6).alias("brier"), size.alias("size_status"))


def a23_robustness_delta(spark, d):
    from evalspark.operators.metrics import pointwise

    b = pointwise(fixture(spark, d, "pred"), ["model_id", "label"])
    clean = b.where("model_id = 'm2026'").select("label", F.col("brier").alias("clean"))
    deltas = b.where("model_id <> 'm2026'").join(clean, "label").withColumn("delta", F.round(F.col("brier") - F.col("clean"), 6))
    return deltas.groupBy("label").agg(F.max("delta").alias("worst"), F.max_by("model_id", F.struct("delta", "model_id")).alias("worst_model"), F.min("delta").alias("best"))


def a24_logit_drift(spark, d):
    both = j.paired(_pred(spark, d), _pred(spark, d, 2028), ["record_id", "label"], "logit")
    out = sm.logit_drift(both, ["label"], "logit_a", "logit_b").withColumnRenamed("quantile", "p95")
    return out.select("label", *[F.round(c, 6).alias(c) for c in ("mean", "p95", "largest", "rms")])


def a25_score_quantiles(spark, d):
    levels = [0.0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0]
    return sm.score_quantiles(_pred(spark, d), ["label"], "prob", levels).select("label", "i", F.round("value", 6).alias("value"))


def a26_manifest_summary(spark, d):
    return co.manifest_summary(_man(spark, d).withColumn("split", x.split_for_fold(F.col("fold"))), ["split", "fold"], "patient_id")


def a26_label_histogram(spark, d):
    return co.label_histogram(_pred(spark, d).where("prob >= 0.6"), "record_id", "label", _pred(spark, d))


def a27_inventory(spark, d):
    rows = _man(spark, d).withColumns({"fs": F.col("fold") * 100.0, "patient_id": F.when(F.col("sex") < 9, F.col("patient_id"))})
    out = co.inventory(rows, ["dataset", "n_samples"], "fs", "n_samples", "patient_id")
    return out.select("dataset", "n_samples", "n", "n_fs", F.round("shortest", 6).alias("shortest"), F.round("longest", 6).alias("longest"), "no_patient")


def a30_table_fingerprint(spark, d):
    return j.table_fingerprint(_man(spark, d), ["record_id", "fold", "record_path", "age"])


def u1_u5_sets(spark, d):
    m = _man(spark, d)
    a, b, key = m.where("fold <= 6").select("patient_id"), m.where("fold >= 5").select("patient_id"), ["patient_id"]
    parts = {
        "union": co.union_manifests([a, b], key).distinct(), "overlap": co.overlap(a, b, key),
        "only_a": co.key_diff(a, b, key).where("side = 'only_a'"), "only_b": co.key_diff(a, b, key).where("side = 'only_b'"),
        "distinct": co.distinct_values(m.select(F.col("fold").cast("long").alias("patient_id")), key),
    }
    out = None
    for name, part in parts.items():
        row = part.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("patient_id"), F.lit(0)).alias("total"))
        out = row if out is None else out.unionByName(row)
    return out


def u4_check_exhaustive(spark, d):
    m = _man(spark, d)
    roles = m.select("record_id").withColumn("role", x.hash_split(F.col("record_id"), "salt"))
    counts = roles.groupBy("record_id").agg(F.count("role").alias("n_roles"))
    return m.select("record_id").join(counts, "record_id", "left").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_roles") == 1).alias("one_role"))


QUERIES = {f.__name__: f for f in (
    v1_check_unique, v2_check_one_role, v3_check_disjoint, v4_check_values, v5_check_expected_counts, v6_check_aligned, v7_check_relative_path, v8_check_id_format, v10_check_source_overlap,
    v11_check_public_columns, f1_select_cohort, f1_cohort_exclusions, a14_balance_violations, a26_label_histogram, a13_label_errors, c14_record_energy, f2_eligibility, f3_require_labeled, c1_parse_code_map, c2_parse_composite_codes, c3_map_codes, c5_c6_bands, c7_hash_split, c8_stateless_seed,
    c10_c16_maps, c15_threshold_proximity, c18_trust_decision, c19_incoherent_labels, c21_aliased_frequency, x2_sql_functions, j2_ontology_coverage, j3_paired_models, j6_subgroup_join, j7_completed,
    j8_co_occurrence, j9_frozen_set_diff, j10_dataset_overlap, j11_cohort_fan_out, a14_class_balance, a15_ensemble_uncertainty, a20_subgroup_audit, a23_robustness_delta, a24_logit_drift,
    a25_score_quantiles, a26_manifest_summary, a27_inventory, a30_table_fingerprint, u1_u5_sets, u4_check_exhaustive,
)}

MAN = lambda body: with_fixtures(["manifest"], body)
PRED = lambda body, *more: with_fixtures(["pred", *more], body)
_SPLIT = "CASE WHEN fold <= 7 THEN 'train' WHEN fold = 8 THEN 'select' WHEN fold = 9 THEN 'calibrate' WHEN fold = 10 THEN 'test' END"
_H = "-(prob * ln(prob) + (1 - prob) * ln(1 - prob)) / ln(2.0)"
_UNIT = "CAST(CAST('0x' || substr(sha256('salt|' || CAST(record_id AS VARCHAR)), 1, 16) AS UBIGINT) AS DOUBLE) / 18446744073709551616.0"
_SIG = lambda z: f"(1 / (1 + exp(-({z}))))"
_CODES = "[concat('C', CAST(record_id % 5 AS VARCHAR)), concat('C', CAST(5 + record_id % 3 AS VARCHAR))]"
_VIOL = lambda rows: " UNION ALL ".join(f"SELECT {k} , '{n}' AS violation FROM {t} WHERE NOT coalesce({ok}, false)" for k, n, t, ok in rows)

ORACLE_SQL = {
    "v1_check_unique": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "v2_check_one_role": "SELECT user_id, count(DISTINCT event_type) AS n_roles FROM events GROUP BY user_id HAVING count(DISTINCT event_type) > 1",
    "v3_check_disjoint": MAN(f"SELECT patient_id, count(DISTINCT {_SPLIT}) AS n_roles FROM manifest GROUP BY patient_id HAVING count(DISTINCT {_SPLIT}) > 1"),
    "v4_check_values": _VIOL([("event_id", "finite", "events", "isfinite(value)"), ("event_id", "unit", "events", "value BETWEEN 0 AND 1"), ("event_id", "whole", "events", "value = floor(value)")]),
    "v5_check_expected_counts": "WITH o AS (SELECT o_orderstatus, count(*) AS observed FROM orders GROUP BY 1), e AS (SELECT * FROM (VALUES ('F', CAST(1 AS BIGINT)), ('X', 2)) AS t(o_orderstatus, expected)) SELECT o_orderstatus, observed, expected FROM o FULL JOIN e USING (o_orderstatus) WHERE observed IS DISTINCT FROM expected",
    "v6_check_aligned": PRED("WITH a AS (SELECT * FROM pred WHERE seed = 2026 AND fold <= 9), b AS (SELECT * FROM pred WHERE seed = 2027 AND fold >= 2 AND record_id % 5 <> 0) SELECT record_id, label, CASE WHEN a.target IS NULL THEN 'missing_left' WHEN b.target IS NULL THEN 'missing_right' ELSE 'different' END AS status FROM a FULL JOIN b USING (record_id, label) WHERE a.target IS NULL OR b.target IS NULL OR a.target <> b.target OR a.patient_id <> b.patient_id"),
    "v7_check_relative_path": MAN("SELECT record_id, 'relative_path' AS violation FROM manifest WHERE record_id % 7 IN (0, 1)"),
    "v8_check_id_format": MAN(_VIOL([("record_id", "id", "manifest", "record_id < 100000"), ("record_id", "age", "manifest", "age BETWEEN 18 AND 100"), ("record_id", "sex", "manifest", "sex IN (0, 1)")])),
    "v10_check_source_overlap": "SELECT DISTINCT source AS site FROM documents WHERE source LIKE '%src7%'",
    "v11_check_public_columns": "SELECT 'c_name' AS column_name, count(*) AS n_values, false AS named FROM customer WHERE c_name ILIKE '%customer#00000000%'",
    "f1_select_cohort": MAN("SELECT record_id, fold FROM manifest WHERE n_samples = 10"),
    "f2_eligibility": MAN("WITH r AS (SELECT CASE WHEN n_samples > 11 THEN 'bad_length' WHEN sex NOT IN (0, 1) THEN 'bad_sex' WHEN age > 80 THEN 'too_old' WHEN record_id < 0 THEN 'never' ELSE 'eligible' END AS reason FROM manifest), n AS (SELECT * FROM (VALUES ('bad_length'), ('bad_sex'), ('too_old'), ('never'), ('eligible')) AS t(reason)) SELECT n.reason, count(r.reason) AS n FROM n LEFT JOIN r ON n.reason = r.reason GROUP BY n.reason"),
    "f3_require_labeled": PRED("SELECT record_id, count(*) AS n_labels FROM pred WHERE seed = 2026 AND prob >= 0.6 GROUP BY record_id"),
    "c1_parse_code_map": MAN("SELECT record_id, concat('C', CAST(record_id % 5 AS VARCHAR), ',C', CAST(5 + record_id % 3 AS VARCHAR)) AS codes, CAST(record_id % 100 + 50.0 AS DOUBLE) AS total FROM manifest"),
    "c2_parse_composite_codes": MAN("SELECT record_id, concat(CAST(record_id % 7 + 1 AS VARCHAR), ',', CAST(501 + record_id % 4 AS VARCHAR)) AS primaries, concat('2', CAST(record_id % 3 AS VARCHAR), '0,') AS modifiers FROM manifest"),
    "c3_map_codes": MAN(f"WITH dim AS (SELECT * FROM (VALUES ('C0', 'NORM'), ('C1', 'MI'), ('C2', 'MI'), ('C3', 'CD'), ('C5', 'HYP')) AS t(code, label)), e AS (SELECT record_id, unnest({_CODES}) AS code FROM manifest) SELECT record_id, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, count(DISTINCT label) AS n_labels FROM e LEFT JOIN dim USING (code) GROUP BY record_id"),
    "c5_c6_bands": MAN(f"SELECT record_id, {_SPLIT} AS split, CASE WHEN age = 300 THEN '80+' WHEN age < 40 THEN '<40' WHEN age < 60 THEN '40-59' WHEN age < 80 THEN '60-79' ELSE '80+' END AS age_band, CASE sex WHEN 0 THEN 'male' WHEN 1 THEN 'female' ELSE 'invalid' END AS sex_group FROM manifest"),
    "c7_hash_split": MAN(f"SELECT record_id, CASE WHEN {_UNIT} < 0.4 THEN 'A' WHEN {_UNIT} < 0.8 THEN 'B' ELSE 'C' END AS role FROM manifest"),
    "c8_stateless_seed": MAN("SELECT record_id, CAST(CAST('0x' || substr(sha256('7|' || CAST(record_id AS VARCHAR) || '|noise'), 1, 16) AS UBIGINT) % 9223372036854775808 AS BIGINT) AS seed FROM manifest"),
    "c10_c16_maps": PRED(f"SELECT record_id, label, round({_SIG('logit / 1.7')}, 6) AS tempered, round({_SIG('1.2 * logit - 0.3')}, 6) AS scaled, round(ln(prob) - ln(1 - prob), 6) AS logit, round(-(abs(logit) / 2 + ln(1 + exp(-abs(logit)))), 6) AS energy, round({_SIG('logit + ln(0.4 / 0.6) - ln(0.2 / 0.8)')}, 6) AS adjusted, CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END AS decision FROM pred WHERE seed = 2026"),
    "c15_threshold_proximity": PRED("SELECT record_id, round(-min(abs(prob - 0.5)), 6) + 0.0 AS proximity FROM pred WHERE seed = 2026 GROUP BY record_id"),
    "c18_trust_decision": PRED("""WITH n AS (SELECT record_id, li, prob, ['NORM', 'MI', 'STTC', 'CD', 'HYP'][CAST(li AS INTEGER)] AS label FROM pred WHERE seed = 2026), u AS (
  SELECT record_id, coalesce(string_agg(label, ',' ORDER BY li) FILTER (WHERE prob >= 0.4 AND prob < 0.6), '') AS un, coalesce(string_agg(label, ',' ORDER BY li) FILTER (WHERE prob >= 0.6), '') AS yes FROM n GROUP BY 1
), v AS (SELECT record_id, un, CASE WHEN yes LIKE 'NORM,%' THEN CASE replace(replace(yes, ',CD', ''), 'NORM', '') WHEN '' THEN '' ELSE replace(yes, ',CD', '') END ELSE '' END AS inc FROM u),
r AS (SELECT record_id, un, inc, CASE WHEN record_id % 31 = 0 THEN 'RELEASE_INTEGRITY_UNVERIFIED' WHEN record_id % 29 = 0 THEN 'INPUT_CONTRACT_INVALID' WHEN record_id % 37 = 0 THEN 'QUALITY_COMPONENT_UNAVAILABLE'
  WHEN record_id % 7 = 0 THEN 'SIGNAL_QUALITY_INVALID' WHEN record_id % 13 = 0 THEN 'SIGNAL_REACQUISITION_REQUIRED' WHEN record_id % 17 = 0 THEN 'DISTRIBUTION_COMPONENT_UNAVAILABLE' WHEN record_id % 11 = 0 THEN 'OUTSIDE_VALIDATED_DISTRIBUTION'
  WHEN record_id % 23 = 0 THEN 'UNCERTAINTY_COMPONENT_UNAVAILABLE' WHEN record_id % 5 = 0 THEN 'LEGACY_ENTROPY_GATE_REJECTED' WHEN un <> '' THEN 'CONFORMAL_SET_UNCERTAIN' WHEN inc <> '' THEN 'LABEL_SET_INCOHERENT' ELSE 'ALL_TRUST_GATES_PASSED' END AS reason FROM v)
SELECT record_id, CASE WHEN reason IN ('RELEASE_INTEGRITY_UNVERIFIED', 'INPUT_CONTRACT_INVALID', 'QUALITY_COMPONENT_UNAVAILABLE', 'SIGNAL_QUALITY_INVALID') THEN 'INVALID_INPUT' WHEN reason = 'SIGNAL_REACQUISITION_REQUIRED' THEN 'REACQUIRE'
  WHEN reason LIKE '%DISTRIBUTION%' THEN 'UNSUPPORTED_INPUT' WHEN reason = 'ALL_TRUST_GATES_PASSED' THEN 'PREDICTION_ALLOWED' ELSE 'ABSTAIN' END AS decision, reason,
  CASE WHEN reason = 'CONFORMAL_SET_UNCERTAIN' THEN un ELSE '' END AS uncertain, CASE WHEN reason = 'LABEL_SET_INCOHERENT' THEN inc ELSE '' END AS incoherent FROM r"""),
    "c19_incoherent_labels": PRED("""WITH y AS (SELECT record_id, li, ['NORM', 'MI', 'STTC', 'CD', 'HYP'][CAST(li AS INTEGER)] AS label FROM pred WHERE seed = 2026 AND prob >= 0.5), bad AS (SELECT DISTINCT a.record_id FROM y a JOIN y b USING (record_id) WHERE a.label = 'NORM' AND b.label IN ('MI', 'STTC', 'HYP'))
SELECT record_id, string_agg(label, ',' ORDER BY li) AS incoherent FROM y JOIN bad USING (record_id) WHERE label <> 'CD' GROUP BY 1"""),
    "c21_aliased_frequency": "SELECT event_id, round(CASE WHEN round(value, 2) % 100.0 > 50 THEN 100.0 - round(value, 2) % 100.0 ELSE round(value, 2) % 100.0 END, 4) AS f FROM events",
    "x2_sql_functions": PRED(f"SELECT record_id, label, round({_SIG('logit')}, 6) AS s, round({_H}, 6) AS h, round(-(abs(logit) / 2 + ln(1 + exp(-abs(logit)))), 6) AS e FROM pred WHERE seed = 2026"),
    "j2_ontology_coverage": MAN(f"WITH u AS (SELECT DISTINCT dataset, unnest({_CODES}) AS code FROM manifest), dd AS (SELECT ds AS dataset, 'C' || CAST(k AS VARCHAR) AS code FROM (VALUES ('en'), ('de'), ('it')) AS t(ds), range(7) r(k)) SELECT *, 'missing' AS side FROM (SELECT DISTINCT * FROM u EXCEPT SELECT * FROM dd) UNION ALL SELECT *, 'extra' AS side FROM (SELECT * FROM dd EXCEPT SELECT * FROM u)"),
    "j3_paired_models": PRED("SELECT label, count(*) AS n, round(avg(a.prob - b.prob), 6) AS mean_difference FROM pred a JOIN pred b USING (record_id, label) WHERE a.seed = 2026 AND b.seed = 2027 GROUP BY label"),
    "j6_subgroup_join": PRED("SELECT label, attribute, coalesce(group_value, '<MISSING>') AS group_value, count(*) AS n, count(DISTINCT patient_id) AS patients, CAST(sum(target) AS BIGINT) AS positives FROM pred JOIN subgroups USING (record_id) WHERE seed = 2026 GROUP BY 1, 2, 3", "subgroups"),
    "j7_completed": "WITH s AS (SELECT DISTINCT conv_id AS participant, turn AS trial FROM conversations WHERE turn < 4), r AS (SELECT DISTINCT conv_id AS participant, turn AS trial FROM conversations WHERE role <> 'assistant' OR conv_id % 3 = 0), k AS (SELECT r.* FROM r JOIN s USING (participant, trial)), f AS (SELECT participant FROM s GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM k WHERE k.participant = s.participant)) SELECT k.* FROM k JOIN f USING (participant)",
    "j8_co_occurrence": PRED("WITH y AS (SELECT record_id, label FROM pred WHERE seed = 2026 AND prob >= 0.5) SELECT a.label AS label_a, b.label AS label_b, count(*) AS n FROM y a JOIN y b ON a.record_id = b.record_id AND a.label <= b.label GROUP BY 1, 2"),
    "j9_frozen_set_diff": MAN("SELECT record_id, 'removed' AS status FROM manifest WHERE record_id % 10 = 0 UNION ALL SELECT record_id, 'changed' FROM manifest WHERE record_id % 10 = 1 UNION ALL SELECT -record_id - 1, 'added' FROM manifest WHERE record_id % 50 = 0"),
    "j10_dataset_overlap": MAN("SELECT DISTINCT dataset, CASE dataset WHEN 'de' THEN 'none' WHEN 'en' THEN 'confirmed' WHEN 'fr' THEN 'confirmed' ELSE 'undisclosed' END AS overlap FROM manifest"),
    "j11_cohort_fan_out": PRED("WITH m AS (SELECT o_orderkey AS record_id, 'all' AS cohort FROM orders UNION ALL SELECT o_orderkey, 'final' FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 'large' FROM orders WHERE o_totalprice > 200000) SELECT cohort, model_id, label, count(*) AS n, round(avg((prob - target) * (prob - target)), 6) AS brier FROM pred JOIN m USING (record_id) GROUP BY 1, 2, 3"),
    "a14_class_balance": PRED("SELECT label, round(least((count(*) - sum(target)) / sum(target), 3.5), 6) AS pos_weight FROM pred WHERE seed = 2026 AND fold <= 7 GROUP BY label"),
    "a15_ensemble_uncertainty": PRED(f"WITH e AS (SELECT record_id, label, avg(prob) AS p, avg({_H}) AS a, var_pop(prob) AS v FROM pred GROUP BY 1, 2), t AS (SELECT *, -(p * ln(p) + (1 - p) * ln(1 - p)) / ln(2.0) AS h FROM e) SELECT record_id, round(avg(h), 6) AS mean_total, round(avg(a), 6) AS mean_aleatoric, round(avg(greatest(h - a, 0)), 6) AS mean_epistemic, round(avg(v), 6) AS mean_variance, round(max(greatest(h - a, 0)), 6) AS max_epistemic FROM t GROUP BY record_id"),
    "a20_subgroup_audit": PRED("WITH w AS (SELECT record_id, coalesce(max(group_value) FILTER (attribute = 'status'), '<MISSING>') AS status, coalesce(max(group_value) FILTER (attribute = 'segment'), '<MISSING>') AS segment FROM subgroups GROUP BY 1) SELECT status, segment, label, count(*) AS n, count(DISTINCT patient_id) AS patients, round(avg((prob - target) * (prob - target)), 6) AS brier, CASE WHEN count(*) < 30 OR count(DISTINCT patient_id) < 20 THEN 'small' ELSE 'ok' END AS size_status FROM pred JOIN w USING (record_id) WHERE seed = 2026 GROUP BY GROUPING SETS ((status, label), (segment, label), (label))", "subgroups"),
    "a23_robustness_delta": PRED("WITH b AS (SELECT model_id, label, avg((prob - target) * (prob - target)) AS brier FROM pred GROUP BY ALL), x AS (SELECT b.label, b.model_id, round(b.brier - c.brier, 6) AS delta FROM b JOIN b c ON b.label = c.label AND c.model_id = 'm2026' AND b.model_id <> 'm2026') SELECT label, max(delta) AS worst, (SELECT model_id FROM x y WHERE y.label = x.label ORDER BY delta DESC, model_id DESC LIMIT 1) AS worst_model, min(delta) AS best FROM x GROUP BY label"),
    "a24_logit_drift": PRED("WITH x AS (SELECT label, abs(b.logit - a.logit) AS x FROM pred a JOIN pred b USING (record_id, label) WHERE a.seed = 2026 AND b.seed = 2028) SELECT label, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.95), 6) AS p95, round(max(x), 6) AS largest, round(sqrt(avg(x * x)), 6) AS rms FROM x GROUP BY label"),
    "a25_score_quantiles": PRED("WITH q AS (SELECT label, quantile_cont(prob, [0.0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0]) AS q FROM pred WHERE seed = 2026 GROUP BY label) SELECT label, CAST(i AS INTEGER) AS i, round(q[i + 1], 6) AS value FROM q, range(10) t(i)"),
    "a26_manifest_summary": MAN(f"SELECT {_SPLIT} AS split, fold, count(*) AS n, count(DISTINCT patient_id) AS patients FROM manifest GROUP BY ROLLUP (split, fold)"),
    "a27_inventory": MAN("SELECT dataset, n_samples, count(*) AS n, count(DISTINCT fold) AS n_fs, round(min(n_samples / (fold * 100.0)), 6) AS shortest, round(max(n_samples / (fold * 100.0)), 6) AS longest, count(*) FILTER (sex >= 9) AS no_patient FROM manifest GROUP BY CUBE (dataset, n_samples)"),
    "a26_label_histogram": PRED("WITH c AS (SELECT record_id, count(DISTINCT label) FILTER (prob >= 0.6) AS n_labels FROM pred WHERE seed = 2026 GROUP BY 1) SELECT n_labels, count(*) AS records FROM c GROUP BY 1"),
    "a14_balance_violations": PRED("SELECT fold, count(*) AS n FROM pred WHERE seed = 2026 AND fold > 7 GROUP BY 1"),
    "a13_label_errors": PRED("SELECT label, count(*) AS n, round(avg(CASE WHEN (prob >= 0.4) <> (target = 1) THEN 1.0 ELSE 0.0 END), 6) AS error FROM pred WHERE seed = 2026 GROUP BY 1"),
    "c14_record_energy": PRED("SELECT record_id, round(avg(-(abs(logit) / 2 + 1.5 * ln(1 + exp(-abs(logit) / 1.5)))), 6) AS energy FROM pred WHERE seed = 2026 GROUP BY 1"),
    "f1_cohort_exclusions": MAN("SELECT CASE WHEN n_samples <> 10 THEN 'length' WHEN record_id % 9 = 0 THEN 'ambiguous_target' WHEN record_id % 8 = 0 THEN 'conflicting_targets' ELSE 'selected' END AS status, count(*) AS n FROM manifest GROUP BY 1"),
    "a30_table_fingerprint": MAN("""SELECT count(*) AS n, CAST(sum(CAST('0x' || substr(sha256(concat('{"record_id":"', record_id, '","fold":"', fold, '","record_path":"', record_path, '","age":"', age, '"}')), 1, 12) AS UBIGINT)) AS VARCHAR) AS fingerprint FROM manifest"""),
    "u1_u5_sets": MAN("WITH a AS (SELECT DISTINCT patient_id FROM manifest WHERE fold <= 6), b AS (SELECT DISTINCT patient_id FROM manifest WHERE fold >= 5) SELECT 'union' AS part, count(*) AS n, CAST(sum(patient_id) AS BIGINT) AS total FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'overlap', count(*), CAST(coalesce(sum(patient_id), 0) AS BIGINT) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'only_b', count(*), CAST(coalesce(sum(patient_id), 0) AS BIGINT) FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT 'only_a', count(*), CAST(coalesce(sum(patient_id), 0) AS BIGINT) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'distinct', count(DISTINCT fold), CAST(sum(DISTINCT fold) AS BIGINT) FROM manifest"),
    "u4_check_exhaustive": MAN("SELECT count(*) AS n, count(*) AS one_role FROM manifest"),
}
