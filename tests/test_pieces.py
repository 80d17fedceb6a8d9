"""Steps whose memory or time once grew faster than their tables: rows are dealt by number, met once and summed early."""

import hashlib

from pyspark.sql import functions as F

from evalspark.operators import intervals as iv
from evalspark.operators import joins as j
from evalspark.operators import metrics as m
from evalspark.operators import panels as p
from evalspark.queries import tables
from tests.conftest import SF


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pieces_follow_the_number_of_rows(spark):
    assert [j.in_pieces(spark.range(n), 10) for n in (0, 10, 11, 95)] == [1, 1, 2, 10]


def test_patients_are_counted_once_in_a_group(spark):
    rows = [(1, "a", ["x", "y"], 1), (1, "a", ["x"], 0), (2, "a", ["x", None], 1), (None, "a", ["x"], 1), (2, "b", ["y"], 1)]
    df = spark.createDataFrame(rows, "patient_id long, label string, g array<string>, s long").withColumn("g", F.transform("g", lambda v: F.struct(v.alias("value"))))
    for pieces in (1, 7):
        got = {(r.label, r.value): (r.n, r.patients, r.s) for r in j.patient_counts(df, ["label"], "patient_id", "g", ["s"], pieces).collect()}
        assert got == {("a", "x"): (4, 2, 3), ("a", "y"): (1, 1, 1), ("a", None): (1, 1, 1), ("b", "y"): (1, 1, 1)}


def test_subgroup_join_deals_rows_by_number(spark):
    plan = plan_of(tables.j6_subgroup_join(spark, SF))
    # predictions, groups, and predictions with their groups; nothing is shuffled by patient and group besides
    assert plan.count("REPARTITION_BY_NUM") == 3 and "partial_count(patient_id" in plan


def test_subgroup_audit_expands_no_rows(spark):
    plan = plan_of(tables.a20_subgroup_audit(spark, SF))
    assert plan.count("REPARTITION_BY_NUM") == 3 and "Expand" not in plan


def test_a_record_is_met_once_for_a_block_of_replicates(spark):
    rows = [(p, label, (p * 7 + i) % 10 / 10, (p + i) % 2) for p in range(30) for i in range(4) for label in "ab"]
    pred = spark.createDataFrame(rows, "patient_id long, label string, prob double, target int")
    values = {"__n": F.lit(1), "__y": F.col("target").cast("long")}
    cells = iv.by_replicate(pred, ["label", "prob"], "patient_id", values, {}, 23, 5)
    got = {(r.b, r.label, r.prob): (r["__n"], r["__y"]) for r in cells.collect()}
    want = {}
    for b in range(23):
        for k in range(30):
            drawn = int(hashlib.md5(f"5|{b}|{k}".encode()).hexdigest()[:8], 16) % 30
            for _, label, prob, y in (r for r in rows if r[0] == drawn):
                n, s = want.get((b, label, prob), (0, 0))
                want[b, label, prob] = n + 1, s + y
    assert got == want
    # predictions join 3 rows a patient, not 23
    assert "posexplode(array(struct" in plan_of(cells)


def test_gates_and_metrics_of_groups_join_records_once(spark, monkeypatch):
    written, real = [], m.materialise
    monkeypatch.setattr(m, "materialise", lambda df, name: written.append(plan_of(df)) or real(df, name))
    pred = spark.createDataFrame([("m", "a", i, i % 2, (i % 5 + 1) / 10, i % 5 / 5) for i in range(40)] + [("x", "a", 1, 1, 0.5, 0.1)], "model_id string, label string, record_id long, target int, prob double, uncertainty double")
    groups = spark.createDataFrame([(i, "half", "lo" if i < 20 else None) for i in range(40)], "record_id long, attribute string, group_value string")
    gates = spark.createDataFrame([("m", 0.5)], "model_id string, maximum_entropy double")
    out = m.subgroup_audit(pred, groups, ["model_id", "label"], gates, 5)
    got = {r.group_value: (r.n, r.coverage, round(r.accepted_brier, 9)) for r in out.collect()}
    error = lambda ids: sum(((i % 5 + 1) / 10 - i % 2) ** 2 for i in ids) / len(ids)
    on = [i for i in range(40) if i % 5 / 5 <= 0.5]
    assert got == {"lo": (20, 0.6, round(error([i for i in on if i < 20]), 9)), "unknown": (20, 0.6, round(error([i for i in on if i >= 20]), 9))}
    assert len(written) == 1 and "record_id" not in plan_of(out)


def test_panels_deal_reviews_by_number(spark, monkeypatch):
    rows = [(1, 1, 1, 1, 0), (1, 2, 3, 0, 1), (1, 2, 4, 1, 0), (2, 3, 5, 1, 1), (None, 4, 5, 1, 1), (None, 4, 5, 1, 1), (None, 5, 1, 1, 1)]
    reviews = spark.createDataFrame(rows, "proposal long, reviewer long, rating long, useful int, artifact int")
    monkeypatch.setattr(p, "in_pieces", lambda df: 5)
    out = p.panel_summary(reviews, 3, 1, 1, 1, 0.5)
    plan = plan_of(out)
    assert "REPARTITION_BY_NUM" in plan and "SortMergeJoin" not in plan
    r = out.first()
    assert (r.total_reviews, r.eligible_reviews, r.eligible_proposals, r.unique_reviewers, r.median_rating) == (7, 3, 1, 2, 3.0)
    assert round(r.agreement, 9) == round(1 / 3, 9) and r.rating_distance == 2.0 and r.status == "threshold_met"
    assert p.panel_summary(reviews.where("false"), 3, 1, 1, 1, 0.5).first().total_reviews == 0
