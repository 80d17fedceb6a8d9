"""Audits of members on small tables, and levels of overlap."""

import pytest
from pyspark.sql import functions as F

from evalspark.operators import audits as au
from evalspark.operators import overlaps as ov

PRED = "model_id string, record_id long, patient_id long, label string, target int, raw double, prob double, decision int"


@pytest.fixture(scope="module")
def records(spark):
    """Four sure and right records of one patient, two unsure and wrong ones of two others; label b has one class."""
    rows = []
    for i in range(6):
        sure = i < 4
        y, p = i % 2, (0.9 if i % 2 else 0.1) if sure else (0.4 if i % 2 else 0.6)
        rows += [("m", i, 1 if sure else i, "a", y, 0.5, p, int(p >= 0.5)), ("m", i, 1 if sure else i, "b", 0, 0.3, 0.05, 0)]
    return au.audit_records(spark.createDataFrame(rows, PRED))


GROUPS = [(0, "site", "x"), (1, "site", "x"), (2, "site", None), (4, "site", "y"), (5, "site", "y")]


def test_gates_and_groups(spark, records):
    gates = spark.createDataFrame([("m", 0.7, 0.6), ("m", 1.0, 1.0), ("m", 0.1, 0.0), ("other", 0.5, 0.5)], "model_id string, target_coverage double, maximum_entropy double")
    groups = spark.createDataFrame(GROUPS, "record_id long, attribute string, group_value string")
    audit = au.gate_audit(records, gates, groups)
    got = {(r.attribute, r.group_value, r.target_coverage): r for r in audit.selections().collect()}
    assert {k[:2] for k in got} == {("all", "all"), ("site", "x"), ("site", "y"), ("site", "<MISSING>")}
    whole, some, none = (got["all", "all", c] for c in (1.0, 0.7, 0.1))
    assert (whole.selected, whole.abstained, whole.coverage) == (6, 0, 1.0) and whole.hamming_risk == pytest.approx(2 / 12) and whole.exact_match == pytest.approx(4 / 6)
    assert (some.selected, some.abstained, some.hamming_risk, some.exact_match) == (4, 2, 0.0, 1.0) and some.brier == pytest.approx((0.01 + 0.0025) / 2)
    assert (none.selected, none.coverage, none.hamming_risk, none.exact_match, none.brier, none.log_loss) == (0, 0.0, None, None, None, None)
    assert (got["site", "y", 0.7].selected, got["site", "x", 0.7].coverage) == (0, 1.0)
    prev = {(r.target_coverage, r.label): (r.accepted_prevalence, r.rejected_prevalence) for r in audit.prevalences().where("attribute = 'all'").collect()}
    assert prev[0.7, "a"] == (0.5, 0.5) and prev[0.1, "a"] == (None, 0.5) and prev[1.0, "b"] == (0.0, None)
    rows = {(r.group_value, r.kind, r.label): r for r in audit.metrics(2, 2).collect()}
    assert rows["all", "calibrated", "a"].auroc == pytest.approx(8 / 9) and rows["all", "raw", "a"].auroc == 0.5
    assert rows["all", "raw", "b"].reason == "no_positives" and rows["all", "calibrated", None].auroc == pytest.approx(8 / 9)
    status = {r.group_value: (r.records, r.patients, r.status) for r in audit.metrics(2, 2).collect()}
    # enough records but one patient is not enough
    assert status == {"all": (6, 3, "ok"), "x": (2, 1, au.SMALL), "y": (2, 2, "ok"), "<MISSING>": (1, 1, au.SMALL)}


def test_shares_are_of_the_whole(spark, records):
    groups = spark.createDataFrame(GROUPS, "record_id long, attribute string, group_value string")
    got = {(r.group_value, r.target_coverage): (r.selected, r.n) for r in au.coverage_audit(records, [0.5, 1.0], groups).selections().collect()}
    assert got["all", 0.5] == (3, 6) and got["x", 0.5] == (2, 2) and got["y", 0.5] == (0, 2) and got["y", 1.0] == (2, 2)


def test_curves(records):
    curves = au.audit_curves(records, 3)
    found = curves.error_detection.first()
    assert (found.positives, found.auroc, found.average_precision) == (2, 1.0, 1.0)
    assert [r.n for r in curves.reliability.where("kind = 'raw' AND label = 'a'").orderBy("bin").collect()] == [2, 2, 2]
    assert curves.risk.count() == 6 and {r.loss for r in curves.areas.collect()} == {"hamming", "exact_error"}


def test_predictions_are_scanned_once(spark, records, tmp_path):
    """All tables of an audit stand on tables that were written from one pass."""
    gates = spark.createDataFrame([("m", 0.5, 0.5)], "model_id string, target_coverage double, maximum_entropy double")
    audit = au.gate_audit(records, gates)
    for df in (audit.selections(), audit.prevalences(), audit.metrics()):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "labels" not in plan and "Relation" in plan


@pytest.mark.parametrize(("pair", "status", "level", "reasons"), [
    (("a", "1", "A-", "1"), None, 3, ["exact_dataset_version_in_pretraining"]),
    (("a", "1", "a", "1"), "none_known", 3, ["exact_dataset_version_in_pretraining", ov.OVERRIDDEN]),
    (("a", "1", "b", "1"), "confirmed", 3, ["provider_disclosed_confirmed_overlap"]),
    (("a", "1", "a", "2"), "none_known", 2, ["dataset_family_overlap_version_differs"]),
    (("a", "1", "b", "1"), "possible", 2, ["provider_disclosed_possible_overlap"]),
    (("a", "1", "b", "1"), None, 1, ["dataset_pair_has_no_overlap_disclosure"]),
    (("a", "1", "b", "1"), "none_known", 0, []),
])
def test_overlap_levels(spark, pair, status, level, reasons):
    local, pre = (spark.createDataFrame([p], "dataset string, version string") for p in (pair[:2], pair[2:]))
    told = spark.createDataFrame([(*pair, status)], "dataset string, version string, pre_dataset string, pre_version string, status string")
    pairs = ov.overlap_pairs(local, pre, told.where("status IS NOT NULL"))
    assert [(r.level, r.reasons) for r in pairs.collect()] == [(level, reasons)]
    plan = ov.overlap_levels(pairs, []).first()
    assert plan.overlap == ov.LEVELS[level][0] and plan.reasons == (sorted(reasons) if level else [ov.ALL_DISCLOSED])
    assert ov.overlap_levels(pairs.where("false"), ["dataset"]).collect() == []
    assert spark.range(1).select(ov.dataset_family(F.lit("PTB-xl 1.0"))).first()[0] == "ptbxl10"
