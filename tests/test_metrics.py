"""Exact answers, edge tables and plan hygiene of the metric operators."""

import pytest
from pyspark.sql import functions as F

from evalspark.operators import metrics as m
from evalspark.operators import selective as s
from evalspark.plans.prims import prefix_scan

SCHEMA = "label string, record_id long, target int, prob double"


def frame(spark, ys, ps, label="a"):
    return spark.createDataFrame([(label, i, y, p) for i, (y, p) in enumerate(zip(ys, ps))], SCHEMA)


def test_known_ece(spark):
    """Two bins of width 1/2. Below: scores 0.1, 0.3, 0.3 with one event, a gap of |1 - 0.7| = 0.3. Above: 0.9, 0.6 with
    one event, a gap of |1 - 1.5| = 0.5. Together 0.8 over five rows."""
    df = frame(spark, [0, 1, 0, 1, 0], [0.1, 0.3, 0.3, 0.9, 0.6])
    assert m.ece_fixed(df, ["label"], 2).first().ece == pytest.approx(0.16)


def test_known_ranking(spark):
    """Events at 0.9, 0.5 and 0.2, others at 0.7 and 0.5. Of the six pairs 0.9 wins two, 0.5 a half and 0.2 none: 2.5 / 6.
    Steps from above: 0.9 (precision 1), 0.5 (2 of 4), 0.2 (3 of 5), a mean of (1 + 1/2 + 3/5) / 3."""
    df = frame(spark, [1, 0, 1, 0, 1], [0.9, 0.7, 0.5, 0.5, 0.2])
    assert m.roc_auc(df, ["label"]).first().auroc == pytest.approx(2.5 / 6)
    assert m.average_precision(df, ["label"]).first().average_precision == pytest.approx(0.7)
    assert m.pointwise(df, ["label"]).first().brier == pytest.approx((0.01 + 0.49 + 0.25 + 0.25 + 0.64) / 5)
    one = m.evaluate_members(df, ["label"]).first()
    assert (one.auroc, one.average_precision) == (pytest.approx(2.5 / 6), pytest.approx(0.7))


def test_one_class_is_null(spark):
    df = frame(spark, [0, 0, 0], [0.1, 0.2, 0.3])
    assert m.roc_auc(df, ["label"]).first().auroc is None
    assert m.average_precision(df, ["label"]).first().average_precision is None
    assert m.prevalence(df, ["label"]).first().reason == "no_positives"
    assert s.fit_thresholds(df, ["label"]).first().threshold == 0.5


def test_all_scores_equal(spark):
    assert m.roc_auc(frame(spark, [0, 1, 1], [0.4] * 3), ["label"]).first().auroc == pytest.approx(0.5)


def test_prefix_scan_is_the_same_under_repartitioning(spark):
    rows = [("x" if i % 3 else "y", i % 50, i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, v int, id long")
    results = {tuple(sorted(map(tuple, prefix_scan(df.repartition(n), ["k"], [F.col("v"), F.col("id")], {"t": F.col("id")}).select("k", "id", "t", "t_total").collect()))) for n in (1, 7)}
    assert len(results) == 1
    run = {}
    for k, v, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        run[k] = run.get(k, 0) + i
        assert (k, i, run[k], sum(r[2] for r in rows if r[0] == k)) in next(iter(results))


def test_conformal_rank_above_n(spark):
    got = s.fit_conformal(frame(spark, [1, 0], [0.7, 0.2]), ["label"], 0.1).first()
    assert (got.cutoff, got.attainable) == (1.0, False)


def test_equal_mass_bins_with_remainder(spark):
    df = frame(spark, [0, 1] * 5, [i / 10 for i in range(10)])
    counts = sorted(r["n"] for r in m.reliability_curve(df, ["label"], 3).collect())
    assert counts == [3, 3, 4]


def test_no_window_without_partition(spark):
    plan = m.roc_auc(frame(spark, [0, 1], [0.1, 0.2]), ["label"])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
