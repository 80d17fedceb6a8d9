"""Branches that the queries' tables don't show: decisions, ties, offsets, fits without an answer, clashing names."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspark.functions import expressions as x
from evalspark.operators import cohorts, fits, intervals, metrics, selective, studies, waves
from evalspark.operators import joins as j

EVIDENCE = "integrity boolean, contract boolean, quality string, support boolean, gate boolean, decisions array<struct<label:string,decision:string>>"


def decide(spark, pairs=x.INCOMPATIBLE, gated=True, **changes):
    whole = {"integrity": True, "contract": True, "quality": "PASS", "support": True, "gate": True, "decisions": [("NORM", "SUPPORTED"), ("MI", "NOT_SUPPORTED")]}
    row = whole | changes
    df = spark.createDataFrame([tuple(row.values())], EVIDENCE)
    t = x.trust_decision(*[F.col(c) for c in ("integrity", "contract", "quality", "support")], F.col("gate") if gated else None, F.col("decisions"), pairs)
    return df.select(t.alias("t")).select("t.*").first()


@pytest.mark.parametrize(
    "changes, decision, reason",
    [
        ({}, "PREDICTION_ALLOWED", "ALL_TRUST_GATES_PASSED"),
        ({"integrity": None, "quality": None}, "INVALID_INPUT", "RELEASE_INTEGRITY_UNVERIFIED"),
        ({"contract": False}, "INVALID_INPUT", "INPUT_CONTRACT_INVALID"),
        ({"quality": None}, "INVALID_INPUT", "QUALITY_COMPONENT_UNAVAILABLE"),
        ({"quality": "INVALID", "support": False}, "INVALID_INPUT", "SIGNAL_QUALITY_INVALID"),
        ({"quality": "LIMITED"}, "REACQUIRE", "SIGNAL_REACQUISITION_REQUIRED"),
        ({"support": None}, "UNSUPPORTED_INPUT", "DISTRIBUTION_COMPONENT_UNAVAILABLE"),
        ({"support": False, "gate": False}, "UNSUPPORTED_INPUT", "OUTSIDE_VALIDATED_DISTRIBUTION"),
        ({"gate": None}, "ABSTAIN", "UNCERTAINTY_COMPONENT_UNAVAILABLE"),
        ({"gate": False}, "ABSTAIN", "LEGACY_ENTROPY_GATE_REJECTED"),
        ({"decisions": None}, "ABSTAIN", "UNCERTAINTY_COMPONENT_UNAVAILABLE"),
    ],
)
def test_states(spark, changes, decision, reason):
    got = decide(spark, **changes)
    assert (got.decision, got.reason, got.uncertain_labels, got.incoherent_labels) == (decision, reason, [], [])


def test_label_lists(spark):
    got = decide(spark, decisions=[("NORM", "SUPPORTED"), ("MI", "UNCERTAIN"), ("HYP", "SUPPORTED")])
    assert (got.reason, got.uncertain_labels, got.incoherent_labels) == ("CONFORMAL_SET_UNCERTAIN", ["MI"], [])
    both = [("NORM", "SUPPORTED"), ("CD", "SUPPORTED"), ("HYP", "SUPPORTED")]
    got = decide(spark, decisions=both)
    assert (got.reason, got.incoherent_labels) == ("LABEL_SET_INCOHERENT", ["NORM", "HYP"])
    assert decide(spark, pairs=None, decisions=both).decision == "PREDICTION_ALLOWED"
    assert decide(spark, gated=False, gate=None).decision == "PREDICTION_ALLOWED"


def plain_bins(scores, bins):
    """Cuts in order, each nearest to its place with room for the rest: a bin number for each score."""
    ordered = sorted(scores)
    edges = [i for i in range(1, len(ordered)) if ordered[i] != ordered[i - 1]]
    wanted = min(bins, len(ordered)) - 1
    if len(edges) > wanted:
        cuts, low = [], 0
        for i in range(1, wanted + 1):
            high = len(edges) - 1 - (wanted - i)
            at = min(range(low, high + 1), key=lambda k: (abs(edges[k] - i * len(ordered) / (wanted + 1)), k))
            cuts.append(edges[at])
            low = at + 1
        edges = cuts
    values = [ordered[e] for e in edges]
    return {v: sum(v >= e for e in values) for v in set(scores)}


@pytest.mark.parametrize("seed, bins", [(1, 4), (2, 10), (3, 3), (4, 12)])
def test_bins_never_part_ties(spark, seed, bins):
    rng = np.random.default_rng(seed)
    scores = np.round(rng.random(60), 1 if seed % 2 else 2)
    scores[: 30 if seed < 4 else 5] = 0.4  # a tie of half the rows
    rows = [("a", float(p), int(c), 0) for p, c in zip(*np.unique(scores, return_counts=True))]
    hist = spark.createDataFrame(rows, "k string, prob double, n long, pos long")
    got = {r.prob: r["__bin"] for r in fits.tie_aware_bins(hist, ["k"], bins).collect()}
    assert got == plain_bins(scores.tolist(), bins)


def test_area_over_a_huge_tie(spark):
    """Ties are summed without a place for each record: a tie of 10^12 records has the expected area."""
    low, high = F.lit(5).cast("long"), F.lit(10**12).cast("long")
    got = spark.range(1).select(selective.harmonic_between(low, high).alias("h"), selective.harmonic_between(F.lit(40).cast("long"), F.lit(41).cast("long")).alias("one")).first()
    gamma = 0.57721566490153286
    assert got.h == pytest.approx(math.log(1e12) + gamma + 0.5e-12 - sum(1 / k for k in range(1, 6)), abs=1e-12)
    assert got.one == pytest.approx(1 / 41, rel=1e-13)


@pytest.mark.parametrize("name", ["m", "l", "k", "s", "pos", "b", "i", "w", "bin", "rank"])
def test_keys_may_have_any_name(spark, name):
    rows = [(f"x{i % 2}", i, i % 5 / 5 + 0.05, float(i % 3 == 0), i % 2, i % 4) for i in range(40)]
    df = spark.createDataFrame(rows, f"{name} string, record_id long, uncertainty double, loss double, target int, cluster int")
    assert selective.area_under_risk(df, [name], "loss", "uncertainty").count() == 2
    assert metrics.evaluate_members(df.withColumnRenamed("uncertainty", "prob"), [name]).count() == 2
    if name != "b":
        assert intervals.bootstrap_rates(df, [name], "cluster", "target", 3, 1).count() == 6


def test_moments_far_from_zero(spark):
    df = spark.createDataFrame([(1, 0, [1e8, 1e8 + 1.0] * 50), (2, 0, [1e8, 1e8 + 1.0] * 20), (3, 0, [])], "record_id long, lead_idx int, samples array<double>")
    got = waves.normalization_stats(df).first()
    assert (got.n, got["mean"], got.sd) == (140, pytest.approx(1e8 + 0.5, abs=1e-7), pytest.approx(0.5, abs=1e-9))
    assert waves.lead_time_metrics(df.where("record_id < 3")).first().sd == pytest.approx(0.5, abs=1e-9)


def test_fits_without_an_answer(spark):
    rows = [("one", 1, 0.3), ("one", 1, -0.2)] + [("apart", int(v > 0), v) for v in (-2.0, -1.0, 1.0, 2.0)]
    rng = np.random.default_rng(5)
    rows += [("good", int(rng.random() < 1 / (1 + math.exp(-(0.7 * v + 0.4)))), float(v)) for v in rng.normal(0, 2, 400)]
    df = spark.createDataFrame(rows, "label string, target int, logit double").withColumn("prob", x.sigmoid(F.col("logit")))
    got = {r.label: r for r in fits.weak_calibration(df, ["label"]).collect()}
    assert (got["one"].slope, got["one"].reason) == (None, "one_class")
    assert (got["apart"].slope, got["apart"].reason) == (None, "separated") and got["apart"].in_the_large is not None
    good = got["good"]
    z = [(r[1], good.slope * r[2] + good.intercept, r[2]) for r in rows if r[0] == "good"]
    left = [sum((1 / (1 + math.exp(-v)) - y) * w for (y, v, w), w in zip(z, ws)) for ws in ([1.0] * len(z), [v for _, _, v in z])]
    assert good.reason is None and max(map(abs, left)) < 1e-4  # the score equations
    same = {r.label: r for r in fits.fit_sigmoid_scaling(df, ["label"]).collect()}
    assert (same["one"].slope, same["one"].intercept) == (1.0, 0.0)


def test_limb_identities(spark):
    t = np.arange(50) / 7
    one, two = np.sin(t), np.cos(t) + 0.3
    leads = [one, two, two - one, -(one + two) / 2, one - two / 2, two - one / 2]
    rows = [(1, i, v.tolist()) for i, v in enumerate(leads)] + [(2, i, (v if i != 4 else -v).tolist()) for i, v in enumerate(leads)]
    rows += [(3, i, v.tolist()) for i, v in enumerate(leads[:5])]
    got = {r.record_id: r for r in waves.limb_consistency(spark.createDataFrame(rows, "record_id long, lead_idx int, samples array<double>")).collect()}
    assert got[1].limb_residual < 1e-9 < 0.1 < got[2].limb_residual  # a turned aVL shows
    assert (got[3].limb_residual, got[3].reason) == (None, "limb_leads_incomplete")


def test_scores_of_odd_records(spark):
    good = [0.5, 1.0]
    rows = [(1, 0, good), (1, 1, good), (2, 0, good), (3, 0, good), (3, 1, [1.0]), (4, 0, good), (4, 1, [1.0, float("nan")]), (5, 0, good), (5, 1, None)]
    df = spark.createDataFrame(rows, "record_id long, lead_idx int, samples array<double>")
    got = {r.record_id: (r.total, r.reason) for r in studies.batch_score(df, lambda v: v.sum(1, keepdims=True), ["total"], 2, 2).collect()}
    assert got == {1: (3.0, None), 2: (None, "leads"), 3: (None, "length"), 4: (None, "not_finite"), 5: (None, "length")}


def test_fingerprints_tell_nulls_and_marks_apart(spark):
    prints = [j.table_fingerprint(spark.createDataFrame([row], "a string, b string"), ["a", "b"]).first().fingerprint for row in [("x|y", None), ("x", "y|~"), ("x|y", "~"), (None, "x|y")]]
    assert len(set(prints)) == 4


@pytest.mark.parametrize("k, n", [(0, 10), (3, 10), (25, 465), (10, 10), (400, 1000)])
def test_exact_bound_is_where_the_tail_is(spark, k, n):
    df = spark.createDataFrame([(k, n)], "k long, n long")
    upper, lower = df.select(intervals.exact_upper(F.col("k"), F.col("n")), intervals.exact_lower(F.col("k"), F.col("n"))).first()
    tail = lambda p, ks: sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in ks)
    assert (upper == 1.0) if k == n else tail(upper, range(k + 1)) == pytest.approx(0.05, rel=1e-6)
    assert (lower < 1e-12) if k == 0 else tail(lower, range(k, n + 1)) == pytest.approx(0.05, rel=1e-6)


def test_schedule_and_labels(spark):
    schedule = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "participant long, trial long")
    said = spark.createDataFrame([(1, 1), (1, 9), (7, 1)], "participant long, trial long")
    got = {(r.participant, r.trial): r.problem for r in cohorts.unscheduled_responses(schedule, said).collect()}
    assert got == {(1, 9): "unknown trial", (7, 1): "unknown participant"}
