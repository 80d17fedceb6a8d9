"""Contracts, limits, spectra, resampling, the grid of cases and attribution maps on made-up records."""

import math
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evalspark.operators import cases as cs
from evalspark.operators import limits as li
from evalspark.operators import spectra as sp
from evalspark.operators.attributions import attribution_similarity, average_ranks
from evalspark.operators.records import METRICS, longest_runs, record_measures
from evalspark.operators.waves import POLAR_SHARE, correlation, limb_consistency, polarity

WAVE = "record_id long, lead_idx int, lead_name string, fs double, seconds double, unit string, samples array<double>"
T = np.arange(1000) / 100


def record(i, change=None, drop=()):
    """Twelve leads that keep the contract and the limb identities; ``change`` maps leads to other samples."""
    a, b = np.sin(2 * np.pi * 1.2 * T) + 0.3 * np.sin(2 * np.pi * 7 * T), 1.1 * np.sin(2 * np.pi * 1.2 * T + 0.2) + 0.2 * np.sin(2 * np.pi * 9 * T)
    leads = [a, b, b - a, -(a + b) / 2, a - b / 2, b - a / 2, *[np.sin(2 * np.pi * (1 + k / 10) * T + k) + 0.2 * np.cos(2 * np.pi * (5 + k) * T) for k in range(6)]]
    return [(i, k, li.LEADS[k], 100.0, 10.0, "mV", (change or {}).get(k, s).tolist()) for k, s in enumerate(leads) if k not in drop]


def judged(spark, records, **more):
    rows = li.assess_records(spark.createDataFrame([r for own in records for r in own], WAVE), li.limit_rows(spark), reversal=None, **more)
    return {(r.record_id, r.preset): (r.status, r.allowed, r.reasons) for r in rows.collect()}


def test_presets_tell_apart_what_the_first_one_misses(spark):
    base = record(0)
    lead = lambda k: np.array(base[k][6])
    tail = lambda k, s: {k: np.where(T >= 10 - s, lead(k)[int(1000 - s * 100)], lead(k))}
    spike = lead(7).copy()
    spike[500] += 6
    changes = {
        1: tail(7, 0.6), 2: tail(7, 3.0), 3: {7: lead(7) * 0}, 4: {10: lead(8)}, 5: {7: spike}, 6: {7: np.clip(lead(7), -0.05, 0.05)}, 7: {7: lead(7) * 5},
        8: {7: lead(7) + 3 * np.sin(2 * np.pi * 0.3 * T)}, 9: {7: lead(7) + 0.8 * np.sin(2 * np.pi * 50 * T + 1)}, 10: {7: lead(7) + 0.8 * np.sin(2 * np.pi * 60 * T)}, 11: {1: lead(1) * 1.5}, 12: {7: lead(7) + 0.8 * np.sin(2 * np.pi * 30 * T)},
    }
    got = judged(spark, [base, *[record(i, c) for i, c in changes.items()]])
    good = ("ACCEPTABLE", True, [])
    assert got[0, "v1"] == got[0, "v2"] == good
    assert got[1, "v1"] == got[2, "v1"] == got[4, "v1"] == good  # what the first preset lets pass
    assert got[1, "v2"] == ("LIMITED", False, ["flatline"]) and got[2, "v2"] == ("REACQUIRE", False, ["flatline"])
    assert got[4, "v2"] == ("REACQUIRE", False, ["duplicated_lead_waveform"])
    for preset in ("v1", "v2"):
        assert got[3, preset][0] == "REACQUIRE" and "flatline" in got[3, preset][2]
        assert got[5, preset] == ("REACQUIRE", False, ["extreme_spikes"]) or got[5, preset][2] == ["extreme_amplitude", "extreme_spikes"]
        assert got[6, preset][0] == "REACQUIRE" and "clipping_or_saturation" in got[6, preset][2]
        assert got[7, preset] == ("LIMITED", False, ["extreme_amplitude"])
        assert "baseline_wander" in got[8, preset][2] and "powerline_interference_50hz" in got[9, preset][2] and "powerline_interference_60hz" in got[10, preset][2]
        assert "limb_lead_inconsistency" in got[11, preset][2] and "high_frequency_noise" in got[12, preset][2]


def test_a_flat_limb_lead_excuses_equal_limb_leads(spark):
    """A flat lead I makes II, III and aVF alike; that is told as a flat line and not as copies."""
    b = np.array(record(0)[1][6])
    flat = {0: b * 0, 2: b, 3: -b / 2, 4: -b / 2, 5: b}
    got = judged(spark, [record(1, flat)])
    assert got[1, "v2"][0] == "REACQUIRE" and got[1, "v2"][2] == ["clipping_or_saturation", "flatline"]


def test_contract_issues(spark):
    def changed(i, **by):
        return [tuple(by.get(n, v) for n, v in zip(("record_id", "lead_idx", "lead_name", "fs", "seconds", "unit", "samples"), r)) for r in record(i)]

    names = lambda rows, new: [(*r[:2], new.get(r[1], r[2]), *r[3:]) for r in rows]
    nan = [float("nan"), *[0.0] * 999]
    records = [
        record(0), changed(1, fs=500.0), changed(2, seconds=None), changed(3, unit="uV"), changed(4, samples=[0.0] * 999), changed(5, samples=nan), changed(6, samples=None),
        names(record(7), {0: "II", 1: "I"}), names(record(8), {3: "X"}), names(record(9), {5: "I"}), record(10, drop=(4,)), names(record(11), {2: None}),
    ]
    got = {r.record_id: r for r in li.contract_issues(spark.createDataFrame([r for own in records for r in own], WAVE)).collect()}
    want = {
        0: [], 1: ["sample_rate_mismatch"], 2: ["duration_mismatch"], 3: ["unsupported_units"], 4: ["wrong_signal_shape"], 5: ["nonfinite_signal"], 6: ["wrong_signal_shape", "nonfinite_signal"],
        7: ["lead_order_mismatch"], 8: ["missing_leads", "unexpected_leads"], 9: ["duplicate_leads", "missing_leads"], 10: ["wrong_signal_shape", "lead_count_mismatch", "missing_leads"], 11: ["missing_leads", "unexpected_leads"],
    }
    assert {i: r.issues for i, r in got.items()} == want
    assert got[8].missing == ["aVR"] and got[8].unexpected == ["X"] and got[10].missing == ["aVL"]
    invalid = judged(spark, records[:2])
    assert invalid[1, "v1"] == ("INVALID", False, ["sample_rate_mismatch"]) and invalid[0, "v2"][1]


def test_mains_are_found_where_they_fold(spark):
    def tone(f, fs):
        return (float(fs), np.sin(2 * np.pi * f * np.arange(10 * fs) / fs + 1).tolist())

    rows = [tone(50, 100), tone(60, 100), tone(50, 500), tone(60, 500), tone(50, 80), tone(60, 80), tone(0.4, 100), tone(30, 100), tone(5, 100)]
    odd = [(100.0, None), (100.0, []), (100.0, [1.0]), (100.0, [1.0, None]), (100.0, [1.0, float("nan")]), (None, [1.0, 2.0]), (0.0, [1.0, 2.0]), (100.0, [3.0] * 50), (100.0, [1.0, 2.0, 1.0])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows + odd)], "i int, fs double, s array<double>").coalesce(1)
    got = {r.i: r.r for r in df.select("i", sp.spectral_ratios(F.col("s"), F.col("fs")).alias("r")).collect()}
    main = ["mains50", "mains60", "mains50", "mains60", "mains50", "mains60", "wander", "high"]
    assert all(got[i][name] > 0.95 for i, name in enumerate(main)) and max(got[8]) < 0.01
    n = len(rows)
    assert [got[n + k] for k in range(7)] == [None] * 7
    assert tuple(got[n + 7]) == (0.0,) * 4 and got[n + 8] is not None


def test_resampling_passes_below_and_stops_above_the_new_limit(spark):
    t = np.arange(5000) / 500
    rows = [(i, np.sin(2 * np.pi * f * t).tolist()) for i, f in enumerate((5, 30, 70, 120))]
    odd = [None, [], [1.0, None], [float("inf")], [2.0]]
    df = spark.createDataFrame(rows + [(10 + k, s) for k, s in enumerate(odd)], "i int, s array<double>").coalesce(1)
    got = {r.i: r.x for r in df.select("i", sp.resample(F.col("s"), 1, 5).alias("x")).collect()}
    assert [len(got[i]) for i in range(4)] == [1000] * 4
    inner = [np.abs(np.array(got[i])[100:-100]) for i in range(4)]
    assert abs(inner[0].max() - 1) < 0.01 and inner[1].max() > 0.9 and max(inner[2].max(), inner[3].max()) < 0.01
    assert np.abs(np.array(got[0]) - np.sin(2 * np.pi * 5 * T))[100:-100].max() < 0.01
    assert got[10] is None and got[11] == [] and got[12] is None and got[13] is None and len(got[14]) == 1
    with pytest.raises(ValueError):
        sp.resample(F.col("s"), 0, 5)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 6), st.integers(1, 6), st.integers(1, 60))
def test_filter_bank_equals_its_definition(up, down, n):
    x = np.random.default_rng(n).normal(size=(2, n))
    h = sp.filter_taps(up, down)
    middle = (len(h) - 1) // 2
    plain = [[sum(r[k] * h[middle + m * down - k * up] for k in range(n) if 0 <= middle + m * down - k * up < len(h)) for m in range(-(-n * up // down))] for r in x]
    assert np.allclose(sp.resampled(x, up, down), plain)


def test_grid_of_cases(spark):
    assert len(cs.GRID) == len({c.case_id for c in cs.GRID}) == 41
    rows = record(3) + record(4)
    wave = spark.createDataFrame(rows, WAVE)
    x = {r: np.array([s[6] for s in rows if s[0] == r]) for r in (3, 4)}
    out = {}
    for r in cs.corrupt_cases(wave).collect():
        out.setdefault((r.case_id, r.record_id), {})[r.lead_idx] = np.array(r.samples)
    assert len(out) == 82 and all(sorted(v) == list(range(12)) for v in out.values())
    got = {k: np.array([v[i] for i in range(12)]) for k, v in out.items()}
    for r in (3, 4):
        rms = math.sqrt((x[r] ** 2).mean())
        tone = lambda a, f, p: x[r] + a * rms * np.sin(2 * np.pi * f * T + p)  # noqa: E731, B023
        want = {"clean": x[r], "wander-0.20": tone(0.2, 0.33, 0), "mains-0.05": tone(0.05, 50, math.pi / 2), "scale-0.50": x[r] / 2, "offset-0.15": x[r] - 0.15 * rms}
        want |= {"shift+25": np.pad(x[r], ((0, 0), (25, 0)))[:, :1000], "shift-10": np.pad(x[r], ((0, 0), (0, 10)))[:, 10:], "reverse-all": x[r][::-1], "swap-0-1": x[r][[1, 0, *range(2, 12)]]}
        limb, one = x[r].copy(), x[r].copy()
        limb[:6], one[4] = 0, 0
        want |= {"drop-limb": limb, "drop-4": one}
        for case, w in want.items():
            assert np.allclose(got[case, r], w), case
        for db in (30, 20, 10):
            noise = got[f"noise-{db}db", r] - x[r]
            assert 20 * math.log10(rms / math.sqrt((noise**2).mean())) == pytest.approx(db) and abs(noise.mean()) < 0.05 * rms
        masked = got["mask-100", r] != x[r]
        places = np.flatnonzero(masked.any(axis=0))
        assert len(places) == places[-1] - places[0] + 1 == 100 and (got["mask-100", r][:, places] == 0).all()
    starts = [np.flatnonzero((got["mask-100", r] != x[r]).any(axis=0))[0] for r in (3, 4)]
    assert starts[0] != starts[1]
    again = cs.corrupt_cases(wave.repartition(7), tuple(c for c in cs.GRID if c.kind in ("noise", "mask")))
    for r in again.collect():
        assert np.array_equal(np.array(r.samples), out[r.case_id, r.record_id][r.lead_idx])
    with pytest.raises(ValueError):
        cs.corrupt_cases(wave, (cs.Case("x", "melt"),))
    with pytest.raises(ValueError):
        cs.corrupt_cases(wave, (cs.Case("x", "order", leads=(0, 0)),))


def test_stress_matrix(spark):
    wave = spark.createDataFrame(record(0) + record(1) + record(2, drop=(3,)), WAVE)
    cases = tuple(c for c in cs.GRID if c.case_id in ("clean", "drop-7", "scale-0.75", "mask-200", "noise-10db"))
    got = {(r.case_id, r.preset): r for r in cs.stress_matrix(wave, li.limit_rows(spark), li.Contract(), cases, ("clean", "scale-0.75"), None).collect()}
    assert len(got) == 10
    clean = got["clean", "v1"]
    assert (clean.acceptable, clean.invalid, clean.fail_open) == (2, 1, 0) and got["scale-0.75", "v2"].fail_open == 0
    assert got["drop-7", "v1"].reacquire == 2 and got["drop-7", "v1"].fail_open == 0
    # two seconds without signal pass the first preset's statistics, not the second's rule on runs
    assert got["mask-200", "v1"].fail_open == 2 and got["mask-200", "v2"].fail_open == 0 and got["mask-200", "v2"].reacquire == 2


def test_cases_are_judged_where_they_are_made(spark, monkeypatch):
    """A record's cases leave its piece as counts only: leads are shuffled once, before there are cases, and measured once."""
    wave = spark.createDataFrame(record(0) + record(1) + record(2), WAVE)
    for m in (cs, li):
        monkeypatch.setattr(m, "PIECE_LEADS", 12)
    cases = tuple(c for c in cs.GRID if c.case_id in ("clean", "drop-7", "noise-10db"))
    out = cs.stress_matrix(wave, li.limit_rows(spark), li.Contract(), cases)
    plan = out._jdf.queryExecution().executedPlan().toString()
    plan = plan[: plan.find("== Initial Plan ==")] if "== Initial Plan ==" in plan else plan
    # limits are gathered by preset, records by their number, counts by case
    assert sorted(re.findall(r"Exchange hashpartitioning\((\w+)#", plan)) == ["case_id", "preset", "record_id"]
    assert plan.count("ArrowEvalPython") == 1 and "SortMergeJoin" not in plan
    assert cs.case_rows(wave, cases, 1).rdd.getNumPartitions() == 3
    assert {(r.case_id, r.preset): r.acceptable + r.limited + r.reacquire + r.invalid for r in out.collect()} == {(c.case_id, p): 3 for c in cases for p in ("v1", "v2")}


def test_measures_of_records_of_many_shapes_in_one_batch(spark):
    rng = np.random.default_rng(4)
    shapes = {0: (12, 40), 1: (12, 40), 2: (7, 40), 3: (12, 9), 4: (12, 2), 5: (12, 1), 6: (12, 40), 7: (12, 40)}
    x = {i: [rng.normal(size=n).tolist() for _ in range(k)] for i, (k, n) in shapes.items()}
    x[1][8], x[1][3], x[0][2] = (np.array(x[1][6]) + 1e-4).tolist(), [0.1] * 40, (np.round(x[0][2]) * 1.0).tolist()
    x[6][5], x[7][4] = None, [None, *x[7][4][1:]]
    x |= {8: [*x[0][:11], x[0][11][:39]], 9: [[1.0, float("nan")]], 10: []}
    # leads of records 2 are numbered from 5 on
    rows = [(i, [k + 5 * (i == 2) for k in range(len(s))], [100.0] * len(s), s) for i, s in x.items()]
    asked = (0, 11, (0, 11), (1, 10))
    df = spark.createDataFrame(rows, "i int, numbers array<int>, rates array<double>, s array<array<double>>").coalesce(1)
    got = {r.i: r.m for r in df.select("i", record_measures(F.col("s"), F.col("numbers"), F.col("rates"), F.lit(5e-4), asked, POLAR_SHARE).alias("m")).collect()}
    assert {i: m.finite for i, m in got.items()} == {i: i not in (6, 7, 9) for i in x}
    assert all(got[i].values is None and got[i].pairs == [] for i in (6, 7, 8, 9, 10))
    leads = spark.createDataFrame([(i, k + 5 * (i == 2), 100.0, s) for i in range(6) for k, s in enumerate(x[i])], "record_id int, lead_idx int, fs double, samples array<double>")
    each = {(r.record_id, r.lead_idx): r for r in li.lead_measures(leads).collect()}
    assert {k for k in each if k[0] == 5} == set() and got[5].values == []
    for i in range(5):
        k = len(x[i])
        for at, metric in enumerate(METRICS):
            own = [each[i, n][metric] for n in rows[i][1]]
            assert got[i].values[at * k : (at + 1) * k] == pytest.approx(own) and (got[i].least[at], got[i].most[at]) == pytest.approx((min(own), max(own)))
    limb = {r.record_id: r.limb_residual for r in limb_consistency(leads).collect()}
    assert {i: got[i].limb for i in range(6)} == {i: pytest.approx(limb[i]) if i != 2 else None for i in range(6)}
    told = df.where("i IN (0, 1, 3, 4, 5)").select("i", *[polarity(F.get("s", F.lit(k))).alias(f"p{k}") for k in (0, 11)], *[correlation(F.get("s", F.lit(a)), F.get("s", F.lit(b))).alias(f"c{a}") for a, b in asked[2:]])
    for r in told.collect():
        assert got[r.i].strengths == pytest.approx([r.p0, r.p11, r.c0, r.c1], abs=1e-9)
    assert np.isnan(got[2].strengths[0]) and not np.isnan(got[2].strengths[1]) and np.isnan(got[2].strengths[2])
    assert [(p.a, p.b) for p in got[1].pairs] == [(6, 8)] and got[1].pairs[0].apart == pytest.approx(1e-4) and got[0].pairs == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.booleans(), max_size=30))
def test_longest_runs(mask):
    want = max(map(len, "".join("1" if m else "0" for m in mask).split("0")))
    assert longest_runs(np.array([mask, [True] * len(mask)], bool).reshape(2, -1)).tolist() == [want, len(mask)]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.sampled_from([-1.0, 0.0, 0.5, 2.0, 3.0]), max_size=12))
def test_average_ranks(spark, values):
    got = spark.createDataFrame([(values,)], "a array<double>").select(average_ranks(F.col("a"))).first()[0]
    assert got == [sum(w < v for w in values) + (values.count(v) + 1) / 2 for v in values]


def test_similarity_of_maps(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3, 20))
    zero, flat = np.zeros((3, 20)), np.ones((3, 20))
    pairs = {0: (x, x), 1: (x, -x), 2: (zero, zero), 3: (x, zero), 4: (flat, x), 5: (np.round(x), np.round(rng.normal(size=(3, 20)))), 6: (x, x[:2]), 7: (x, x[:, :10]), 8: (x, x + np.where(np.arange(20) == 3, np.nan, 0))}
    side = lambda k: spark.createDataFrame([(i, j, s.tolist()) for i, p in pairs.items() for j, s in enumerate(p[k])] + [(20 + k, 0, [1.0])], "record_id long, lead_idx int, samples array<double>")
    got = {r.record_id: r for r in attribution_similarity(side(0), side(1)).collect()}
    values = lambda i: (got[i].cosine, got[i].time_cosine, got[i].time_cosine_valid, got[i].spearman, got[i].spearman_valid)
    assert values(0) == pytest.approx((1, 1, True, 1, True)) and values(1) == pytest.approx((-1, 1, True, 1, True))
    assert values(2) == (1.0, 0.0, False, 0.0, False) and values(3)[:2] == (0.0, 0.0) and not got[3].time_cosine_valid
    assert got[4].time_cosine_valid and not got[4].spearman_valid and got[4].spearman == 0.0
    a, b = (np.abs(s).mean(axis=0) for s in pairs[5])
    ranks = [np.array([(m < v).sum() + ((m == v).sum() + 1) / 2 for v in m]) for m in (a, b)]
    assert got[5].spearman == pytest.approx(np.corrcoef(*ranks)[0, 1]) and got[5].time_cosine == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    assert [got[i].reason for i in (6, 7, 8, 20, 21)] == ["unmatched", "unmatched", "not_finite", "unmatched", "unmatched"] and got[6].cosine is None


def test_polarity(spark):
    rng = np.random.default_rng(8)
    rows = [rng.normal(size=n) ** 3 for n in (1, 2, 5, 50, 101)] + [np.zeros(7)]

    def plain(x):
        d = x - np.median(x)
        far = d[np.abs(d) >= np.quantile(np.abs(d), 0.9)]
        return 0.0 if np.abs(far).sum() <= 2.0**-52 else far.sum() / np.abs(far).sum()

    got = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)] + [(9, [])], "i int, s array<double>").select("i", polarity(F.col("s")).alias("p")).collect()
    assert {r.i: r.p for r in got if r.i < 9} == {i: pytest.approx(plain(x)) for i, x in enumerate(rows)}
    assert [r.p for r in got if r.i == 9] == [None]
