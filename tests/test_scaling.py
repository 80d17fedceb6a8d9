"""Sigmoid scaling within bounds against a plain solver, and its edges."""

import math

import numpy as np
import pytest

from evalspark.operators.scaling import fit_bounded_sigmoid

RIDGE = 1e-3


def plain(x, y, low, high):
    """The least objective by a search over slopes, the intercept of each by bisection of its derivative."""
    def best_b(a):
        lo, hi = -60.0, 60.0
        for _ in range(200):
            b = (lo + hi) / 2
            g = (1 / (1 + np.exp(-np.clip(a * x + b, -700, 700))) - y).mean() + 2 * RIDGE * b
            lo, hi = (lo, b) if g > 0 else (b, hi)
        return (lo + hi) / 2

    def f(a):
        b = best_b(a)
        z = a * x + b
        return (np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z)))).mean() + RIDGE * ((a - 1) ** 2 + b * b)

    lo, hi = low, high
    for _ in range(120):
        p, q = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        lo, hi = (lo, q) if f(p) < f(q) else (p, hi)
    a = (lo + hi) / 2
    return a, best_b(a), f(a)


def test_inside_lower_upper_and_identity(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=400) * 2
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.8 * x + 0.5)))).astype(int)
    cases = {"inside": (x, y), "lower": (x * 9, y), "upper": (x / 9, y), "apart": (x, (x > 0).astype(int)), "against": (x, (x < 0).astype(int)), "huge": (x * 200, y)}
    rows = [(k, float(v), int(t)) for k, (xs, ys) in cases.items() for v, t in zip(xs, ys)]
    rows += [("one", 0.3, 1), ("one", -2.0, 1), ("none", None, 1), ("nulls", 1.0, None), ("flat", 0.0, 1), ("flat", 0.0, 0), ("inside", None, 1), ("inside", 1.0, None)]
    df = spark.createDataFrame(rows, "label string, logit double, target int")
    got = {r.label: r for r in fit_bounded_sigmoid(df, ["label"], RIDGE, (0.5, 2.0)).collect()}
    assert set(got) == {*cases, "one", "flat"}
    for k, (xs, ys) in cases.items():
        a, b, f = plain(np.asarray(xs), np.asarray(ys), 0.5, 2.0)
        r = got[k]
        assert r.converged and r.slope == pytest.approx(a, abs=2e-5) and r.intercept == pytest.approx(b, abs=2e-4), k
        assert r.nll_after + RIDGE * ((r.slope - 1) ** 2 + r.intercept**2) <= f + 1e-9 and r.nll_after <= r.nll_before
    bounds = {k: got[k].active_bound for k in cases}
    assert bounds == {"inside": None, "lower": "lower", "upper": "upper", "apart": "upper", "against": "lower", "huge": "lower"}
    assert (got["one"].status, got["one"].slope, got["one"].intercept, got["one"].converged) == ("one_class", 1.0, 0.0, None)
    assert (got["flat"].status, got["flat"].slope, got["flat"].active_bound) == ("identity_optimal", 1.0, None)
    assert got["flat"].nll_after == pytest.approx(math.log(2))


def test_fixed_slope_and_nothing(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", -1.0, 0), ("a", 0.5, 0)], "label string, logit double, target int")
    one = fit_bounded_sigmoid(df, ["label"], RIDGE, (1.0, 1.0)).first()
    assert one.slope == 1.0 and one.converged and one.intercept != 0.0
    assert fit_bounded_sigmoid(df.where("false"), ["label"]).collect() == []
    with pytest.raises(ValueError):
        fit_bounded_sigmoid(df, ["label"], RIDGE, (0.0, 2.0))
