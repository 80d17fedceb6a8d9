"""Iterative and linear-algebra fits. Every step is one distributed aggregate; only its few sums reach the driver."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.expressions import adjust_to_prior
from evalspark.operators.joins import small
from evalspark.plans.prims import prefix_scan
from evalspark.plans.scratch import materialise

GRID = 32


def bracketed(rows: DataFrame, keys: list[str], loss, low: float, high: float, passes: int = 6) -> DataFrame:
    """Per key the candidate in [low, high] with the least summed ``loss(candidate)``, for convex losses.

    A pass tries GRID candidates for all keys in one aggregate and narrows each bracket to the neighbours of the best.
    Brackets are one row a key and travel as a table.
    """
    spark = rows.sparkSession
    grid = spark.range(GRID).select(F.col("id").alias("g"))
    bracket = materialise(rows.select(*keys).distinct().withColumns({"lo": F.lit(low), "hi": F.lit(high)}), "bracket")
    for _ in range(passes):
        cands = bracket.join(F.broadcast(grid), F.lit(True)).withColumn("c", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("g") / (GRID - 1))
        tried = rows.join(F.broadcast(cands), keys).groupBy(*keys, "g").agg(F.sum(loss(F.col("c"))).alias("loss"), F.first("c").alias("c"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
        best = tried.groupBy(*keys).agg(F.min_by(F.struct("c", "lo", "hi"), F.struct("loss", "g")).alias("b"))
        step = (F.col("b.hi") - F.col("b.lo")) / (GRID - 1)
        bracket = materialise(best.select(*keys, F.greatest(F.col("b.c") - step, F.col("b.lo")).alias("lo"), F.least(F.col("b.c") + step, F.col("b.hi")).alias("hi")), "bracket")
    return bracket.select(*keys, ((F.col("lo") + F.col("hi")) / 2).alias("best"))


def softplus_loss(z: Column, y: Column) -> Column:
    """Binary cross-entropy of a logit."""
    return F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))


def fit_temperature(pred: DataFrame, keys: list[str], low: float = 0.05, high: float = 20.0) -> DataFrame:
    """M2: temperature that minimises the summed cross-entropy of logit / T; 1 if that gains nothing.

    Labels of one class are left out. The search is over 1 / T, in which the loss is convex.
    """
    two = pred.groupBy(*keys, "label").agg(F.min("target").alias("a"), F.max("target").alias("b")).where("a < b").select(*keys, "label")
    use = pred.join(small(two), [*keys, "label"]).select(*keys, "logit", "target")
    fit = bracketed(use, keys, lambda c: softplus_loss(F.col("logit") * c, F.col("target")), 1 / high, 1 / low)
    losses = use.join(small(fit), keys).groupBy(*keys).agg(F.first("best").alias("best"), F.sum(softplus_loss(F.col("logit") * F.col("best"), F.col("target"))).alias("l"), F.sum(softplus_loss(F.col("logit"), F.col("target"))).alias("l1"))
    return losses.select(*keys, F.when(F.col("l1") - F.col("l") > 1e-12, 1 / F.col("best")).otherwise(1.0).alias("temperature"))


#: Newton steps at most, and the gradient under which a fit has converged.
NEWTON_STEPS, NEWTON_TOLERANCE = 40, 1e-8


def newton_logistic(rows: DataFrame, keys: list[str], ridge: float, fixed_slope: bool = False) -> DataFrame:
    """(keys, slope, intercept, reason) of sigmoid(slope * logit + intercept) for every key, drawn to (1, 0) by ``ridge``.

    Each Newton step is one aggregate of gradient and Hessian over all keys; a step is halved until the key's own
    objective falls (tried at the next aggregate). A key is done when its gradient is below NEWTON_TOLERANCE. Keys
    without both classes, keys whose classes are separated by a logit (they have no finite fit) and keys that haven't
    converged after NEWTON_STEPS have null values and say so. With ``fixed_slope`` the slope stays 1.
    """
    spark = rows.sparkSession
    y = F.col("target").cast("double")
    kept = rows.select(*keys, "logit", y.alias("y")).persist()
    types = dict(rows.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys)
    inf = float("inf")
    try:
        low = lambda v: F.coalesce(F.min(F.when(F.col("y") == v, F.col("logit"))), F.lit(inf))
        high = lambda v: F.coalesce(F.max(F.when(F.col("y") == v, F.col("logit"))), F.lit(-inf))
        seen = kept.groupBy(*keys).agg(F.sum("y"), F.count(F.lit(1)), low(1), high(1), low(0), high(0)).collect()
        reasons, at = {}, {}  # a row for each model and label
        for r in seen:
            k, (ones, n, low1, high1, low0, high0) = tuple(r[: len(keys)]), r[len(keys) :]
            apart = not fixed_slope and ridge < 1e-6 and (low1 > high0 or low0 > high1)
            reasons[k] = "one_class" if ones in (0, n) else "separated" if apart else "not_converged"
            if reasons[k] == "not_converged":
                at[k] = (1.0, 0.0)
        best = {k: (inf, v) for k, v in at.items()}
        for _ in range(NEWTON_STEPS):
            if not at:
                break
            params = spark.createDataFrame([(*k, *v) for k, v in at.items()], schema + ", __a double, __b double")
            x = F.col("logit")
            z = F.col("__a") * x + F.col("__b")
            p = 1 / (1 + F.exp(-z))
            v = p * (1 - p)
            sums = kept.join(F.broadcast(params), keys).groupBy(*keys).agg(
                F.avg(softplus_loss(z, F.col("y"))), F.avg((p - F.col("y")) * x), F.avg(p - F.col("y")),
                F.avg(v * x * x), F.avg(v * x), F.avg(v),
            )
            for r in sums.collect():
                k, (loss, ga, gb, haa, hab, hbb) = tuple(r[: len(keys)]), r[len(keys) :]
                a, b = at[k]
                loss += ridge / 2 * ((a - 1) ** 2 + b * b)
                old, (a0, b0) = best[k]
                if loss > old + 1e-15:
                    at[k] = ((a + a0) / 2, (b + b0) / 2)
                    continue
                best[k] = (loss, (a, b))
                ga, gb = (0.0 if fixed_slope else ga + ridge * (a - 1)), gb + ridge * b
                if max(abs(ga), abs(gb)) < NEWTON_TOLERANCE:
                    reasons[k] = None
                    del at[k]
                elif fixed_slope:
                    at[k] = (a, b - float(gb / (hbb + ridge)))
                else:
                    step = np.linalg.solve([[haa + ridge, hab], [hab, hbb + ridge]], [ga, gb])
                    at[k] = (max(float(a - step[0]), 1e-3), float(b - step[1]))
    finally:
        kept.unpersist()
    out = [(*k, *(best[k][1] if why is None else (None, None)), why) for k, why in reasons.items()]
    return spark.createDataFrame(out, schema + ", slope double, intercept double, reason string")


def fit_sigmoid_scaling(pred: DataFrame, keys: list[str], ridge: float = 1e-3) -> DataFrame:
    """M3: slope and intercept of each label's probability map; 1 and 0 (the identity) where no fit can be had."""
    fit = newton_logistic(pred, keys, ridge)
    return fit.select(*keys, F.coalesce("slope", F.lit(1.0)).alias("slope"), F.coalesce("intercept", F.lit(0.0)).alias("intercept"), "reason")


def weak_calibration(pred: DataFrame, keys: list[str]) -> DataFrame:
    """Observed to expected ratio, calibration slope and intercept, and calibration in the large (the intercept
    at slope 1); null where a fit can't be had, with the reason."""
    ratio = pred.groupBy(*keys).agg((F.sum("target") / F.sum("prob")).alias("oe_ratio"))
    fit = newton_logistic(pred, keys, 1e-9)
    large = newton_logistic(pred, keys, 0.0, fixed_slope=True).select(*keys, F.col("intercept").alias("in_the_large"))
    # one row for each model and label in each of these
    met = ratio.join(small(fit), keys).join(small(large), keys)
    return met.select(*keys, "oe_ratio", "slope", "intercept", "in_the_large", "reason")


def estimate_label_shift(target: DataFrame, keys: list[str], source_prior: str, rounds: int = 60, tolerance: float = 1e-9) -> DataFrame:
    """M9: prevalence in the target by expectation maximisation: the mean adjusted probability, to a fixed point."""
    spark = target.sparkSession
    kept = target.select(*keys, "prob", source_prior).persist()
    try:
        prior = {tuple(r[: len(keys)]): r[-1] for r in kept.groupBy(*keys).agg(F.first(source_prior).alias("p")).collect()}
        types = dict(target.dtypes)
        schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", now double"
        done = 0
        for done in range(1, rounds + 1):
            table = spark.createDataFrame([(*k, v) for k, v in prior.items()], schema)
            met = kept.join(F.broadcast(table), keys)
            new = {tuple(r[: len(keys)]): min(max(r[-1], 1e-6), 1 - 1e-6) for r in met.groupBy(*keys).agg(F.avg(adjust_to_prior(F.col("prob"), F.col(source_prior), F.col("now")))).collect()}
            moved = max(abs(new[k] - prior[k]) for k in new)
            prior = new
            if moved < tolerance:
                break
    finally:
        kept.unpersist()
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", prevalence double, rounds int"
    return spark.createDataFrame([(*k, v, done) for k, v in prior.items()], schema)


def gramian(vectors: DataFrame, column: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, sum and sum of outer products of all vectors: each task adds its own, Spark adds the tasks'.

    d * d + d + 1 numbers reach the driver, whatever the number of rows.
    """

    def part(frames: Iterator) -> Iterator:
        n, s, q = 0, None, None
        for pdf in frames:
            x = np.stack(pdf[column].to_numpy()).astype(float) if len(pdf) else None
            if x is not None:
                n, s, q = n + len(x), x.sum(0) + (0 if s is None else s), x.T @ x + (0 if q is None else q)
        if n:
            flat = np.concatenate([[n], s, q.ravel()])
            yield pd.DataFrame({"i": np.arange(len(flat)), "v": flat})

    rows = vectors.select(column).mapInPandas(part, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    flat = np.array([r.v for r in rows])
    d = round((math.sqrt(4 * (len(flat) - 1) + 1) - 1) / 2)
    return int(flat[0]), flat[1 : d + 1], flat[d + 1 :].reshape(d, d)


def fit_mahalanobis(vectors: DataFrame, column: str, shrink: float = 0.1, ridge: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Mean and precision of the covariance, shrunk towards its mean variance."""
    n, s, q = gramian(vectors, column)
    mean = s / n
    cov = (q - n * np.outer(mean, mean)) / max(n - 1, 1)
    cov = (1 - shrink) * cov + (shrink * np.trace(cov) / len(cov) + ridge) * np.eye(len(cov))
    return mean, np.linalg.inv(cov)


def score_mahalanobis(vectors: DataFrame, column: str, mean: np.ndarray, precision: np.ndarray) -> DataFrame:
    """Squared distance of each vector; null for a null vector, one of another length or with a null in it."""
    @F.pandas_udf("double")
    def distance(v: pd.Series) -> pd.Series:
        good = np.array([x is not None and len(x) == len(mean) and None not in list(x) for x in v], bool)
        out = pd.Series([None] * len(v), dtype=object)
        if good.any():
            x = np.stack(v[good].to_numpy()).astype(float) - mean
            out[good] = ((x @ precision) * x).sum(1)
        return out

    return vectors.withColumn("distance", distance(column))


def tie_aware_bins(hist: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """``hist`` (keys, prob, n, pos) with ``__bin``: near equal-mass bins of which none parts a tie.

    Cuts fall between distinct scores, each as near as can be to its place (i * n / bins), in order, with room kept for
    those after it; with no more scores than bins each has its own. The distance to a place falls and then rises along
    the scores, so the best allowed cut is the best of all held to the allowed range: one aggregate finds the best of
    all for every place, and the ranges are settled on that short array.
    """
    cum = prefix_scan(hist, keys, [F.col("prob")], {"__seen": F.col("n"), "__d": F.lit(1).cast("long")})
    wanted = F.least(F.lit(bins).cast("long"), F.col("__seen_total")) - 1
    cum = cum.withColumns({"__wanted": wanted, "__last": F.col("__d_total") - 1})
    inner = F.col("__d") <= F.col("__last")

    def nearest(i: int) -> Column:
        away = F.abs(F.col("__seen") - F.lit(i) * F.col("__seen_total") / (F.col("__wanted") + 1))
        return F.min(F.when(inner, F.struct(away.alias("away"), F.col("__d").alias("d"))))["d"]

    best = F.array(*[nearest(i) for i in range(1, bins)]).alias("__best")
    places = cum.groupBy(*keys).agg(best, F.first("__wanted").alias("__w"), F.first("__last").alias("__m"))

    def settle(cuts: Column, d: Column) -> Column:
        i, last = F.size(cuts) + 1, F.coalesce(F.try_element_at(cuts, F.lit(-1)), F.lit(0).cast("long"))
        held = F.least(F.greatest(d, last + 1), F.col("__m") - (F.col("__w") - i))
        return F.concat(cuts, F.array(held))

    asked = F.slice("__best", F.lit(1), F.col("__w").cast("int"))
    start = F.array().cast("array<bigint>")
    cuts = F.when(F.col("__m") > F.col("__w"), F.aggregate(asked, start, settle))
    met = cum.join(small(places.select(*keys, cuts.alias("__cuts"))), keys)
    held = F.size(F.filter("__cuts", lambda c: c < F.col("__d")))
    own = F.when(F.col("__cuts").isNull(), F.col("__d") - 1).otherwise(held)
    return met.select(*hist.columns, own.cast("int").alias("__bin"))


def brier_decomposition(pred: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """A10: reliability, resolution, uncertainty, within-bin variance and covariance over bins that never part ties;
    the parts add up to the Brier score. ``keys`` are models and labels: a few rows, which are broadcast."""
    hist = pred.groupBy(*keys, "prob").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("target").cast("long")).alias("pos"))
    p, n, y = F.col("prob"), F.col("n"), F.col("pos")
    cells = tie_aware_bins(hist, keys, bins).groupBy(*keys, "__bin").agg(
        F.sum(n).alias("m"), F.sum(p * n).alias("sp"), F.sum(y).alias("sy"), F.sum(p * p * n).alias("spp"), F.sum(p * y).alias("spy")
    )
    mp, my = F.col("sp") / F.col("m"), F.col("sy") / F.col("m")
    total = cells.groupBy(*keys).agg((F.sum("sy") / F.sum("m")).alias("base"))
    met = cells.join(total, keys)
    m = F.col("m")
    out = met.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("bins"), F.sum(m).alias("n"), F.sum(m * (mp - my) * (mp - my)).alias("r"),
        F.sum(m * (my - F.col("base")) * (my - F.col("base"))).alias("s"), F.first("base").alias("base"),
        F.sum(F.col("spp") - m * mp * mp).alias("v"), F.sum(F.col("spy") - m * mp * my).alias("c"),
    )
    whole = (F.col("r") - F.col("s") + F.col("v") - 2 * F.col("c")) / F.col("n") + F.col("base") * (1 - F.col("base"))
    return out.select(
        *keys, "bins", (F.col("r") / F.col("n")).alias("reliability"), (F.col("s") / F.col("n")).alias("resolution"),
        (F.col("base") * (1 - F.col("base"))).alias("uncertainty"), (F.col("v") / F.col("n")).alias("within_variance"),
        (F.col("c") / F.col("n")).alias("within_covariance"), whole.alias("brier"),
    )
