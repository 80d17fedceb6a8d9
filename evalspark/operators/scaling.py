"""Box-constrained sigmoid scaling: a projected Newton method for all keys at once, with its state in a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.operators.fits import softplus_loss
from evalspark.operators.joins import small
from evalspark.plans.scratch import discard, materialise

#: Step sizes that one aggregate tries, each half of the one before.
HALVINGS = 10
#: Share of the promised decrease that a step has to bring.
ARMIJO = 1e-4
MAX_STEPS, TOLERANCE = 60, 1e-9
#: An optimum has to be better than the identity by this much.
GAIN = 1e-12


def _measured(hist: DataFrame, tried: DataFrame, keys: list[str], ridge: float) -> DataFrame:
    """``tried`` (keys, j, a, b and more) with the objective f, its gradient and its Hessian at (a, b): one aggregate."""
    x, n, y = F.col("logit"), F.col("__n"), F.col("__y")
    z = F.col("a") * x + F.col("b")
    p = 1 / (1 + F.exp(-z))
    v = n * p * (1 - p)
    loss = y * softplus_loss(z, F.lit(1.0)) + (n - y) * softplus_loss(z, F.lit(0.0))
    sums = {"f": loss, "ga": (n * p - y) * x, "gb": n * p - y, "haa": v * x * x, "hab": v * x, "hbb": v}
    means = hist.join(small(tried.select(*keys, "j", "a", "b")), keys).groupBy(*keys, "j").agg(*[(F.sum(c) / F.sum(n)).alias(name) for name, c in sums.items()])
    met = tried.join(means, [*keys, "j"])
    shift = F.col("a") - 1
    return met.withColumns({
        "f": F.col("f") + ridge * (shift * shift + F.col("b") * F.col("b")), "ga": F.col("ga") + 2 * ridge * shift, "gb": F.col("gb") + 2 * ridge * F.col("b"),
        "haa": F.col("haa") + 2 * ridge, "hbb": F.col("hbb") + 2 * ridge,
    })


def _blocked(low: float, high: float) -> Column:
    """Whether the slope stands at a bound and the objective falls beyond it."""
    return ((F.col("a") <= low) & (F.col("ga") >= 0)) | ((F.col("a") >= high) & (F.col("ga") <= 0))


def projected_gradient(low: float, high: float) -> Column:
    return F.greatest(F.when(_blocked(low, high), 0.0).otherwise(F.abs("ga")), F.abs("gb"))


def fit_bounded_sigmoid(pred: DataFrame, keys: list[str], ridge: float = 1e-3, bounds: tuple[float, float] = (0.05, 20.0)) -> DataFrame:
    """M3: keys, slope, intercept, status, active_bound, converged, steps, gradient, positives, negatives, nll_before and
    nll_after of sigmoid(slope * logit + intercept), the slope within ``bounds``, drawn to (1, 0) by ``ridge``.

    Equal logits collapse first. A pass tries HALVINGS step sizes along every key's Newton direction in one aggregate and
    takes the largest that keeps the Armijo condition; a slope that a bound blocks stays there and only the intercept
    moves. The state is a row for each key in a table; one number, the keys still open, reaches the driver.

    status is ``optimized``; ``identity_optimal`` where the optimum isn't better than (1, 0), which then stands; or
    ``one_class`` (also (1, 0)). active_bound is ``lower``, ``upper`` or null; gradient is the projected one's largest
    part at the optimum. A null logit or target takes no part; a key without any has no row.
    """
    low, high = bounds
    if not (0 < low <= high and ridge > 0):
        raise ValueError("bounds have to be positive and in order, and ridge above 0")
    used = pred.where("logit IS NOT NULL AND target IS NOT NULL")
    hist = materialise(used.groupBy(*keys, F.col("logit").cast("double").alias("logit")).agg(F.count(F.lit(1)).cast("double").alias("__n"), F.sum("target").cast("double").alias("__y")), "logits")
    classes = hist.groupBy(*keys).agg(F.sum("__y").cast("long").alias("positives"), F.sum(F.col("__n") - F.col("__y")).cast("long").alias("negatives"))
    two = classes.where("positives > 0 AND negatives > 0").select(*keys)
    begin = two.withColumns({"j": F.lit(0), "a": F.lit(float(min(max(1.0, low), high))), "b": F.lit(0.0), "steps": F.lit(0), "open": F.lit(True)})
    state = materialise(_measured(hist, begin, keys, ridge).withColumn("open", projected_gradient(low, high) > TOLERANCE), "scaling")
    kept = ["a", "b", "steps", "open", "f", "ga", "gb", "haa", "hab", "hbb"]
    for _ in range(MAX_STEPS):
        if not state.where("open").limit(1).count():
            break
        det = F.col("haa") * F.col("hbb") - F.col("hab") * F.col("hab")
        stuck = _blocked(low, high)
        da = F.when(stuck, 0.0).otherwise(-(F.col("hbb") * F.col("ga") - F.col("hab") * F.col("gb")) / det)
        db = F.when(stuck, -F.col("gb") / F.col("hbb")).otherwise(-(F.col("haa") * F.col("gb") - F.col("hab") * F.col("ga")) / det)
        moved = state.where("open").withColumns({"da": da, "db": db}).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(HALVINGS - 1))))
        t = F.pow(F.lit(0.5), F.col("j"))
        new_a, new_b = F.greatest(F.least(F.col("a") + t * F.col("da"), F.lit(high)), F.lit(low)), F.col("b") + t * F.col("db")
        promised = F.col("ga") * (new_a - F.col("a")) + F.col("gb") * (new_b - F.col("b"))
        tried = moved.select(*keys, "j", new_a.alias("a"), new_b.alias("b"), (F.col("f") + ARMIJO * promised).alias("most"), F.col("steps") + 1, F.lit(True).alias("open"))
        tried = tried.toDF(*keys, "j", "a", "b", "most", "steps", "open")
        good = _measured(hist, tried, keys, ridge).where("f <= most")
        first = good.groupBy(*keys).agg(F.min_by(F.struct(*kept), "j").alias("s")).select(*keys, "s.*")
        first = first.withColumn("open", projected_gradient(low, high) > TOLERANCE)
        # a key without a step that helps has gone as far as numbers allow
        rest = state.select(*keys, *kept).join(small(first.select(*keys)), keys, "left_anti").withColumn("open", F.lit(False))
        old, state = state, materialise(first.select(*keys, *kept).unionByName(rest), "scaling")
        discard(old)
    identity = two.withColumns({"j": F.lit(0), "a": F.lit(1.0), "b": F.lit(0.0)})
    before = _measured(hist, identity, keys, ridge).select(*keys, F.col("f").alias("nll_before"))
    met = classes.join(small(state.select(*keys, *kept)), keys, "left").join(small(before), keys, "left")
    better = F.coalesce(F.col("f") < F.col("nll_before") - GAIN, F.lit(False))
    bound = F.when(F.col("a") <= low, "lower").when(F.col("a") >= high, "upper")
    status = F.when(F.col("f").isNull(), "one_class").when(better, "optimized").otherwise("identity_optimal")
    shift = F.col("a") - 1
    nll = F.when(better, F.col("f") - ridge * (shift * shift + F.col("b") * F.col("b"))).otherwise(F.col("nll_before"))
    gradient = projected_gradient(low, high)
    return met.select(
        *keys, F.when(better, F.col("a")).otherwise(1.0).alias("slope"), F.when(better, F.col("b")).otherwise(0.0).alias("intercept"), status.alias("status"),
        F.when(better & _blocked(low, high), bound).alias("active_bound"), (gradient <= 100 * TOLERANCE).alias("converged"), "steps", gradient.alias("gradient"), "positives", "negatives", "nll_before", nll.alias("nll_after"),
    )
