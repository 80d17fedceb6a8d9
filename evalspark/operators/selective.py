"""Order statistics, thresholds, conformal sets and risk-coverage curves; all global order goes through prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.operators.joins import small
from evalspark.plans.prims import prefix_scan, score_hist


def fit_thresholds(pred: DataFrame, keys: list[str], default: float = 0.5) -> DataFrame:
    """M1: the F1-best threshold among the distinct scores, 0, 1 and the default.

    Within 1e-12 of the best the one nearest to the default is taken, then the larger; labels of one class keep the
    default.
    """
    hist = score_hist(pred, keys, "prob", "target")
    extra = hist.select(*keys).distinct().withColumn("prob", F.explode(F.array(*[F.lit(float(x)) for x in (0.0, 1.0, default)])))
    points = hist.unionByName(extra.withColumns({"n": F.lit(0).cast("long"), "pos": F.lit(0).cast("long")})).groupBy(*keys, "prob").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    cum = prefix_scan(points, keys, [F.col("prob").desc()], {"tp": F.col("pos"), "called": F.col("n")})
    f1 = F.when(F.col("tp_total") + F.col("called") > 0, 2.0 * F.col("tp") / (F.col("tp_total") + F.col("called"))).otherwise(0.0)
    scored = cum.select(*keys, "prob", "tp_total", "called_total", f1.alias("f1"))
    best = scored.groupBy(*keys).agg(F.max("f1").alias("top"))
    near = scored.join(best, keys).where(F.col("f1") >= F.col("top") - 1e-12)
    pick = F.min_by("prob", F.struct(F.round(F.abs(F.col("prob") - default), 12).alias("far"), (-F.col("prob")).alias("up")))
    one = (F.max("tp_total") == 0) | (F.max("tp_total") == F.max("called_total"))
    return near.groupBy(*keys).agg(F.when(one, F.lit(default)).otherwise(pick).alias("threshold"), F.when(~one, F.max("f1")).alias("f1"))


def kth_smallest(df: DataFrame, keys: list[str], value: str, k: Column) -> DataFrame:
    """The k-th smallest value, exactly; ``k`` may use ``n``, the rows of the key. Null where k is above n. ``kept``
    counts the values up to that one, ties included.

    Equal values collapse first, so rows are never put in order one by one.
    """
    ties = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__m"))
    ranked = prefix_scan(ties, keys, [F.col(value)], {"__c": F.col("__m")})
    with_k = ranked.withColumn("n", F.col("__c_total")).withColumn("k", k)
    held = (F.col("k") <= F.col("__c")) & (F.col("k") > F.col("__c") - F.col("__m"))
    nulls = F.coalesce(F.sum(F.when(F.col(value).isNull(), F.col("__m"))), F.lit(0))
    return with_k.groupBy(*keys).agg(
        F.max("n").alias("n"), F.max("k").alias("k"), F.max(F.when(held, F.col(value))).alias("cutoff"),
        (F.max(F.when(held & F.col(value).isNotNull(), F.col("__c"))) - nulls).alias("kept"),
    )


def fit_entropy_gate(records: DataFrame, keys: list[str], coverage: float) -> DataFrame:
    """M4: cutoff that keeps the ceil(coverage * n) least uncertain records, ties kept; 1 at full coverage."""
    gate = kth_smallest(records, keys, "uncertainty", F.ceil(F.round(F.lit(coverage) * F.col("n"), 9)))
    cutoff = F.lit(1.0) if coverage >= 1 else F.col("cutoff")
    return gate.select(*keys, "n", "k", cutoff.alias("cutoff"), "kept")


def nonconformity(p: Column, y: Column) -> Column:
    return F.when(y == 1, 1 - p).otherwise(p)


def fit_conformal(pred: DataFrame, keys: list[str], alpha: float) -> DataFrame:
    """M5, M6, M7: per key (label; label and class; label and group) the ceil((n + 1)(1 - alpha))-th smallest score.

    1 if that rank is above n; ``attainable`` says whether it is not.
    """
    scored = pred.withColumn("nc", F.round(nonconformity(F.col("prob"), F.col("target")), 9))
    fit = kth_smallest(scored, keys, "nc", F.ceil(F.round((F.col("n") + 1) * (1 - alpha), 9)))
    return fit.select(*keys, "n", "k", F.coalesce("cutoff", F.lit(1.0)).alias("cutoff"), (F.col("k") <= F.col("n")).alias("attainable"))


def predict_sets(pred: DataFrame, fit: DataFrame, keys: list[str]) -> DataFrame:
    """M8: which of both classes are in the set, and the decision that follows."""
    joined = pred.join(small(fit.select(*keys, "cutoff")), keys)
    neg, pos = F.round(F.col("prob"), 9) <= F.col("cutoff"), F.round(1 - F.col("prob"), 9) <= F.col("cutoff")
    state = F.when(pos & ~neg, "supported").when(neg & ~pos, "not_supported").otherwise("uncertain")
    return joined.select(*pred.columns, neg.alias("has_negative"), pos.alias("has_positive"), state.alias("decision_set"))


def evaluate_sets(sets: DataFrame, keys: list[str]) -> DataFrame:
    """Marginal and joint coverage, mean set size, and shares of singleton, empty and double sets."""
    size = F.col("has_negative").cast("int") + F.col("has_positive").cast("int")
    covered = F.when(F.col("target") == 1, F.col("has_positive")).otherwise(F.col("has_negative"))
    rows = sets.withColumn("size", size).withColumn("covered", covered)
    flat = rows.groupBy(*keys).agg(
        F.avg(F.col("covered").cast("double")).alias("coverage"), F.avg("size").alias("mean_size"),
        *[F.avg((F.col("size") == k).cast("double")).alias(name) for k, name in ((0, "empty"), (1, "singleton"), (2, "both"))],
    )
    joint = rows.groupBy(*keys, "record_id").agg(F.min("covered").alias("all")).groupBy(*keys).agg(F.avg(F.col("all").cast("double")).alias("joint_coverage"))
    return flat.join(joint, keys)


def stable_rank(df: DataFrame, keys: list[str], value: str, tiebreak: str) -> DataFrame:
    """Rank by value and tie-break, and the average rank of equal values."""
    ranked = prefix_scan(df, keys, [F.col(value), F.col(tiebreak)], {"rank": F.lit(1).cast("long")})
    ties = ranked.groupBy(*keys, value).agg(F.avg("rank").alias("average_rank"))
    return ranked.drop("rank_total").join(ties, [*keys, value])


def dense_curve(losses: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """For every prefix of the records by (uncertainty, record_id): coverage, cutoff and mean losses."""
    sums = {"k": F.lit(1).cast("long")} | {f"s_{n}": F.col(n) for n in names}
    run = prefix_scan(losses, keys, [F.col("uncertainty"), F.col("record_id")], sums)
    return run.select(*keys, "record_id", "k", (F.col("k") / F.col("k_total")).alias("coverage"), F.col("uncertainty").alias("cutoff"), *[(F.col(f"s_{n}") / F.col("k")).alias(f"risk_{n}") for n in names])


def selective_points(losses: DataFrame, keys: list[str], names: list[str], coverages: list[float]) -> DataFrame:
    """The curve at ceil(c * n) records for each asked coverage."""
    curve = dense_curve(losses, keys, names)
    n = F.round(F.col("k") / F.col("coverage"))
    wanted = F.array(*[F.lit(float(c)) for c in coverages])
    asked = curve.withColumn("target_coverage", F.explode(wanted)).where(F.col("k") == F.ceil(F.round(F.col("target_coverage") * n, 9)))
    return asked.drop("record_id")


#: Places of a tie that are summed one by one; beyond them the asymptotic series is exact to double precision.
HARMONIC = 32


def harmonic_between(low: Column, high: Column) -> Column:
    """The sum of 1 / j for j from low + 1 to high, in a few operations whatever the distance."""
    at = F.greatest(low, F.lit(HARMONIC).cast("long"))
    short = F.aggregate(
        F.when(low < HARMONIC, F.sequence(low + 1, F.least(high, at))).otherwise(F.array().cast("array<bigint>")),
        F.lit(0.0), lambda acc, j: acc + F.lit(1.0) / j,
    )
    rest = lambda n: 1 / (2 * n) - 1 / (12 * n * n) + 1 / (120 * F.pow(n, 4)) - 1 / (252 * F.pow(n, 6))
    a, b = at.cast("double"), high.cast("double")
    return short + F.when(high > at, F.log1p((b - a) / a) + rest(b) - rest(a)).otherwise(0.0)


def area_under_risk(losses: DataFrame, keys: list[str], loss: str, order: str) -> DataFrame:
    """Expected areas under the selective risk (aurc) and the generalised risk (augrc) curve, ties averaged.

    Records tied in ``order`` enter in any order, so each brings their mean loss. A tie of m records after s loss in k
    records adds sum over j of (s + j * mean) / (k + j), which needs only the harmonic sum over those positions.
    """
    ties = losses.groupBy(*keys, order).agg(F.count(F.lit(1)).alias("__m"), F.sum(loss).cast("double").alias("__l"))
    return area_of_ties(ties, keys, order)


def area_of_ties(ties: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The areas of ``area_under_risk`` from one row for each tie: keys, order, records __m and summed loss __l."""
    run = prefix_scan(ties, keys, [F.col(order)], {"__k": F.col("__m"), "__sum": F.col("__l")})
    m, k = F.col("__m"), F.col("__k")
    k0, s0, mean = k - m, F.col("__sum") - F.col("__l"), F.col("__l") / m
    part = mean * m + (s0 - mean * k0) * harmonic_between(k0, k)
    general = m * s0 + mean * m * (m + 1) / 2
    n = F.max("__k_total")
    return run.groupBy(*keys).agg((F.sum(part) / n).alias("aurc"), (F.sum(general) / n / n).alias("augrc"))


def excess_aurc(losses: DataFrame, keys: list[str], loss: str) -> DataFrame:
    """Area under the risk curve, the same for the best possible order, and their difference."""
    own = area_under_risk(losses, keys, loss, "uncertainty")
    best = area_under_risk(losses, keys, loss, loss).select(*keys, F.col("aurc").alias("oracle_aurc"))
    return own.join(best, keys).select(*keys, "aurc", "oracle_aurc", (F.col("aurc") - F.col("oracle_aurc")).alias("excess_aurc"), "augrc")


def frozen_gate_audit(losses: DataFrame, gates: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Coverage and accepted risk of each frozen cutoff; risk is null where nothing is accepted."""
    on = F.col("uncertainty") <= F.col("maximum_entropy")
    met = losses.join(small(gates), "model_id")
    return met.groupBy(*keys, "target_coverage").agg(
        F.count(F.lit(1)).alias("n"), F.sum(on.cast("long")).alias("accepted"), F.avg(on.cast("double")).alias("coverage"),
        *[F.avg(F.when(on, F.col(n))).alias(f"accepted_{n}") for n in names],
    )


def first_per_entity(df: DataFrame, entity: str, order: str, n: int) -> DataFrame:
    """Each entity's first row by ``order``, then the first n of those."""
    firsts = df.groupBy(entity).agg(F.min(order).alias(order))
    return firsts.orderBy(order, entity).limit(n)


def select_architecture(trials: DataFrame, margin: float) -> DataFrame:
    """Best trial of each architecture and whether the mean difference passes the practical margin."""
    best = trials.groupBy("architecture").agg(F.avg("score").alias("mean_score"), F.max_by("trial", F.struct("score", (-F.col("epochs")).alias("e"), (-F.col("trial")).alias("t"))).alias("best_trial"))
    top = Window.orderBy(F.desc("mean_score"), "architecture")  # one row for each architecture
    ranked = best.withColumn("place", F.row_number().over(top)).withColumn("lead", F.col("mean_score") - F.lead("mean_score").over(top))
    return ranked.select("architecture", "best_trial", "mean_score", "place", F.when((F.col("place") == 1) & (F.col("lead") > margin), "winner").when(F.col("place") == 1, "tie").otherwise("other").alias("verdict"))
