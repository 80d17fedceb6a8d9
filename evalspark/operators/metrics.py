"""Discrimination, calibration and decision metrics over the long prediction table.

All take rows of (keys..., record_id, label, target, prob) and group by ``keys``; undefined metrics are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.operators.joins import small
from evalspark.plans.prims import prefix_scan, score_hist
from evalspark.plans.scratch import materialise

EPS = 1e-12


def clipped(p: Column, eps: float = EPS) -> Column:
    return F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))


def log_loss_term(p: Column, y: Column) -> Column:
    q = clipped(p)
    return -(F.when(y == 1, F.log(q)).otherwise(F.log(1 - q)))


def entropy(p: Column) -> Column:
    """Binary entropy in nats divided by ln 2."""
    q = clipped(p)
    return -(q * F.log(q) + (1 - q) * F.log(1 - q)) / F.log(F.lit(2.0))


def prevalence(pred: DataFrame, keys: list[str]) -> DataFrame:
    """A1: positives, negatives, rate and why a ranking metric would be undefined."""
    out = pred.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("target").cast("long")).alias("positives"))
    reason = F.when(F.col("positives") == 0, "no_positives").when(F.col("positives") == F.col("n"), "no_negatives")
    return out.select(*keys, "n", "positives", (F.col("n") - F.col("positives")).alias("negatives"), (F.col("positives") / F.col("n")).alias("rate"), reason.alias("reason"))


def roc_auc(pred: DataFrame, keys: list[str]) -> DataFrame:
    """A2: area under the ROC curve, ties counted half; null if one class is missing."""
    hist = score_hist(pred, keys, "prob", "target")
    neg = F.col("n") - F.col("pos")
    cum = prefix_scan(hist, keys, [F.col("prob")], {"cum_neg": neg, "cum_pos": F.col("pos")})
    won = F.sum(F.col("pos") * (F.col("cum_neg") - neg + neg / 2))
    return cum.groupBy(*keys).agg(won.alias("won"), F.max("cum_neg_total").alias("N"), F.max("cum_pos_total").alias("P")).select(
        *keys, F.when((F.col("N") > 0) & (F.col("P") > 0), F.col("won") / (F.col("P") * F.col("N"))).alias("auroc")
    )


def average_precision(pred: DataFrame, keys: list[str]) -> DataFrame:
    """A3: average precision without interpolation, tied scores as one step; null without positives."""
    hist = score_hist(pred, keys, "prob", "target")
    cum = prefix_scan(hist, keys, [F.col("prob").desc()], {"tp": F.col("pos"), "seen": F.col("n")})
    return cum.groupBy(*keys).agg(F.sum(F.col("pos") * F.col("tp") / F.col("seen")).alias("s"), F.max("tp_total").alias("P")).select(*keys, F.when(F.col("P") > 0, F.col("s") / F.col("P")).alias("average_precision"))


def pointwise(pred: DataFrame, keys: list[str]) -> DataFrame:
    """A4, A5: Brier score and log loss."""
    p, y = F.col("prob"), F.col("target")
    return pred.groupBy(*keys).agg(F.avg((p - y) * (p - y)).alias("brier"), F.avg(log_loss_term(p, y)).alias("log_loss"))


def ece_fixed(pred: DataFrame, keys: list[str], bins: int = 15) -> DataFrame:
    """Expected calibration error over equal-width bins; a score of 1 falls in the last."""
    b = F.least(F.floor(F.col("prob") * bins), F.lit(bins - 1)).alias("bin")
    cells = pred.groupBy(*keys, b).agg(F.count(F.lit(1)).alias("n"), F.avg("prob").alias("conf"), F.avg(F.col("target").cast("double")).alias("acc"))
    return cells.groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("n")).alias("ece"))


def macro(metrics: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Mean over the labels where a metric is defined, and how many those are."""
    return metrics.groupBy(*keys).agg(*[F.avg(n).alias(f"macro_{n}") for n in names], *[F.count(n).alias(f"labels_{n}") for n in names])


def mass_bin(place: Column, n: Column, bins: int) -> Column:
    """The equal-mass bin of a place (from 0) among n: the first n mod bins bins hold one row more."""
    least, extra = F.floor(n / bins), n % bins
    head = extra * (least + 1)
    return F.when(place < head, F.floor(place / (least + 1))).otherwise(extra + F.floor((place - head) / F.greatest(least, F.lit(1))))


def reliability_curve(pred: DataFrame, keys: list[str], bins: int = 15) -> DataFrame:
    """Count, score range, mean score and event rate of each equal-mass bin by (prob, record_id).

    Ties collapse first. Only the records of a tie that an edge of a bin cuts are put in order of record_id; there are
    fewer such ties than bins in each key.
    """
    y, known = F.sum(F.col("target").cast("double")), F.count("target")
    ties = pred.groupBy(*keys, "prob").agg(F.count(F.lit(1)).alias("__n"), y.alias("__y"), known.alias("__t"))
    run = prefix_scan(ties, keys, [F.col("prob")], {"__c": F.col("__n")})
    before, n = F.col("__c") - F.col("__n"), F.col("__c_total")
    run = run.withColumns({"__before": before, "bin": mass_bin(before, n, bins), "__to": mass_bin(F.col("__c") - 1, n, bins)})
    whole = run.where("bin = __to").select(*keys, "bin", "prob", "__n", "__y", "__t")
    cut = run.where("bin < __to").select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("prob").alias("__p"), "__before", F.col("__c_total").alias("__all"))
    same = F.col("prob").eqNullSafe(F.col("__p"))
    for k in keys:
        same = same & (F.col(k) == F.col(f"__k_{k}"))
    inside = pred.select(*keys, "record_id", "prob", "target").join(small(cut), same).select(*keys, "record_id", "prob", "target", "__before", "__all")
    placed = prefix_scan(inside, [*keys, "__before"], [F.col("record_id")], {"__place": F.lit(1).cast("long")})
    at = mass_bin(F.col("__before") + F.col("__place") - 1, F.col("__all"), bins)
    split = placed.groupBy(*keys, at.alias("bin"), "prob").agg(F.count(F.lit(1)).alias("__n"), y.alias("__y"), known.alias("__t"))
    scored = F.sum(F.when(F.col("prob").isNotNull(), F.col("__n")))
    return whole.unionByName(split).groupBy(*keys, "bin").agg(
        F.sum("__n").alias("n"), F.min("prob").alias("p_min"), F.max("prob").alias("p_max"), (F.sum(F.col("__n") * F.col("prob")) / scored).alias("p_mean"), (F.sum("__y") / F.sum("__t")).alias("event_rate")
    )


def ace_equal_mass(pred: DataFrame, keys: list[str], bins: int = 15) -> DataFrame:
    """Calibration error over equal-mass bins."""
    curve = reliability_curve(pred, keys, bins)
    return curve.groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("p_mean") - F.col("event_rate"))) / F.sum("n")).alias("ace"))


def ece_sweep(pred: DataFrame, keys: list[str], max_bins: int = 100) -> DataFrame:
    """Equal-mass error at the largest bin count whose event rates never fall.

    Every bin of every count from 1 to max_bins is a difference of prefix sums at two ranks, so rows are ranked once
    and only the sums at the cut ranks are joined.
    """
    ranked = prefix_scan(
        pred.select(*keys, "record_id", "prob", "target"), keys, [F.col("prob"), F.col("record_id")],
        {"rank": F.lit(1).cast("long"), "cy": F.col("target").cast("long"), "cp": F.col("prob")},
    ).select(*keys, "rank", "cy", "cp")
    totals = pred.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    spark = pred.sparkSession
    counts = spark.range(1, max_bins + 1).select(F.col("id").alias("bins"))
    cuts = totals.join(F.broadcast(counts), F.col("bins") <= F.col("n")).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("bins"))))
    whole, extra = F.floor(F.col("n") / F.col("bins")), F.col("n") % F.col("bins")
    cuts = cuts.withColumn("rank", F.col("i") * whole + F.least(F.col("i"), extra))
    # the cuts are the small side: max_bins * (max_bins + 1) / 2 rows for each key at most
    at = ranked.join(small(cuts), [*keys, "rank"])
    # max_bins rows at most in each of these windows
    by_count = Window.partitionBy(*keys, "bins").orderBy("i")
    step = lambda c: F.col(c) - F.coalesce(F.lag(c).over(by_count), F.lit(0))
    cells = at.select(*keys, "bins", "i", "n", step("rank").alias("m"), step("cy").alias("y"), step("cp").alias("p"))
    cells = cells.withColumn("rate", F.col("y") / F.col("m")).withColumn("fell", F.col("rate") < F.lag("rate").over(by_count))
    errors = cells.groupBy(*keys, "bins").agg(F.bool_or("fell").alias("fell"), (F.sum(F.abs(F.col("y") - F.col("p"))) / F.max("n")).alias("error"))
    best = errors.where(~F.coalesce("fell", F.lit(False))).groupBy(*keys).agg(F.max(F.struct("bins", "error")).alias("best"))
    return best.select(*keys, F.col("best.bins").alias("bins"), F.col("best.error").alias("ece_sweep"))


def decision_metrics(decided: DataFrame, keys: list[str]) -> DataFrame:
    """Hamming risk and exact-match accuracy of ``decision`` against target."""
    record = decided.groupBy(*keys, "record_id").agg(F.avg((F.col("decision") != F.col("target")).cast("double")).alias("wrong"))
    return record.groupBy(*keys).agg(F.avg("wrong").alias("hamming"), F.avg((F.col("wrong") == 0).cast("double")).alias("exact_match"))


def record_losses(decided: DataFrame, keys: list[str]) -> DataFrame:
    """Per record the mean log loss, Hamming and exact error, Brier and mean and greatest entropy."""
    p, y = F.col("prob"), F.col("target")
    wrong = (F.col("decision") != y).cast("double")
    return decided.groupBy(*keys, "record_id").agg(
        F.avg(log_loss_term(p, y)).alias("log_loss"), F.avg(wrong).alias("hamming"), F.max(wrong).alias("exact_error"), F.avg((p - y) * (p - y)).alias("brier"),
        F.avg(entropy(p)).alias("uncertainty"), F.least(F.max(entropy(p)), F.lit(1.0)).alias("max_entropy"),
    )


def seed_summary(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, sample deviation (null for one seed), median, range and number of defined values."""
    v = F.col(value)
    return values.groupBy(*keys).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.median(v).alias("median"), F.min(v).alias("low"), F.max(v).alias("high"), F.count(v).alias("seeds"))


ECE_BINS = 15


def metrics_of_hist(hist: DataFrame, keys: list[str], bins: int = ECE_BINS) -> DataFrame:
    """A1 to A6 from one table of distinct scores: ``hist`` has keys, prob, __n and __y (records and positives there).

    One ascending prefix sum serves all: what lies above a score is the total less what lies below. Undefined metrics
    are null, with the reason.
    """
    scored = hist.select(*keys, F.col("prob").alias("__p"), "__n", "__y")
    cum = prefix_scan(scored, keys, [F.col("__p")], {"__cn": F.col("__n"), "__cy": F.col("__y")})
    p, n, y = F.col("__p"), F.col("__n"), F.col("__y")
    neg, q, total, positives = n - y, clipped(F.col("__p")), F.col("__cn_total"), F.col("__cy_total")
    neg_below, n_below, y_below = F.col("__cn") - F.col("__cy") - neg, F.col("__cn") - n, F.col("__cy") - y
    in_bin = F.least(F.floor(p * bins), F.lit(bins - 1))
    parts = {
        "n": F.max(total), "positives": F.max(positives), "won": F.sum(y * (neg_below + neg / 2)),
        "steps": F.sum(y * (positives - y_below) / (total - n_below)),
        "squares": F.sum(y * (1 - p) * (1 - p) + neg * p * p), "logs": F.sum(-y * F.log(q) - neg * F.log(1 - q)),
        "gaps": F.array(*[F.sum(F.when(in_bin == i, y - n * p).otherwise(0.0)) for i in range(bins)]),
    }
    sums = cum.groupBy(*keys).agg(*[c.alias(f"__m_{name}") for name, c in parts.items()])
    s = lambda name: F.col(f"__m_{name}")
    negatives = s("n") - s("positives")
    reason = F.when(s("positives") == 0, "no_positives").when(negatives == 0, "no_negatives")
    gaps = F.aggregate(s("gaps"), F.lit(0.0), lambda acc, x: acc + F.abs(x))
    return sums.select(
        *keys, s("n").alias("n"), s("positives").alias("positives"), negatives.alias("negatives"),
        (s("positives") / s("n")).alias("rate"), reason.alias("reason"),
        F.when(reason.isNull(), s("won") / (s("positives") * negatives)).alias("auroc"),
        F.when(s("positives") > 0, s("steps") / s("positives")).alias("average_precision"),
        (s("squares") / s("n")).alias("brier"), (s("logs") / s("n")).alias("log_loss"), (gaps / s("n")).alias("ece"),
    )


#: Names of the metrics of ``metrics_of_hist`` that can be averaged over labels or resampled.
METRICS = ("rate", "auroc", "average_precision", "brier", "log_loss", "ece")


def evaluate_members(pred: DataFrame, keys: list[str]) -> DataFrame:
    """A1 to A6 side by side, one row a key, from one histogram of scores."""
    counts = F.count(F.lit(1)).alias("__n"), F.sum(F.col("target").cast("long")).alias("__y")
    return metrics_of_hist(pred.groupBy(*keys, "prob").agg(*counts), keys)


def probability_audit(pred: DataFrame, keys: list[str]) -> DataFrame:
    """For each key (label last) A1 to A6, and a row with label null that has their means over the labels where
    they are defined (A7), the records there being those of all labels together."""
    rows = evaluate_members(pred, keys)
    *outer, label = keys
    whole = rows.groupBy(*outer).agg(
        *[F.sum(c).alias(c) for c in ("n", "positives", "negatives")], *[F.avg(m).alias(m) for m in METRICS]
    )
    kind = dict(rows.dtypes)[label]
    whole = whole.withColumns({label: F.lit(None).cast(kind), "reason": F.lit(None).cast("string")})
    return rows.unionByName(whole)


def subgroup_audit(
    pred: DataFrame, groups: DataFrame, keys: list[str], gates: DataFrame | None = None, least: int = 1
) -> DataFrame:
    """A1 to A6 for each group of each attribute; ``groups`` is (record_id, attribute, group_value).

    A null group is ``unknown``. Groups with fewer than ``least`` records have counts and the reason ``too_few``, but
    no metrics. With ``gates`` (model_id, maximum_entropy) also the share of rows that each model's global gate
    accepts, and the Brier score there; ``pred`` then has ``uncertainty`` and model_id is among the keys.
    """
    value = F.coalesce("group_value", F.lit("unknown")).alias("group_value")
    met = pred.join(groups.select("record_id", "attribute", value), "record_id")
    at = [*keys, "attribute", "group_value"]
    counts = [F.count(F.lit(1)).alias("__n"), F.sum(F.col("target").cast("long")).alias("__y")]
    if gates is not None:
        # one gate for each model and target; all is summed by score in the same pass over the records
        met = met.join(small(gates.select("model_id", "maximum_entropy", F.lit(True).alias("__gate"))), "model_id", "left")
        on = F.col("uncertainty") <= F.col("maximum_entropy")
        error = F.when(on, (F.col("prob") - F.col("target")) * (F.col("prob") - F.col("target")))
        counts += [F.bool_or("__gate").alias("__gate"), F.sum(on.cast("long")).alias("__on"), F.count(on).alias("__known"), F.sum(error).alias("__e"), F.count(error).alias("__c")]
    hist = met.groupBy(*at, "prob").agg(*counts)
    if gates is not None:
        hist = materialise(hist, "group-scores")
    rows = metrics_of_hist(hist, at)
    few = F.col("n") < least
    rows = rows.withColumns({m: F.when(~few, F.col(m)) for m in METRICS[1:]})
    rows = rows.withColumn("reason", F.when(few, F.lit("too_few")).otherwise(F.col("reason")))
    if gates is None:
        return rows
    gated = hist.where("__gate").groupBy(*at).agg((F.sum("__on") / F.sum("__known")).alias("coverage"), (F.sum("__e") / F.sum("__c")).alias("accepted_brier"))
    return rows.join(gated, at)


def metric_deltas(pred: DataFrame, case: str, baseline: str, keys: list[str]) -> DataFrame:
    """A1 to A6 of each case less those of the baseline case, by ``keys``; cases without a baseline row go."""
    rows = evaluate_members(pred, [*keys, case])
    base = rows.where(F.col(case) == baseline).select(*keys, *[F.col(m).alias(f"__{m}") for m in METRICS])
    met = rows.where(F.col(case) != baseline).join(base, keys)
    return met.select(*keys, case, *[(F.col(m) - F.col(f"__{m}")).alias(f"delta_{m}") for m in METRICS])
