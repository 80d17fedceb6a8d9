"""Parameters applied to scores, and summaries of uncertainty, drift and quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions.expressions import sigmoid, symmetric_energy
from evalspark.operators.joins import small
from evalspark.operators.metrics import entropy
from evalspark.operators.selective import excess_aurc
from evalspark.plans.prims import prefix_scan


def apply_temperature(pred: DataFrame, temperatures: DataFrame, keys: list[str]) -> DataFrame:
    """C11: ``calibrated`` = sigmoid(logit / temperature); parameters are a table by ``keys``, null where it has none."""
    met = pred.join(small(temperatures.select(*keys, F.col("temperature").alias("__t"))), keys, "left")
    return met.withColumn("calibrated", sigmoid(F.col("logit") / F.col("__t"))).drop("__t")


def apply_sigmoid_scaling(pred: DataFrame, scales: DataFrame, keys: list[str]) -> DataFrame:
    """C11: ``calibrated`` = sigmoid(slope * logit + intercept), by a table of parameters."""
    table = scales.select(*keys, F.col("slope").alias("__a"), F.col("intercept").alias("__b"))
    met = pred.join(small(table), keys, "left")
    return met.withColumn("calibrated", sigmoid(F.col("__a") * F.col("logit") + F.col("__b"))).drop("__a", "__b")


def decide(pred: DataFrame, thresholds: DataFrame, keys: list[str], score: str = "prob") -> DataFrame:
    """``decision`` = 1 where the score reaches its threshold, by a table of thresholds; null without one."""
    met = pred.join(small(thresholds.select(*keys, F.col("threshold").alias("__t"))), keys, "left")
    return met.withColumn("decision", (F.col(score) >= F.col("__t")).cast("int")).drop("__t")


def record_energy(pred: DataFrame, keys: list[str], temperature: float) -> DataFrame:
    """C14: mean symmetric energy over each record's labels."""
    energy = symmetric_energy(F.col("logit"), temperature)
    return pred.groupBy(*keys).agg(F.avg(energy).alias("energy"))


def threshold_proximity(pred: DataFrame, thresholds: DataFrame, keys: list[str], record: list[str]) -> DataFrame:
    """Minus the distance of a record's nearest label to its threshold (0: on it)."""
    met = pred.join(small(thresholds.select(*keys, F.col("threshold").alias("__t"))), keys)
    return met.groupBy(*record).agg((-F.min(F.abs(F.col("prob") - F.col("__t")))).alias("proximity"))


def label_errors(decided: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Error rate of the decisions on each label."""
    wrong = (F.col("decision") != F.col("target")).cast("double")
    return decided.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"), F.avg(wrong).alias("error"))


def ensemble_uncertainty(pred: DataFrame, record: list[str], label: str) -> DataFrame:
    """Per record the means over labels of total entropy, mean member entropy (aleatoric), their difference
    (epistemic, at least 0) and member variance, and the greatest epistemic one."""
    p = F.col("prob")
    members = pred.groupBy(*record, label).agg(
        F.avg(p).alias("__p"), F.avg(entropy(p)).alias("__aleatoric"), F.var_pop(p).alias("__variance")
    )
    members = members.withColumn("__total", entropy(F.col("__p")))
    members = members.withColumn("__epistemic", F.greatest(F.col("__total") - F.col("__aleatoric"), F.lit(0.0)))
    means = [F.avg(f"__{k}").alias(f"mean_{k}") for k in ("total", "aleatoric", "epistemic", "variance")]
    return members.groupBy(*record).agg(*means, F.max("__epistemic").alias("max_epistemic"))


def risk_curve_mean(curves: DataFrame, keys: list[str], risk: str) -> DataFrame:
    """Mean of the curves of several members at equal coverage index ``k``."""
    return curves.groupBy(*keys, "k").agg(F.avg("coverage").alias("coverage"), F.avg(risk).alias(risk), F.count(F.lit(1)).alias("members"))


def score_quantiles(rows: DataFrame, keys: list[str], score: str, levels: list[float]) -> DataFrame:
    """(keys, i, value): exact quantiles, between neighbours in proportion.

    Scores collapse by tie and are ranked by ``prefix_scan``; each tie gives its share to the quantiles whose two ranks
    fall in it, so no task ever holds the scores of a key.
    """
    ties = rows.where(F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    run = prefix_scan(ties, keys, [F.col("__v")], {"__seen": F.col("__n")})
    first, last = F.col("__seen") - F.col("__n"), F.col("__seen") - 1  # ranks from 0 on

    def weight(level: float) -> Column:
        at = (F.col("__seen_total") - 1) * F.lit(level)
        low, part = F.floor(at), at - F.floor(at)
        in_ = lambda rank: (rank >= first) & (rank <= last)
        return F.when(in_(low), 1 - part).otherwise(0.0) + F.when(in_(low + 1), part).otherwise(0.0)

    shares = F.array(*[F.struct(F.lit(i).alias("i"), weight(q).alias("w")) for i, q in enumerate(levels)])
    met = run.select(*keys, "__v", F.explode(F.filter(shares, lambda x: x["w"] > 0)).alias("__s"))
    return met.groupBy(*keys, F.col("__s.i").alias("i")).agg(F.sum(F.col("__s.w") * F.col("__v")).alias("value"))


def logit_drift(pairs: DataFrame, keys: list[str], a: str, b: str, level: float = 0.95) -> DataFrame:
    """Mean, quantile, largest and root mean square of the absolute difference of two columns."""
    away = pairs.select(*keys, F.abs(F.col(b) - F.col(a)).alias("__x"))
    x = F.col("__x")
    means = away.groupBy(*keys).agg(F.avg(x).alias("mean"), F.max(x).alias("largest"), F.sqrt(F.avg(x * x)).alias("rms"))
    at = score_quantiles(away, keys, "__x", [level]).select(*keys, F.col("value").alias("quantile"))
    return means.join(at, keys)


def compare_scores(losses: DataFrame, keys: list[str], scores: list[str], names: list[str]) -> DataFrame:
    """For each loss the uncertainty scores by excess area under the risk curve, least first: rank, score, areas.

    ``losses`` has a column for each score and loss. The result has a row for each key, score and loss.
    """
    def stacked(columns: list[str], what: str, value: str) -> Column:
        return F.explode(F.array(*[F.struct(F.lit(c).alias(what), F.col(c).cast("double").alias(value)) for c in columns]))

    by_score = losses.select("*", stacked(scores, "score", "uncertainty").alias("__s"))
    long = by_score.select(*keys, "record_id", "__s.score", "__s.uncertainty", stacked(names, "loss", "value").alias("__l"))
    rows = long.select(*keys, "record_id", "score", "uncertainty", "__l.loss", "__l.value")
    areas = excess_aurc(rows, [*keys, "loss", "score"], "value")
    rank = F.row_number().over(Window.partitionBy(*keys, "loss").orderBy(F.round("excess_aurc", 12), "score"))
    return areas.withColumn("rank", rank)
