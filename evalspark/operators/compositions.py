"""Operators made of others: the calibration pipeline, candidate gates, curve summaries, the sample UDTF."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from evalspark.functions.expressions import hash_split, sigmoid
from evalspark.operators.joins import small
from evalspark.operators import metrics as m
from evalspark.operators import selective as s
from evalspark.operators.fits import fit_temperature
from evalspark.operators.waves import curve_auc, perturbation_metrics
from evalspark.plans.scratch import materialise


def source_calibration(pred: DataFrame, salt: str, coverage: float, alpha: float) -> DataFrame:
    """Roles by salted hash of the patient; temperature, thresholds and gate on A, conformal sets on B, and an
    untuned evaluation on C: per label ranking, coverage of the sets, and whether both classes give evidence."""
    # written once: the search for the temperature reads its part in every pass
    roles = materialise(pred.withColumn("role", hash_split(F.col("patient_id"), salt)), "roles")
    a = roles.where("role = 'A'")
    heat = fit_temperature(a, ["model_id"])
    tempered = materialise(roles.join(small(heat), "model_id").withColumn("prob", F.round(sigmoid(F.col("logit") / F.col("temperature")), 9)), "tempered")
    first, second, third = (tempered.where(F.col("role") == r) for r in "ABC")
    thresholds = s.fit_thresholds(first, ["model_id", "label"]).select("model_id", "label", "threshold")
    decide = lambda df: df.join(small(thresholds), ["model_id", "label"]).withColumn("decision", (F.col("prob") >= F.col("threshold")).cast("int"))
    gate = s.fit_entropy_gate(m.record_losses(decide(first), ["model_id"]).withColumn("uncertainty", F.round("uncertainty", 9)), ["model_id"], coverage).select("model_id", F.col("cutoff").alias("gate"))
    sets = s.predict_sets(third, s.fit_conformal(second, ["model_id", "label"], alpha), ["model_id", "label"])
    marginal = s.evaluate_sets(sets, ["model_id", "label"]).select("model_id", "label", "coverage", "mean_size")
    out = m.prevalence(third, ["model_id", "label"]).join(m.roc_auc(third, ["model_id", "label"]), ["model_id", "label"]).join(marginal, ["model_id", "label"])
    return out.join(small(gate), "model_id").join(small(heat), "model_id").withColumn("evidence", F.coalesce("reason", F.lit("both_classes"))).drop("reason")


def candidate_gate(orig: DataFrame, cand: DataFrame, quality: DataFrame, most_rms: float, most_step: float) -> DataFrame:
    """Q18: why a changed record may not be used: its quality, or how far it is from the original."""
    met = perturbation_metrics(orig, cand).join(quality.select("record_id", "status"), "record_id", "left")
    reasons = F.array_compact(F.array(
        F.when(F.col("status").isNull(), "quality_missing").when(F.col("status") == "REACQUIRE", "quality"), F.when(F.col("rms") > most_rms, "rms"), F.when(F.col("largest") > most_step, "largest"), F.when(F.col("changed") == 0, "unchanged"),
    ))
    return met.select("record_id", F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) == 0).alias("admissible"))


def explanation_summary(curves: DataFrame) -> DataFrame:
    """Mean area of each method's curves by label, and its advantage over the method ``random``."""
    areas = curves.withColumn("area", curve_auc(F.col("fractions"), F.col("values"))).groupBy("method", "label").agg(F.avg("area").alias("area"), F.count(F.lit(1)).alias("n"))
    base = areas.where("method = 'random'").select("label", F.col("area").alias("base"))
    return areas.join(small(base), "label", "left").select("method", "label", "n", "area", (F.col("area") - F.col("base")).alias("advantage"))


@udtf(returnType="i int, t double, value double")
class ExplodeWave:
    """One row for each sample of an array, with its time; for SQL: ``FROM t, LATERAL ev_explode_wave(samples, fs)``."""

    def eval(self, samples, fs):
        for i, v in enumerate(samples or []):
            yield i, float(i) / float(fs), None if v is None else float(v)
