"""Audits of frozen models.

Predictions become one row for each record, with its labels inside where a table needs them. Every table of an audit is
read from a histogram over those rows, written when it is asked for: first by the whole set of groups that a record is in
and by the gates (or asked coverages) that let it pass, then by group. Groups are the whole and every group of every
attribute; only the first histogram, not the records, is repeated for each of them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.operators.joins import small
from evalspark.operators.metrics import METRICS, entropy, log_loss_term, metrics_of_hist, reliability_curve
from evalspark.operators.selective import area_of_ties, dense_curve
from evalspark.plans.prims import prefix_scan
from evalspark.plans.scratch import materialise

#: The attribute and group that stand for all records.
WHOLE = "all"
MISSING = "<MISSING>"
#: Entropies are compared with gates after rounding to this many digits.
DIGITS = 9
SMALL = "small_group_descriptive_only"
LOSSES = ["hamming", "exact_error"]


def audit_records(pred: DataFrame) -> DataFrame:
    """model_id, record_id, patient_id, uncertainty, wrong, cells, squares, logs, labels, hamming and exact_error of
    every record.

    ``pred`` has model_id, record_id, patient_id, label, target, raw (probability before calibration), prob and decision.
    ``uncertainty`` is the mean entropy of prob; squares and logs are sums over the record's cells. Nothing is written:
    a table that doesn't look into the labels doesn't collect them. Who reads many tables may materialise it.
    """
    label = F.struct("label", "target", "raw", "prob", "decision")
    wrong = (F.col("decision") != F.col("target")).cast("long")
    error = F.col("prob") - F.col("target")
    rows = pred.groupBy("model_id", "record_id").agg(
        F.first("patient_id").alias("patient_id"), F.round(F.avg(entropy(F.col("prob"))), DIGITS).alias("uncertainty"), F.sum(wrong).alias("wrong"), F.count(F.lit(1)).alias("cells"),
        F.sum(error * error).alias("squares"), F.sum(log_loss_term(F.col("prob"), F.col("target"))).alias("logs"), F.collect_list(label).alias("labels"),
    )
    return rows.withColumns({"hamming": F.col("wrong") / F.col("cells"), "exact_error": (F.col("wrong") > 0).cast("double")})


def both_kinds(pred: DataFrame) -> DataFrame:
    """model_id, record_id, label, target, kind (raw or calibrated) and prob: every prediction before and after
    calibration."""
    kinds = F.array(F.struct(F.lit("raw").alias("kind"), F.col("raw").alias("prob")), F.struct(F.lit("calibrated").alias("kind"), F.col("prob").alias("prob")))
    return pred.select("model_id", "record_id", "label", "target", F.explode(kinds).alias("k")).select("model_id", "record_id", "label", "target", "k.*")


def _selected(records: DataFrame, gates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records with ``passed``, whether they pass each of their model's gates, and those gates by model in that order."""
    own = small(gates.groupBy("model_id").agg(F.array_sort(F.collect_list(F.struct(F.negative("target_coverage").alias("o"), "target_coverage", "maximum_entropy"))).alias("gates")))
    met = records.join(own, "model_id")
    return met.withColumn("passed", F.transform("gates", lambda g: F.col("uncertainty") <= g["maximum_entropy"])).drop("gates"), own


def _ranked(records: DataFrame, coverages: list[float]) -> tuple[DataFrame, DataFrame]:
    """The same with shares of the records instead of gates: the ceil(c * n) least uncertain ones pass c.

    Ties of uncertainty are counted, and only the records of the few ties that hold a last record are put in order of
    record_id. So no table of all records is ordered; a record passes if it isn't above the last one.
    """
    fixed = materialise(records.drop("labels"), "unranked")
    ties = fixed.groupBy("model_id", "uncertainty").agg(F.count(F.lit(1)).alias("__m"))
    run = prefix_scan(ties, ["model_id"], [F.col("uncertainty")], {"__k": F.col("__m")})
    asked = F.explode(F.array(*[F.lit(float(c)) for c in coverages])).alias("target_coverage")
    last = F.ceil(F.round(F.col("target_coverage") * F.col("__k_total"), DIGITS))
    held = run.select("*", asked).withColumn("__last", last).where((F.col("__last") <= F.col("__k")) & (F.col("__last") > F.col("__k") - F.col("__m")))
    # a row for each model and coverage
    held = materialise(held.select("model_id", "uncertainty", "target_coverage", "__last", (F.col("__k") - F.col("__m")).alias("__before")), "held")
    edge = small(held.select(F.col("model_id").alias("__model"), F.col("uncertainty").alias("__u"), "__before").distinct())
    inside = fixed.join(edge, (F.col("model_id") == F.col("__model")) & F.col("uncertainty").eqNullSafe(F.col("__u"))).select("model_id", "__before", "uncertainty", "record_id")
    placed = prefix_scan(inside, ["model_id", "__before"], [F.col("record_id")], {"__place": F.lit(1).cast("long")})
    ends = placed.join(small(held.drop("uncertainty")), ["model_id", "__before"]).where(F.col("__before") + F.col("__place") == F.col("__last"))
    ends = materialise(ends.select("model_id", "target_coverage", F.struct("uncertainty", "record_id").alias("end")), "ends")
    every = fixed.select("model_id").distinct().select("model_id", asked)
    met = every.join(small(ends), ["model_id", "target_coverage"], "left")
    lists = met.groupBy("model_id").agg(F.array_sort(F.collect_list(F.struct(F.negative("target_coverage").alias("o"), "target_coverage", "end"))).alias("gates"))
    own = small(materialise(lists, "shares"))
    at = F.struct("uncertainty", "record_id")
    # nulls come first in the order of structs, as in the order of ties
    passed = F.transform("gates", lambda g: F.coalesce(at <= g["end"], F.lit(False)))
    return fixed.join(own, "model_id").withColumn("passed", passed).drop("gates"), own


def _grouped(rows: DataFrame, groups: DataFrame | None) -> DataFrame:
    """``rows`` with ``own``, the groups that they are in besides the whole, in a fixed order."""
    none = F.array().cast("array<struct<attribute:string,group_value:string>>")
    if groups is None:
        return rows.withColumn("own", none)
    named = F.struct(F.col("attribute").cast("string").alias("attribute"), F.coalesce(F.col("group_value").cast("string"), F.lit(MISSING)).alias("group_value"))
    lists = groups.groupBy("record_id").agg(F.array_sort(F.collect_set(named)).alias("own"))
    return rows.join(lists, "record_id", "left").withColumn("own", F.coalesce("own", none))


def _by_group(few: DataFrame) -> DataFrame:
    """Rows of a histogram by ``own`` once for the whole and once for each of those groups."""
    whole = F.array(F.struct(F.lit(WHOLE).alias("attribute"), F.lit(WHOLE).alias("group_value")))
    return few.withColumn("g", F.explode(F.concat(whole, "own"))).select("*", "g.attribute", "g.group_value").drop("g", "own")


_AT = ["model_id", "attribute", "group_value"]


@dataclass
class Audit:
    """Tables of an audit; each is small beside the predictions and made when it is asked for.

    ``members`` are the records with ``own`` and ``passed``, ``gates`` each model's gates in the order of ``passed``.
    """

    members: DataFrame
    gates: DataFrame

    def _cells(self, by: list[str], sums: list[str]) -> DataFrame:
        """Counts n and positives y of cells by model, group, ``by`` and ``sums``, of which the latter are a cell's."""
        cell = F.transform("labels", lambda x: F.struct(*[x[c].alias(c) for c in (*sums, "target")]))
        long = self.members.select("model_id", "own", *by, F.explode(cell).alias("c")).select("model_id", "own", *by, "c.*")
        few = long.groupBy("model_id", "own", *by, *sums).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("target").cast("long")).alias("y"))
        return _by_group(materialise(few, "audit-cells"))

    def sizes(self) -> DataFrame:
        """model_id, attribute, group_value, records and patients."""
        few = self.members.groupBy("model_id", "own", "patient_id").agg(F.count(F.lit(1)).alias("n"))
        one = _by_group(few).groupBy(*_AT, "patient_id").agg(F.sum("n").alias("n"))
        return one.groupBy(*_AT).agg(F.sum("n").alias("records"), F.count("patient_id").alias("patients"))

    def metrics(self, least_records: int = 1, least_patients: int = 1) -> DataFrame:
        """model_id, attribute, group_value, kind (raw or calibrated), label, patients, status, and A1 to
        A6; rows with label null have the means over the labels where a metric is defined.

        Groups below ``least_records`` records or ``least_patients`` patients keep their figures and say so in status.
        """
        kinds = F.array(F.struct(F.lit("raw").alias("kind"), F.col("raw").alias("p")), F.struct(F.lit("calibrated").alias("kind"), F.col("prob").alias("p")))
        cells = self._cells([], ["label", "raw", "prob"]).select(*_AT, "label", "n", "y", F.explode(kinds).alias("k"))
        hist = cells.groupBy(*_AT, "k.kind", "label", F.col("k.p").alias("prob")).agg(F.sum("n").alias("__n"), F.sum("y").alias("__y"))
        by_label = materialise(metrics_of_hist(hist, [*_AT, "kind", "label"]), "audit-metrics")
        counts = [F.sum(c).alias(c) for c in ("n", "positives", "negatives")]
        means = by_label.groupBy(*_AT, "kind").agg(*counts, *[F.avg(m).alias(m) for m in METRICS])
        means = means.withColumns({"label": F.lit(None).cast("string"), "reason": F.lit(None).cast("string")})
        enough = (F.col("records") >= least_records) & (F.col("patients") >= least_patients)
        out = by_label.unionByName(means).join(small(materialise(self.sizes(), "audit-groups")), _AT)
        return out.withColumn("status", F.when(enough, "ok").otherwise(SMALL))

    def selections(self) -> DataFrame:
        """model_id, attribute, group_value, target_coverage, maximum_entropy (null for shares), n, selected,
        abstained, coverage, hamming_risk, exact_match, brier and log_loss of the selected; null if none is."""
        names = ("wrong", "right", "cells", "squares", "logs")
        few = self.members.withColumn("right", (F.col("wrong") == 0).cast("long")).groupBy("model_id", "own", "passed").agg(F.count(F.lit(1)).alias("records"), *[F.sum(c).alias(c) for c in names])
        long = _by_group(materialise(few, "audit-records")).join(self.gates, "model_id").select("*", F.posexplode("gates").alias("i", "gate")).withColumn("on", F.get("passed", F.col("i")))
        on = F.col("on")
        picked = lambda c: F.sum(F.when(on, F.col(c)))
        rows = long.groupBy(*_AT, "gate").agg(F.sum("records").alias("n"), F.coalesce(picked("records"), F.lit(0)).alias("selected"), *[picked(c).alias(f"s_{c}") for c in names])
        entropy_ = F.col("gate.maximum_entropy") if "maximum_entropy" in self.gates.schema["gates"].dataType.elementType.names else F.lit(None).cast("double")
        cells = F.when(F.col("selected") > 0, F.col("s_cells"))
        return rows.select(
            *_AT, "gate.target_coverage", entropy_.alias("maximum_entropy"), "n", "selected", (F.col("n") - F.col("selected")).alias("abstained"), (F.col("selected") / F.col("n")).alias("coverage"),
            (F.col("s_wrong") / cells).alias("hamming_risk"), F.when(F.col("selected") > 0, F.col("s_right") / F.col("selected")).alias("exact_match"), (F.col("s_squares") / cells).alias("brier"), (F.col("s_logs") / cells).alias("log_loss"),
        )

    def prevalences(self) -> DataFrame:
        """model_id, attribute, group_value, target_coverage, label, accepted_prevalence and rejected_prevalence
        (null where no record is on that side)."""
        own = self._cells(["passed"], ["label"]).join(self.gates, "model_id").select(*_AT, "label", "n", "y", "passed", F.posexplode("gates").alias("i", "gate"))
        on = F.get("passed", F.col("i"))
        rate = lambda c: F.sum(F.when(c, F.col("y"))) / F.sum(F.when(c, F.col("n")))
        return own.withColumn("on", on).groupBy(*_AT, "gate.target_coverage", "label").agg(rate(F.col("on")).alias("accepted_prevalence"), rate(~F.col("on")).alias("rejected_prevalence"))


def _audit(selected: tuple[DataFrame, DataFrame], groups: DataFrame | None) -> Audit:
    rows, gates = selected
    return Audit(_grouped(rows, groups), gates)


def gate_audit(records: DataFrame, gates: DataFrame, groups: DataFrame | None = None) -> Audit:
    """The audit under frozen gates (model_id, target_coverage, maximum_entropy; a few for each model).

    ``records`` are of ``audit_records``; ``groups`` has record_id, attribute, group_value, a null value being MISSING.
    A model without gates is left out.
    """
    return _audit(_selected(records, gates), groups)


def coverage_audit(records: DataFrame, coverages: list[float], groups: DataFrame | None = None) -> Audit:
    """The audit under shares of all records: whether a record is kept is decided over the whole, not in its group."""
    return _audit(_ranked(records, coverages), groups)


@dataclass
class Curves:
    """A11, W3 to W5, A17 of the whole, from ``audit_records``: reliability, risk against coverage, its areas, and how
    well uncertainty finds errors. A table is made when it is asked for."""

    records: DataFrame
    bins: int

    @cached_property
    def reliability(self) -> DataFrame:
        """model_id, kind, label and ``bins`` bins of equal mass."""
        long = self.records.select("model_id", "record_id", F.explode("labels").alias("c")).select("model_id", "record_id", "c.*")
        return reliability_curve(both_kinds(long), ["model_id", "kind", "label"], self.bins)

    @cached_property
    def risk(self) -> DataFrame:
        """Every prefix of the records by uncertainty, then record_id."""
        return dense_curve(self.records.select("model_id", "record_id", "uncertainty", *LOSSES), ["model_id"], LOSSES)

    @cached_property
    def _ties(self) -> DataFrame:
        """Records and summed losses of every uncertainty of a model."""
        sums = [F.sum(n).cast("double").alias(n) for n in LOSSES]
        return materialise(self.records.groupBy("model_id", "uncertainty").agg(F.count(F.lit(1)).alias("__m"), *sums), "audit-ties")

    @cached_property
    def areas(self) -> DataFrame:
        """aurc and augrc of both losses."""
        of = lambda n: area_of_ties(self._ties.select("model_id", "uncertainty", "__m", F.col(n).alias("__l")), ["model_id"], "uncertainty")
        first, second = (of(n).withColumn("loss", F.lit(n)) for n in LOSSES)
        return first.unionByName(second)

    @cached_property
    def error_detection(self) -> DataFrame:
        """Ranking metrics of uncertainty against records with an error."""
        errors = self._ties.select("model_id", F.col("uncertainty").alias("prob"), F.col("__m").alias("__n"), F.col("exact_error").cast("long").alias("__y"))
        return metrics_of_hist(errors, ["model_id"]).select("model_id", "n", "positives", "negatives", "reason", "auroc", "average_precision")


def audit_curves(records: DataFrame, bins: int = 15) -> Curves:
    """The curves of records of ``audit_records``."""
    return Curves(records, bins)


def passes(gate: Column, uncertainty: Column) -> Column:
    """Whether a frozen gate lets a record pass."""
    return F.round(uncertainty, DIGITS) <= gate
