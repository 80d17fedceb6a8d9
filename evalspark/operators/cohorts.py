"""Cohorts and their summaries: selection, class balance, manifests, inventories, and set operations on ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cohort_status(length: Column, expected: int, mapped: Column, ambiguous: Column | None, conflict: Column | None) -> Column:
    """why a record is left out of a cohort, the first reason in fixed order; null for one that is selected.

    ``mapped`` and ``ambiguous`` count target codes, ``conflict`` is a flag; None leaves a check out.
    """
    no = F.lit(False)
    out = F.when(~F.coalesce(length == expected, no), "length").when(~F.coalesce(mapped > 0, no), "no_mapped_target")
    if ambiguous is not None:
        out = out.when(F.coalesce(ambiguous > 0, no), "ambiguous_target")
    if conflict is not None:
        out = out.when(F.coalesce(conflict, no), "conflicting_targets")
    return out


def select_cohort(manifest: DataFrame, status: Column) -> DataFrame:
    """the records that ``cohort_status`` leaves in."""
    return manifest.where(status.isNull())


def cohort_exclusions(manifest: DataFrame, status: Column) -> DataFrame:
    """(status, n) with ``selected`` for the records that stay."""
    return manifest.groupBy(F.coalesce(status, F.lit("selected")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def require_labeled(rows: DataFrame, key: str, positive: Column) -> DataFrame:
    """the rows of records that have at least one positive label."""
    return rows.join(rows.where(positive).select(key).distinct(), key, "left_semi")


def class_balance(rows: DataFrame, label: str, target: str, cap: float | None = None) -> DataFrame:
    """Weight of positives (negatives a positive, at most ``cap``) by label; null without positives."""
    counts = rows.groupBy(label).agg(F.sum(F.col(target).cast("long")).alias("__p"), F.count(F.lit(1)).alias("__n"))
    weight = F.when(F.col("__p") > 0, (F.col("__n") - F.col("__p")) / F.col("__p"))
    capped = F.least(weight, F.lit(float(cap))) if cap is not None else weight
    return counts.select(label, F.when(weight.isNotNull(), capped).alias("pos_weight"))


def balance_violations(rows: DataFrame, fold: str, allowed: list[int]) -> DataFrame:
    """(fold, n) of rows that no weight may be learned from; a null fold is one of them."""
    bad = ~F.coalesce(F.col(fold).isin(*allowed), F.lit(False))
    return rows.where(bad).groupBy(fold).agg(F.count(F.lit(1)).alias("n"))


def manifest_summary(manifest: DataFrame, levels: list[str], patient: str) -> DataFrame:
    """Records and patients of each level and of all levels above it (null there)."""
    return manifest.rollup(*levels).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(patient).alias("patients"))


def label_histogram(positives: DataFrame, key: str, label: str, every: DataFrame) -> DataFrame:
    """(n_labels, records): how many of the records ``every`` have so many distinct labels, 0 included."""
    per = positives.groupBy(key).agg(F.count_distinct(label).alias("n_labels"))
    met = every.select(key).distinct().join(per, key, "left").fillna(0, ["n_labels"])
    return met.groupBy("n_labels").agg(F.count(F.lit(1)).alias("records"))


def inventory(records: DataFrame, dims: list[str], fs: str, samples: str, patient: str) -> DataFrame:
    """Counts by every combination of dimensions (null: all of them): records, sampling rates, range of durations
    in seconds, and records without a patient. Nothing in it names a record or a patient."""
    duration = F.col(samples) / F.col(fs)
    return records.cube(*dims).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(fs).alias("n_fs"), F.min(duration).alias("shortest"),
        F.max(duration).alias("longest"), F.count_if(F.col(patient).isNull()).alias("no_patient"),
    )


def union_manifests(parts: list[DataFrame], order: list[str]) -> DataFrame:
    """All rows of the sites' manifests under one schema, in canonical order; a column that a site lacks is null."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.orderBy(*order)


def overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys that both have."""
    return a.select(*keys).intersect(b.select(*keys))


def key_diff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side) of distinct keys that only one has: ``only_a`` or ``only_b``."""
    left, right = a.select(*keys).distinct(), b.select(*keys).distinct()
    only = lambda x, y, side: x.exceptAll(y).withColumn("side", F.lit(side))
    return only(left, right, "only_a").unionByName(only(right, left, "only_b"))


def distinct_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """The distinct combinations of columns."""
    return df.select(*cols).distinct()


def unscheduled_responses(schedule: DataFrame, response: DataFrame) -> DataFrame:
    """Responses that break the schedule: of an unknown participant, or of a trial that isn't theirs."""
    strange = response.join(schedule.select("participant", "trial"), ["participant", "trial"], "left_anti")
    known = schedule.select("participant").distinct().withColumn("__known", F.lit(True))
    met = strange.join(known, "participant", "left")
    problem = F.when(F.col("__known"), "unknown trial").otherwise("unknown participant")
    return met.withColumn("problem", problem).drop("__known")


def undecided(decisions: DataFrame, keys: list[str], reviewed: Column) -> DataFrame:
    """Decisions that may not be used yet, since nobody reviewed them."""
    return decisions.where(~F.coalesce(reviewed, F.lit(False))).select(*keys)
