"""Validators: each returns a table of violations, empty if all is well. Nothing is raised on the driver."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """V1: identities that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def check_one_role_per_entity(df: DataFrame, entity: str, role: str) -> DataFrame:
    """V2, V3: entities in more than one role. Pairs are made distinct first, so a frequent entity stays small."""
    return df.select(entity, role).distinct().groupBy(entity).agg(F.count(role).alias("n_roles")).where("n_roles > 1")


def check_values(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """V4, V7, V8: one row for each rule that a row breaks; a rule that is null counts as broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(key, F.explode(broken).alias("violation"))


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def is_relative_path(c: Column) -> Column:
    """V7: not absolute, no drive, no step upwards, no empty part, no control characters."""
    return ~c.rlike(r"^[/\\]|^[A-Za-z]:|(^|[/\\])\.\.([/\\]|$)|//|[\x00-\x1F]|^$")


def is_iso_date(c: Column) -> Column:
    """V8: a day as yyyy-mm-dd that is the same after reading and writing it, so one that exists; false for null."""
    day = F.try_to_timestamp(c, F.lit("yyyy-MM-dd"))
    return F.coalesce(c.rlike(r"^\d{4}-\d{2}-\d{2}$") & (F.date_format(day, "yyyy-MM-dd") == c), F.lit(False))


def check_expected_counts(observed: DataFrame, expected: DataFrame, key: str, count: str) -> DataFrame:
    """V5: keys whose count differs from, or is missing on, either side."""
    both = observed.select(key, F.col(count).alias("observed")).join(expected.select(key, F.col(count).alias("expected")), key, "full_outer")
    return both.where(~F.col("observed").eqNullSafe(F.col("expected")))


def check_aligned(a: DataFrame, b: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """V6: rows of two tables that lack a partner or differ in a column."""
    left = a.select(*keys, F.struct(*cols).alias("l"))
    right = b.select(*keys, F.struct(*cols).alias("r"))
    status = F.when(F.col("l").isNull(), "missing_left").when(F.col("r").isNull(), "missing_right").when(~F.col("l").eqNullSafe(F.col("r")), "different")
    return left.join(right, keys, "full_outer").select(*keys, status.alias("status")).where("status IS NOT NULL")


def check_no_future_leak(timelines: DataFrame) -> DataFrame:
    """V9: timelines whose history ends after the index, whose future begins before it, or that share an encounter."""
    late = F.exists("history", lambda x: x["at"] > F.col("index_at"))
    early = F.exists("future", lambda x: x["at"] <= F.col("index_at"))
    ids = lambda c: F.transform(c, lambda x: x["id"])
    shared = F.arrays_overlap(ids("history"), ids("future"))
    ordered = F.array_sort("history") == F.col("history")
    return check_values(timelines, "patient_id", {"history_after_index": ~late, "future_before_index": ~early, "shared_encounter": ~shared, "unsorted": ordered})


def normalised(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def check_source_overlap(df: DataFrame, col: str, excluded: list[str]) -> DataFrame:
    """Values that name an excluded family, however they are written."""
    tokens = [re.sub("[^a-z0-9]", "", e.lower()) for e in excluded]
    hit = F.lit(False)
    for t in tokens:
        hit = hit | normalised(F.col(col)).contains(t)
    return df.select(col).distinct().where(hit)


def check_public_columns(df: DataFrame, forbidden: list[str]) -> DataFrame:
    """Forbidden names among the columns, and how many values of string columns hold one."""
    pattern = "(?i)(" + "|".join(forbidden) + ")"
    named = [c for c in df.columns if any(f.lower() in c.lower() for f in forbidden)]
    text = [c for c, t in df.dtypes if t == "string"]
    counts = df.agg(*[F.count_if(F.col(c).rlike(pattern)).alias(c) for c in text] or [F.lit(0).alias("none")])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_values"), F.lit(c in named).alias("named")) for c in text])
    return counts.select(F.inline(pairs)).where("n_values > 0 OR named")


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """name of the first rule, in order, that excludes a row; null if none does."""
    return F.coalesce(*[F.when(F.coalesce(excluded, F.lit(True)), F.lit(name)) for name, excluded in rules])


def eligibility_counts(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """rows for each reason, zeros included; reason ``eligible`` for the rest."""
    names = df.sparkSession.createDataFrame([(n,) for n, _ in rules] + [("eligible",)], "reason string")
    counts = df.groupBy(F.coalesce(first_reason(rules), F.lit("eligible")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return names.join(counts, "reason", "left").fillna(0, ["n"])
