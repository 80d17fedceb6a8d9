"""How independent an evaluation is of a model's pretraining data: levels that merge under an order, with reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.operators.joins import small

#: Fixed: levels of overlap from least to worst, with the assessment and the claim that each allows.
LEVELS = (
    ("none", "no_disclosed_overlap", "no_disclosed_overlap_not_proof_of_independence"),
    ("undisclosed", "limited_undisclosed_overlap", "independence_not_established_incomplete_overlap_disclosure"),
    ("possible", "limited_possible_overlap", "independence_not_established_possible_pretraining_overlap"),
    ("confirmed", "non_independent_known_overlap", "non_independent_external_representation_comparison"),
)
#: Fixed: what a pair of datasets tells, the first that holds: condition, level and reason.
RULES = (
    ("same AND version = pre_version", 3, "exact_dataset_version_in_pretraining"),
    ("status = 'confirmed'", 3, "provider_disclosed_confirmed_overlap"),
    ("same", 2, "dataset_family_overlap_version_differs"),
    ("status = 'possible'", 2, "provider_disclosed_possible_overlap"),
    ("status IS NULL", 1, "dataset_pair_has_no_overlap_disclosure"),
)
OVERRIDDEN = "none_known_disclosure_overridden_by_exact_dataset_match"
ALL_DISCLOSED = "all_dataset_pairs_disclosed_none_known"


def dataset_family(name: Column) -> Column:
    """A dataset's name without case, blanks and punctuation."""
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]", "")


def overlap_pairs(local: DataFrame, pretrain: DataFrame, disclosed: DataFrame) -> DataFrame:
    """dataset, version, pre_dataset, pre_version, level (0 to 3) and reason of every local against every pretraining
    dataset; level 0 has no reason.

    ``local`` and ``pretrain`` have dataset and version, ``disclosed`` those four and a status (none_known, possible or
    confirmed; of several the worst counts). The tables are lists of datasets, whose sizes are counted before one is sent
    to the other. Names count as one family without case and punctuation; disclosures go by the exact names.
    """
    pre = pretrain.select(F.col("dataset").alias("pre_dataset"), F.col("version").alias("pre_version")).distinct()
    order = F.array(*[F.lit(s) for s in ("none_known", "possible", "confirmed")])
    told = disclosed.groupBy("dataset", "version", "pre_dataset", "pre_version").agg(F.max_by("status", F.array_position(order, F.col("status"))).alias("status"))
    pairs = local.select("dataset", "version").distinct().join(small(pre), F.lit(True)).join(small(told), ["dataset", "version", "pre_dataset", "pre_version"], "left")
    pairs = pairs.withColumn("same", dataset_family(F.col("dataset")) == dataset_family(F.col("pre_dataset")))
    found = F.coalesce(*[F.when(F.expr(test), F.struct(F.lit(level).alias("level"), F.lit(reason).alias("reason"))) for test, level, reason in RULES])
    rows = pairs.withColumn("found", found)
    override = (F.col("found.reason") == RULES[0][2]) & (F.col("status") == "none_known")
    reasons = F.array_compact(F.array(F.col("found.reason"), F.when(override, F.lit(OVERRIDDEN))))
    return rows.select("dataset", "version", "pre_dataset", "pre_version", F.coalesce("found.level", F.lit(0)).alias("level"), reasons.alias("reasons"))


def overlap_levels(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Keys, overlap, assessment, claim and sorted reasons: the worst level of the pairs of a key decides and all
    their reasons are told. With no keys, one row for a whole plan; without pairs nothing overlaps."""
    out = pairs.groupBy(*keys).agg(F.coalesce(F.max("level"), F.lit(0)).alias("level"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("reasons"))
    named = lambda i: F.get(F.array(*[F.lit(x[i]) for x in LEVELS]), F.col("level"))
    reasons = F.when(F.col("level") == 0, F.array(F.lit(ALL_DISCLOSED))).otherwise(F.col("reasons"))
    return out.select(*keys, named(0).alias("overlap"), named(1).alias("assessment"), named(2).alias("claim"), reasons.alias("reasons"))
