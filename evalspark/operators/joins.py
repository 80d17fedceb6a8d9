"""Lookups, alignments, differences and set operations between tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a dimension may be broadcast; larger ones are joined by shuffle.
MAX_BROADCAST_ROWS = 100_000


def small(dim: DataFrame) -> DataFrame:
    """``dim`` with a broadcast hint if its counted size is within MAX_BROADCAST_ROWS, else with one to merge."""
    return F.broadcast(dim) if dim.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS else dim.hint("merge")


#: Rows of one piece of a table that is dealt out by ``in_pieces``.
PIECE_ROWS = 500_000


def in_pieces(df: DataFrame, rows: int = PIECE_ROWS) -> int:
    """Into how many pieces of ``rows`` rows ``df`` goes. Partitions that Spark sizes by compressed bytes can hold many
    times their size in memory; what is dealt into so many pieces takes the same memory in a task at any size."""
    return max(1, -(-df.count() // rows))


def patient_counts(rows: DataFrame, keys: list[str], patient: str, groups: str, sums: list[str], pieces: int) -> DataFrame:
    """(keys, fields of the groups, n, patients, sums): rows, distinct patients and the sums of columns in each
    group.

    ``groups`` is an array of structs: all groups of a row. A patient's rows of the same keys meet in one of ``pieces``,
    go to their groups only there and fall to one row in each, so that counts by group are all that is left to add up.
    """
    dealt = rows.select(patient, *keys, groups, *sums).repartition(pieces, patient, *keys)
    each = dealt.select(patient, *keys, *sums, F.explode(groups).alias("__g")).select(patient, *keys, *sums, "__g.*")
    at = [c for c in each.columns if c not in (patient, *sums)]
    cells = each.groupBy(patient, *at).agg(F.count(F.lit(1)).alias("n"), *[F.sum(s).alias(s) for s in sums])
    return cells.groupBy(*at).agg(F.sum("n").alias("n"), F.count(patient).alias("patients"), *[F.sum(s).alias(s) for s in sums])


def map_codes_to_labels(records: DataFrame, key: str, codes: str, dim: DataFrame) -> DataFrame:
    """Each record's labels by its codes, as an ordered list; excluded and unknown codes give none."""
    hits = records.select(key, F.explode_outer(codes).alias("code")).join(small(dim.where("action = 'map'")), "code", "left")
    return hits.groupBy(key).agg(F.concat_ws(",", F.array_sort(F.collect_set("label"))).alias("labels"), F.count_distinct("label").alias("n_labels"))


def mapping_status(n_mapped, n_ambiguous):
    """C4"""
    return F.when((n_mapped > 0) & (n_ambiguous > 0), "mapped_with_ambiguous").when(n_mapped > 0, "mapped").when(n_ambiguous > 0, "ambiguous_only").otherwise("unmapped")


def ontology_coverage(used: DataFrame, decided: DataFrame, keys: list[str]) -> DataFrame:
    """Keys used without a decision, and decisions that nothing uses."""
    a, b = used.select(*keys).distinct(), decided.select(*keys).distinct()
    missing, extra = a.join(b, keys, "left_anti"), b.join(a, keys, "left_anti")
    return missing.withColumn("side", F.lit("missing")).unionByName(extra.withColumn("side", F.lit("extra")))


def paired(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Both models' values side by side."""
    return a.select(*keys, F.col(value).alias(f"{value}_a")).join(b.select(*keys, F.col(value).alias(f"{value}_b")), keys)


def co_occurrence(positives: DataFrame, key: str, label: str) -> DataFrame:
    """Records with both labels, the diagonal included, from each record's own label list: no self join."""
    lists = positives.groupBy(key).agg(F.array_sort(F.collect_set(label)).alias("l"))
    pairs = lists.select(F.explode("l").alias("label_a"), "l").select("label_a", F.explode("l").alias("label_b")).where("label_a <= label_b")
    return pairs.groupBy("label_a", "label_b").agg(F.count(F.lit(1)).alias("n"))


def frozen_set_diff(frozen: DataFrame, candidate: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Rows added to, removed from or changed against a frozen set, by a hash of their columns."""
    row = F.sha2(F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"}), 256)
    both = frozen.select(key, row.alias("f")).join(candidate.select(key, row.alias("c")), key, "full_outer")
    status = F.when(F.col("f").isNull(), "added").when(F.col("c").isNull(), "removed").when(F.col("f") != F.col("c"), "changed")
    return both.select(key, status.alias("status")).where("status IS NOT NULL")


def table_fingerprint(df: DataFrame, cols: list[str]) -> DataFrame:
    """Row count and an order-free sum of row hashes; a row is hashed as JSON, which tells all values apart."""
    text = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in cols]), {"ignoreNullFields": "false"})
    row = F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(row).cast("string").alias("fingerprint"))


def completed_participants(schedule: DataFrame, response: DataFrame) -> DataFrame:
    """Responses of participants who answered every scheduled trial; unscheduled responses don't count."""
    known = response.join(schedule.select("participant", "trial"), ["participant", "trial"], "left_semi")
    need = schedule.groupBy("participant").agg(F.count_distinct("trial").alias("need"))
    have = known.groupBy("participant").agg(F.count_distinct("trial").alias("have"))
    full = need.join(have, "participant").where("need = have")
    return known.join(full, "participant", "left_semi")


def dataset_overlap(local: DataFrame, pretrain: DataFrame, disclosed: DataFrame) -> DataFrame:
    """Every local dataset against every pretraining one; the worst status wins.

    Both sides are small dimensions, so their product is; disclosures decide, an undisclosed pair stays possible.
    """
    pairs = small(local.select("dataset").distinct()).join(small(pretrain.select("pretrain").distinct()), F.lit(True))
    met = pairs.join(disclosed, ["dataset", "pretrain"], "left")
    rank = F.when(F.col("dataset") == F.col("pretrain"), 3).when(F.col("status") == "used", 3).when(F.col("status").isNull(), 1).otherwise(0)
    return met.groupBy("dataset").agg(F.max(rank).alias("rank")).withColumn("overlap", F.when(F.col("rank") == 3, "confirmed").when(F.col("rank") == 1, "undisclosed").otherwise("none")).drop("rank")
