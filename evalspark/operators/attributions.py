"""How alike two sets of attribution maps are: signed cosine, and cosine and rank correlation of their time maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.operators.waves import doubles, let

EPS = 1e-12


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)


def _dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x * y))


def cosine(a: Column, b: Column, eps: float = EPS) -> Column:
    """Cosine within [-1, 1]; 1 if neither array has a norm above ``eps``."""
    na, nb = F.sqrt(_dot(a, a)), F.sqrt(_dot(b, b))
    value = _dot(a, b) / F.greatest(na * nb, F.lit(eps))
    return F.when((na <= eps) & (nb <= eps), 1.0).otherwise(F.greatest(F.least(value, F.lit(1.0)), F.lit(-1.0)))


def average_ranks(a: Column) -> Column:
    """Ranks from 1 of an array's values, ties sharing the mean of their places, in the array's own order."""
    none = F.array().cast("array<double>")
    start = F.struct(none.alias("ranks"), F.lit(None).cast("double").alias("v"), F.lit(0).alias("before"), F.lit(0).alias("n"))
    run = lambda acc: F.concat(acc["ranks"], F.array_repeat(acc["before"] + (acc["n"] + 1) / 2, acc["n"]))

    def step(acc: Column, x: Column) -> Column:
        tied = acc["v"].eqNullSafe(x["v"])
        return F.struct(
            F.when(tied, acc["ranks"]).otherwise(run(acc)).alias("ranks"), x["v"].alias("v"),
            F.when(tied, acc["before"]).otherwise(acc["before"] + acc["n"]).alias("before"), F.when(tied, acc["n"] + 1).otherwise(F.lit(1)).alias("n"),
        )

    def ranked(ordered: Column) -> Column:
        ranks = F.aggregate(ordered, start, step, run)
        return F.array_sort(F.zip_with(ordered, ranks, lambda x, r: F.struct(x["i"].alias("i"), r.alias("r"))))

    placed = let(F.array_sort(F.transform(a, lambda v, i: F.struct(v.alias("v"), i.alias("i")))), ranked)
    return F.transform(placed, lambda x: x["r"])


def centred(a: Column) -> Column:
    return let(a, lambda own: let(_total(own) / F.size(own), lambda mean: F.transform(own, lambda v: v - mean)))


def _records(maps: DataFrame, name: str) -> DataFrame:
    """One row for each record: its leads in order, and whether they are whole, of one length and finite."""
    lead = F.struct("lead_idx", doubles(F.col("samples")).alias("s"))
    rows = maps.groupBy("record_id").agg(F.array_sort(F.collect_list(lead)).alias("l"))
    odd = lambda x: x["s"].isNull() | F.exists(x["s"], lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    even = F.array_distinct(F.transform("l", lambda x: F.coalesce(F.size(x["s"]), F.lit(-1))))
    good = ~F.exists("l", odd) & (F.size(even) == 1) & (even[0] > 0)
    return rows.select("record_id", F.transform("l", lambda x: x["s"]).alias(name), F.transform("l", lambda x: x["lead_idx"]).alias(f"{name}_leads"), even[0].alias(f"{name}_n"), good.alias(f"{name}_good"))


def time_map(leads: Column) -> Column:
    """Mean absolute value over the leads at each place."""
    n = F.size(leads)
    zero = F.transform(leads[0], lambda _: F.lit(0.0))
    return F.transform(F.aggregate(leads, zero, lambda acc, s: F.zip_with(acc, s, lambda x, v: x + F.abs(v))), lambda v: v / n)


def attribution_similarity(a: DataFrame, b: DataFrame, eps: float = EPS) -> DataFrame:
    """Q13: record_id, cosine (of all leads, signed), time_cosine, spearman (both of the time maps) and whether each is
    valid: a time map that is zero has no cosine and a flat one no ranks; such values are 0.

    Records that one side lacks, or whose leads or lengths differ, have the reason ``unmatched``; those with null, uneven
    or not finite samples ``not_finite``; their values are null. One shuffle a side; the rest is inside a record's row.
    """
    met = _records(a, "a").join(_records(b, "b"), "record_id", "full_outer")
    same = F.coalesce((F.col("a_leads") == F.col("b_leads")) & (F.col("a_n") == F.col("b_n")), F.lit(False))
    good = F.coalesce(F.col("a_good") & F.col("b_good"), F.lit(False))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    reason = F.when(~both, "unmatched").when(~good, "not_finite").when(~same, "unmatched")
    rows = met.withColumn("reason", reason)
    able = F.col("reason").isNull()
    rows = rows.withColumns({"fa": F.when(able, F.flatten("a")), "fb": F.when(able, F.flatten("b")), "ta": F.when(able, time_map(F.col("a"))), "tb": F.when(able, time_map(F.col("b")))})
    rows = rows.withColumns({f"r{s}": centred(average_ranks(F.col(f"t{s}"))) for s in "ab"})
    norm = lambda c: F.sqrt(_dot(F.col(c), F.col(c)))
    valid = {"time_cosine": (norm("ta") > eps) & (norm("tb") > eps), "spearman": (norm("ra") > eps) & (norm("rb") > eps)}
    values = {"time_cosine": cosine(F.col("ta"), F.col("tb"), eps), "spearman": cosine(F.col("ra"), F.col("rb"), eps)}
    out = [c for n in values for c in (F.when(able, F.when(valid[n], values[n]).otherwise(0.0)).alias(n), valid[n].alias(f"{n}_valid"))]
    return rows.select("record_id", F.when(able, cosine(F.col("fa"), F.col("fb"), eps)).alias("cosine"), *out, "reason")
