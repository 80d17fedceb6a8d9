"""Packing into optimal length buckets.

Dynamic programming over the exact global histogram of lengths picks the bucket boundaries with the least padding. Inside each bucket documents fill batches up to a budget of padded tokens.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.batches import small_batches
from evalspark.llm.mixing import token_count
from evalspark.llm.numbering import number_within
from evalspark.plans.scratch import materialise

N_BUCKETS = 16
TOKEN_BUDGET = 32_768


def boundaries(lengths: list[int], counts: list[int], n_buckets: int) -> list[int]:
    """Indices of the last lengths of ``n_buckets`` buckets (one for each length, if there are fewer), with the least
    padding; ``lengths`` are distinct and rise, ``counts`` are their documents.

    A bucket pads its documents to its longest length. With N and S as the documents and tokens up to an index, the
    least padding of k buckets up to p is L(p) N(p) - S(p) plus the least, over the place q where the last one begins,
    of best(k - 1, q) + S(q) - L(p) N(q). In L(p) those are lines of falling slope, and L(p) rises with p, so a hull of
    lines gives all minima of a layer in one pass: time and memory are buckets times lengths.
    """
    m = len(lengths)
    n = [0, *accumulate(counts)]
    s = [0, *accumulate(x * c for x, c in zip(lengths, counts))]
    best: list[int | None] = [0] + [None] * m
    picks: list[list[int]] = []
    for _ in range(min(n_buckets, m)):
        new: list[int | None] = [None] * (m + 1)
        pick, hull, at = [0] * (m + 1), [], 0
        for p in range(1, m + 1):
            if best[p - 1] is not None:
                line = (-n[p - 1], best[p - 1] + s[p - 1], p - 1)
                while len(hull) > 1 and _hidden(hull[-2], hull[-1], line):
                    hull.pop()
                hull.append(line)
            if not hull:
                continue
            x = lengths[p - 1]
            at = min(at, len(hull) - 1)
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] <= hull[at][0] * x + hull[at][1]:
                at += 1
            new[p] = x * n[p] - s[p] + hull[at][0] * x + hull[at][1]
            pick[p] = hull[at][2]
        best = new
        picks.append(pick)
    cuts, p = [], m
    for pick in reversed(picks):
        cuts.append(p - 1)
        p = pick[p]
    return cuts[::-1]


def _hidden(a: tuple[int, int, int], b: tuple[int, int, int], c: tuple[int, int, int]) -> bool:
    """Whether the line b is nowhere below both a and c; slopes fall from a to c."""
    return (c[1] - a[1]) * (a[0] - b[0]) <= (b[1] - a[1]) * (a[0] - c[0])


def plan_buckets(lengths: DataFrame, n_buckets: int, budget: int) -> list[tuple[int, int, int]]:
    """(bucket, padded length, documents in a batch) from the exact histogram of the column n_tokens.

    One row for each distinct length comes to the driver. A corpus of T tokens has less than sqrt(2 T) of them.
    """
    rows = lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).orderBy("n_tokens").collect()
    ends = boundaries([r.n_tokens for r in rows], [r.n for r in rows], n_buckets)
    return [(i, rows[j].n_tokens, max(1, budget // max(1, rows[j].n_tokens))) for i, j in enumerate(ends)]


def pack(docs: DataFrame, n_buckets: int = N_BUCKETS, budget: int = TOKEN_BUDGET) -> DataFrame:
    """One row per document: doc_id, n_tokens, bucket, bucket_length, padding, batch, batch_slot.

    A batch holds as many documents of one bucket as fit the budget when padded; a document longer than the budget has
    a batch of its own, whole. All batches of a bucket but its last are full. Null and empty texts have length 0 and
    are packed like others, as are repeated rows; equal lengths always share a bucket; an empty table gives an empty
    result; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    counted = docs.select("doc_id", token_count(F.col("text")).alias("n_tokens"))
    lengths = materialise(counted.withColumn("row", F.monotonically_increasing_id()), "lengths")
    plan = plan_buckets(lengths, n_buckets, budget)
    schema = "bucket int, bucket_length long, per_batch long"
    limits = F.array(*[F.lit(p[1]).cast("long") for p in plan]) if plan else F.array().cast("array<bigint>")
    bucket = F.size(F.filter(limits, lambda x: x < F.col("n_tokens")))
    order = [F.xxhash64("doc_id"), F.col("row")]
    numbered = number_within(lengths.withColumn("bucket", bucket), "bucket", F.lit(0), order, "place")
    # one row for each bucket
    sized = numbered.join(F.broadcast(spark.createDataFrame(plan, schema)), "bucket")
    batch = F.expr("place DIV per_batch")
    return sized.select(
        "doc_id", "n_tokens", "bucket", "bucket_length", (F.col("bucket_length") - F.col("n_tokens")).alias("padding"),
        F.concat_ws("-", "bucket", batch.cast("string")).alias("batch"), (F.col("place") % F.col("per_batch")).cast("int").alias("batch_slot"),
    )
