"""Primitives for global order at scale: tie histograms, distributed prefix sums, clustered draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalspark.plans.scratch import materialise


def score_hist(df: DataFrame, keys: list[str], score: str, target: str) -> DataFrame:
    """One row for each distinct score: n, pos. Ties collapse here, so later steps see no record twice."""
    return df.groupBy(*keys, score).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(target).cast("long")).alias("pos"))


def prefix_scan(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Running sums (the row included) in ``order`` within ``keys``, and each sum's total as ``<name>_total``.

    Rows are range-partitioned by keys and order and written once, since a range sample is not stable under
    recomputation. Each piece is summed; the sums of earlier pieces, a table of keys times pieces, shift the running
    sums inside a piece. So no task ever holds all rows of a key.
    """
    ranged = df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("__piece", F.spark_partition_id())
    fixed = materialise(ranged, "ranged")
    pieces = fixed.groupBy(*keys, "__piece").agg(*[F.sum(c).alias(f"__s_{n}") for n, c in sums.items()])
    # at most (keys x partitions) rows stand in these two windows
    by_key = Window.partitionBy(*keys)
    earlier = by_key.orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    shifts = pieces.select(
        *keys, "__piece",
        *[F.coalesce(F.sum(f"__s_{n}").over(earlier), F.lit(0)).alias(f"__b_{n}") for n in sums],
        *[F.sum(f"__s_{n}").over(by_key).alias(f"{n}_total") for n in sums],
    )
    inside = Window.partitionBy(*keys, "__piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = fixed.withColumns({f"__r_{n}": F.sum(c).over(inside) for n, c in sums.items()})
    # by merging, since both sides come from one compressed file, whose size says too little for a broadcast
    joined = run.join(shifts.hint("merge"), [*keys, "__piece"])
    return joined.withColumns({n: F.col(f"__r_{n}") + F.col(f"__b_{n}") for n in sums}).drop("__piece", *[f"__{x}_{n}" for x in "rb" for n in sums])


def draw(seed: int, replicate: Column, place: Column) -> Column:
    """A whole number below 2 ** 32 fixed by seed, replicate and place; DuckDB can compute it as well."""
    text = F.concat_ws("|", F.lit(str(seed)), replicate.cast("string"), place.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def cluster_draws(spark: SparkSession, n_clusters: int, replicates: int, seed: int) -> DataFrame:
    """(b, cluster, weight): how often each of n_clusters is drawn in replicate b, with replacement."""
    grid = spark.range(replicates * n_clusters).select(F.expr(f"id DIV {n_clusters}").alias("b"), (F.col("id") % n_clusters).alias("j"))
    drawn = grid.select("b", (draw(seed, F.col("b"), F.col("j")) % n_clusters).alias("cluster"))
    return drawn.groupBy("b", "cluster").agg(F.count(F.lit(1)).alias("weight"))


def draw_sql(seed: int, b: str, j: str) -> str:
    return f"CAST(CAST('0x' || substr(md5('{seed}|' || CAST({b} AS VARCHAR) || '|' || CAST({j} AS VARCHAR)), 1, 8) AS UBIGINT) AS BIGINT)"
