"""Gapless numbers inside groups of any size, without one task for a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a salt of a piece holds at least, where the piece has so many.
ROWS_PER_SALT = 20_000


def number_within(df: DataFrame, group: str, piece: Column, order: list[Column], out: str) -> DataFrame:
    """Adds ``out``: 0, 1, 2, ... inside each value of ``group``, in the order of ``piece`` (a whole number).

    A piece of many rows is dealt to salts by a hash of ``order``, sqrt(rows) of them at most; each is numbered in its
    own task in the order of ``order`` and shifted by the rows of the pieces and salts before it. So a piece that fits
    one salt is in order throughout, and neither the rows of a salt nor the table of a group's salts grow faster than
    the square root of the largest piece (the table: than the number of pieces).
    """
    at = [F.col(group).alias("__g"), F.col("__piece").alias("__p")]
    pieced = df.withColumn("__piece", piece.cast("long"))
    counts = pieced.groupBy(*at).agg(F.count(F.lit(1)).alias("__n"))
    per_salt = F.greatest(F.lit(float(ROWS_PER_SALT)), F.sqrt("__n"))
    salts = counts.select("__g", "__p", F.ceil(F.col("__n") / per_salt).alias("__salts"))
    same = F.col(group).eqNullSafe(F.col("__g")) & (F.col("__piece") == F.col("__p"))
    salted = pieced.join(salts, same).withColumn("__salt", F.pmod(F.xxhash64(*order), F.col("__salts")).cast("int"))
    salted = salted.drop("__g", "__p", "__salts")
    sums = salted.groupBy(*at, F.col("__salt").alias("__s")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__g").orderBy("__p", "__s").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("__g", "__p", "__s", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(group, "__piece", "__salt").orderBy(*order)) - 1
    numbered = salted.withColumn("__i", inside).join(offsets, same & (F.col("__salt") == F.col("__s")))
    placed = numbered.withColumn(out, (F.col("__i") + F.col("__before")).cast("long"))
    return placed.drop("__piece", "__salt", "__i", "__g", "__p", "__s", "__before")
