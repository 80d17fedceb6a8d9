"""Reviews, studies, logs, keyed assignment, and signal operators that need Arrow functions."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.operators.joins import small

def review_summary(reviews: DataFrame, least: int) -> DataFrame:
    """Per proposal with enough reviews its rating moments and share of agreeing pairs, from counts alone."""
    cells = reviews.groupBy("proposal", "rating").agg(F.count(F.lit(1)).alias("n"))
    out = cells.groupBy("proposal").agg(
        F.sum("n").alias("reviews"), F.sum(F.col("n") * F.col("rating")).alias("s"), F.sum(F.col("n") * F.col("rating") * F.col("rating")).alias("q"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("same")
    )
    n = F.col("reviews")
    mean = F.col("s") / n
    return out.where(n >= least).select("proposal", "reviews", mean.alias("mean"), F.sqrt(F.greatest(F.col("q") / n - mean * mean, F.lit(0.0))).alias("sd"), (F.col("same") / (n * (n - 1) / 2)).alias("agreement"))


def study_summary(answers: DataFrame, least: int) -> DataFrame:
    """Per arm accuracy, time and confidence error; null below ``least`` participants."""
    out = answers.groupBy("arm").agg(
        F.count_distinct("participant").alias("participants"), F.avg(F.col("correct").cast("double")).alias("accuracy"), F.avg("time_ms").alias("mean_time"), F.median("time_ms").alias("median_time"),
        F.avg((F.col("confidence") - F.col("correct")) * (F.col("confidence") - F.col("correct"))).alias("confidence_brier"),
    )
    enough = F.col("participants") >= least
    return out.select("arm", "participants", *[F.when(enough, F.col(c)).alias(c) for c in ("accuracy", "mean_time", "median_time", "confidence_brier")])


def paired_differences(answers: DataFrame, arm_a: str, arm_b: str) -> DataFrame:
    """Each participant's accuracy in one arm less that in the other."""
    wide = answers.groupBy("participant").pivot("arm", [arm_a, arm_b]).agg(F.avg(F.col("correct").cast("double")))
    return wide.where(F.col(arm_a).isNotNull() & F.col(arm_b).isNotNull()).select("participant", (F.col(arm_a) - F.col(arm_b)).alias("difference"))


def route_counts(df: DataFrame, dims: list[str], values: list[DataFrame]) -> DataFrame:
    """Counts of every combination, zeros included; the value tables are small dimensions."""
    grid = values[0]
    for v in values[1:]:
        grid = grid.join(small(v), F.lit(True))
    counts = df.groupBy(*dims).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, dims, "left").fillna(0, ["n"])


def pseudonymize(c: Column, key: bytes, domain: str) -> Column:
    """Keyed token of a value. The key lives in the function's closure, never in the plan's text."""

    @F.pandas_udf("string")
    def token(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else hmac.new(key, f"{domain}|{x}".encode(), hashlib.sha256).hexdigest())

    return token(c.cast("string"))


def row_identity(cols: list[str]) -> Column:
    """C20: hash of a row's canonical form."""
    return F.sha2(F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"}), 256)


def verify_chain(log: DataFrame) -> DataFrame:
    """Entries whose sequence jumps or whose previous hash isn't that of the entry before; genesis has none.

    Each entry meets its predecessor by an equality join on the sequence, so no task orders the whole log.
    """
    before = log.select((F.col("sequence") + 1).alias("sequence"), F.col("entry_hash").alias("expected"), F.lit(True).alias("has_before"))
    first = log.agg(F.min("sequence").alias("first"))
    met = log.join(before, "sequence", "left").join(F.broadcast(first), F.lit(True))
    genesis = F.col("sequence") == F.col("first")
    fault = F.when(~genesis & F.col("has_before").isNull(), "gap").when(genesis & (F.col("previous_entry_hash") != ""), "genesis").when(~genesis & ~F.col("previous_entry_hash").eqNullSafe(F.col("expected")), "hash")
    return met.select("sequence", fault.alias("fault")).where("fault IS NOT NULL")


def keyed_order(participants: DataFrame, cases: DataFrame, key: str) -> DataFrame:
    """Each participant's cases in an order by keyed hash; a case list is small, so the window is a participant's."""
    pairs = participants.join(small(cases), F.lit(True))
    order = F.sha2(F.concat_ws("|", F.lit(key), F.col("participant").cast("string"), F.col("case_id").cast("string")), 256)
    return pairs.select("participant", "case_id", F.row_number().over(Window.partitionBy("participant").orderBy(order)).alias("ordinal"))


def greedy_cells(df: DataFrame, cell: str, patient: str, record: str, size: int, salt: str) -> DataFrame:
    """In hash order take a record if its cell isn't full and its patient unused.

    Only the first record of each cell and patient can be taken, and only the first cells * size patients of a cell can
    matter, so the greedy pass runs over at most cells ** 2 * size rows.
    """
    h = F.sha2(F.concat_ws("|", F.lit(salt), F.col(record).cast("string")), 256)
    firsts = df.groupBy(cell, patient).agg(F.min(F.struct(h.alias("h"), F.col(record).alias("r"))).alias("x")).select(cell, patient, "x.h", "x.r")
    n_cells = df.select(cell).distinct().count()
    ranked = firsts.withColumn("i", F.row_number().over(Window.partitionBy(cell).orderBy("h"))).where(F.col("i") <= n_cells * size)

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        full, used, out = {}, set(), []
        for row in pdf.sort_values("h").itertuples():
            c, p = getattr(row, "c"), getattr(row, "p")
            if full.get(c, 0) < size and p not in used:
                full[c] = full.get(c, 0) + 1
                used.add(p)
                out.append((c, p, row.r))
        return pd.DataFrame(out, columns=["cell", "patient", "record"])

    few = ranked.select(F.col(cell).cast("string").alias("c"), F.col(patient).cast("long").alias("p"), "h", F.col("r").cast("long").alias("r"))
    return few.groupBy().applyInPandas(take, "cell string, patient long, record long")


def batch_score(
    wave: DataFrame, predictor: Callable[[np.ndarray], np.ndarray], labels: list[str], leads: int, n_samples: int
) -> DataFrame:
    """Outputs of a caller's frozen predictor over batches of records, and ``reason``.

    The predictor takes an array of records times leads * n_samples, leads in order. Every record comes back: one with
    other leads than 0 to leads - 1 once each, another length, or a value that isn't finite, has null outputs and says
    why.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = pd.DataFrame(np.nan, index=pdf.index, columns=labels, dtype=float).astype(object).where(lambda x: x.notna(), None)
            use = pdf["reason"].isna()
            if use.any():
                out.loc[use, labels] = predictor(np.stack(pdf.loc[use, "x"].to_numpy()).astype(float))
            yield out.assign(record_id=pdf["record_id"], reason=pdf["reason"])

    lists = wave.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("lead_idx", "samples"))).alias("l"))
    numbers = F.transform("l", lambda x: x["lead_idx"].cast("int"))
    flat = F.flatten(F.transform("l", lambda x: F.transform(x["samples"], lambda v: v.cast("double"))))
    odd = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    lengths = F.forall("l", lambda x: F.coalesce(F.size(x["samples"]) == n_samples, F.lit(False)))
    reason = (
        F.when(numbers != F.sequence(F.lit(0), F.lit(leads - 1)), "leads").when(~lengths, "length").when(odd, "not_finite")
    )
    rows = lists.withColumn("x", flat).select("record_id", reason.alias("reason"), "x")
    schema = "record_id long, " + ", ".join(f"{x} double" for x in labels) + ", reason string"
    return rows.mapInPandas(run, schema).select("record_id", *labels, "reason")


def nearest_earlier_lead(wave: DataFrame) -> DataFrame:
    """For each lead the earlier lead of its record with the least greatest difference; a record has few leads."""
    leads = wave.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("lead_idx", "samples"))).alias("l"))
    pairs = leads.select("record_id", F.explode("l").alias("b"), "l").select("record_id", "b", F.explode(F.filter("l", lambda x: x["lead_idx"] < F.col("b.lead_idx"))).alias("a"))
    far = F.array_max(F.zip_with("a.samples", "b.samples", lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
    return pairs.select("record_id", F.col("b.lead_idx").alias("lead_idx"), F.col("a.lead_idx").alias("earlier"), far.alias("d")).groupBy("record_id", "lead_idx").agg(F.min("d").alias("distance"), F.min_by("earlier", F.struct("d", "earlier")).alias("earlier"))


def normalize_attributions(maps: DataFrame, eps: float = 1e-12) -> DataFrame:
    """Q17: each record's map divided by its largest absolute value over all leads."""
    top = maps.groupBy("record_id").agg(F.max(F.array_max(F.transform("samples", lambda v: F.abs(v.cast("double"))))).alias("m"))
    return maps.join(top, "record_id").withColumn("samples", F.transform("samples", lambda v: v.cast("double") / F.greatest(F.col("m"), F.lit(eps)))).drop("m")
