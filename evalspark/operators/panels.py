"""Panels of reviewers, reader studies, and logs that carry their own proof."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.operators.joins import in_pieces
from evalspark.plans.scratch import materialise


def repeated_reviews(reviews: DataFrame) -> DataFrame:
    """(proposal, reviewer, n) where one reviewer judged a proposal more than once."""
    return reviews.groupBy("proposal", "reviewer").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def panel_summary(
    reviews: DataFrame, per_proposal: int, proposals: int, total: int, reviewers: int, threshold: float
) -> DataFrame:
    """One row about all reviews (proposal, reviewer, rating, useful, artifact) of proposals with at least
    ``per_proposal`` of them: counts, moments of the rating, rates, agreement of pairs on ``useful`` with its
    chance-corrected kappa, mean distance of pairs' ratings, and a status.

    Pairs are counted from votes and rating histograms of each proposal, which are written once, so none is ever made.
    Rows are dealt out by their number: a task's memory doesn't grow with the table. The status is
    ``threshold_met`` if there are enough proposals, reviews and reviewers and the share of useful votes reaches the
    threshold, ``descriptive_only`` if only the counts suffice, else ``insufficient``. Without an eligible proposal
    the moments are null.
    """
    pieces = in_pieces(reviews)
    useful, artifact = F.col("useful").cast("long"), F.col("artifact").cast("long")
    votes = reviews.repartition(pieces, "proposal", "rating").groupBy("proposal", "rating").agg(
        F.count(F.lit(1)).alias("n"), F.sum(useful).alias("u"), F.sum(artifact).alias("a")
    )
    votes = materialise(votes, "votes")
    own = Window.partitionBy("proposal")
    dealt = votes.where("proposal IS NOT NULL").repartition(in_pieces(votes), "proposal")
    below = own.orderBy("rating").rowsBetween(Window.unboundedPreceding, -1)
    lower, lower_sum = F.coalesce(F.sum("n").over(below), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("rating")).over(below), F.lit(0))
    apart = F.col("n") * (F.col("rating") * lower - lower_sum)
    cells = dealt.withColumns({"__all": F.sum("n").over(own), "apart": apart}).where(F.col("__all") >= per_proposal)
    panels = cells.groupBy("proposal").agg(*[F.sum(c).alias(c) for c in ("n", "u", "a", "apart")])
    two = lambda c: F.col(c) * (F.col(c) - 1) / 2
    no = F.col("n") - F.col("u")
    pairs = panels.agg(
        F.count(F.lit(1)).alias("eligible_proposals"), F.sum("n").alias("eligible_reviews"), F.sum("u").alias("u"),
        F.sum("a").alias("a"), F.sum("apart").alias("apart"), F.sum(two("n")).alias("pairs"),
        F.sum(two("u") + no * (no - 1) / 2).alias("agree"),
    )
    by_rating = cells.groupBy("rating").agg(F.sum("n").alias("n"))
    n, r = F.sum("n"), F.col("rating")
    mean = F.sum(F.col("n") * r) / n
    moments = by_rating.agg(
        mean.alias("mean_rating"), F.percentile("rating", 0.5, F.col("n")).alias("median_rating"),
        F.sqrt(F.greatest(F.sum(F.col("n") * r * r) / n - mean * mean, F.lit(0.0))).alias("rating_sd"),
    )
    seen = votes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_reviews"))
    # a piece holds fewer eligible proposals than it has reviews
    eligible = votes.repartition(pieces, "proposal").groupBy("proposal").agg(F.sum("n").alias("n")).where(F.col("n") >= per_proposal).select("proposal")
    kept = reviews.select("proposal", "reviewer").repartition(pieces, "proposal").join(eligible.hint("shuffle_hash"), "proposal", "left_semi")
    people = kept.agg(F.count_distinct("reviewer").alias("unique_reviewers"))
    # each of these has one row
    one = F.lit(1).alias("__one")
    tables = [t.select(one, "*") for t in (pairs, moments, seen, people)]
    met = tables[0]
    for t in tables[1:]:
        met = met.join(F.broadcast(t), "__one")
    reviews_, rate = F.coalesce("eligible_reviews", F.lit(0)), F.col("u") / F.col("eligible_reviews")
    agreement = F.when(F.col("pairs") > 0, F.col("agree") / F.col("pairs"))
    chance = rate * rate + (1 - rate) * (1 - rate)
    enough = (F.col("eligible_proposals") >= proposals) & (reviews_ >= total) & (F.col("unique_reviewers") >= reviewers)
    status = F.when(enough & F.coalesce(rate >= threshold, F.lit(False)), "threshold_met").when(enough, "descriptive_only").otherwise("insufficient")
    return met.select(
        status.alias("status"), "total_reviews", reviews_.cast("long").alias("eligible_reviews"), "eligible_proposals", "unique_reviewers",
        "mean_rating", "median_rating", "rating_sd", (F.col("a") / F.col("eligible_reviews")).alias("artifact_rate"),
        rate.alias("useful_rate"), agreement.alias("agreement"),
        F.when(chance < 1, (agreement - chance) / (1 - chance)).alias("kappa"),
        F.when(F.col("pairs") > 0, F.col("apart") / F.col("pairs")).alias("rating_distance"),
    )


def arm_summary(answers: DataFrame, least: int, bins: int = 10) -> DataFrame:
    """Per arm participants, accuracy, comprehension, over-reliance (share of answers that rely on the model where
    its state is blocked), mean and median time, and Brier score and calibration error of the confidence; null below
    ``least`` participants. ``answers``: arm, participant, correct, comprehended, blocked, relied, time_ms, confidence."""
    c, y = F.col("confidence"), F.col("correct").cast("double")
    flag = lambda name: F.col(name).cast("double")
    out = answers.groupBy("arm").agg(
        F.count_distinct("participant").alias("participants"), F.avg(y).alias("accuracy"),
        F.avg(flag("comprehended")).alias("comprehension"),
        F.avg(F.when(F.col("blocked").cast("boolean"), flag("relied"))).alias("over_reliance"),
        F.avg("time_ms").alias("mean_time"), F.median("time_ms").alias("median_time"),
        F.avg((c - y) * (c - y)).alias("confidence_brier"),
    )
    cell = F.least(F.floor(c * bins), F.lit(bins - 1)).alias("bin")
    cells = answers.groupBy("arm", cell).agg(F.count(F.lit(1)).alias("n"), F.abs(F.sum(c - y)).alias("gap"))
    error = cells.groupBy("arm").agg((F.sum("gap") / F.sum("n")).alias("confidence_ece"))
    enough = F.col("participants") >= least
    met = out.join(error, "arm")
    names = ("accuracy", "comprehension", "over_reliance", "mean_time", "median_time", "confidence_brier", "confidence_ece")
    return met.select("arm", "participants", *[F.when(enough, F.col(x)).alias(x) for x in names])


def entry_hash(previous: Column, content: Column) -> Column:
    """Hash of a log entry over the one before it and its own canonical content."""
    return F.sha2(F.concat_ws("|", F.coalesce(previous, F.lit("")), content), 256)


def chain_faults(log: DataFrame, content: Column, head: tuple[int, str] | None = None) -> DataFrame:
    """(sequence, fault) of a log (sequence, previous_entry_hash, entry_hash): ``self`` where an entry's hash isn't
    that of its content, ``repeated`` sequences, ``gap``, ``genesis`` and ``hash`` where an entry doesn't continue the
    one before, and ``head`` where the last entry isn't the checkpoint's (sequence, hash).

    Each entry meets its predecessor by an equality join on the sequence, so no task orders the whole log.
    """
    own = log.select("sequence", "previous_entry_hash", "entry_hash", entry_hash(F.col("previous_entry_hash"), content).alias("__own"))
    before = own.groupBy((F.col("sequence") + 1).alias("sequence")).agg(F.min("entry_hash").alias("__before"), F.count(F.lit(1)).alias("__n"))
    ends = own.agg(F.min("sequence").alias("__first"), F.max(F.struct("sequence", "entry_hash")).alias("__last"))
    # one row
    met = own.join(before, "sequence", "left").join(F.broadcast(ends), F.col("sequence") >= F.col("__first"))
    genesis, previous = F.col("sequence") == F.col("__first"), F.coalesce("previous_entry_hash", F.lit(""))
    faults = [
        F.when(~F.col("entry_hash").eqNullSafe(F.col("__own")), "self"), F.when(~genesis & F.col("__before").isNull(), "gap"),
        F.when(genesis & (previous != ""), "genesis"), F.when(F.col("__before").isNotNull() & (previous != F.col("__before")), "hash"),
    ]
    out = met.select("sequence", F.explode(F.array_compact(F.array(*faults))).alias("fault"))
    twice = own.groupBy("sequence").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("sequence", F.lit("repeated").alias("fault"))
    out = out.unionByName(twice)
    if head is None:
        return out
    last = ends.select(F.col("__last.sequence").alias("sequence"), F.col("__last.entry_hash").alias("h"))
    wrong = last.where(~(F.col("sequence").eqNullSafe(F.lit(head[0])) & F.col("h").eqNullSafe(F.lit(head[1]))))
    return out.unionByName(wrong.select("sequence", F.lit("head").alias("fault")))


def event_log_summary(log: DataFrame, known: dict[str, list[str]]) -> DataFrame:
    """(kind, value, n) without ids, times or attributes of events: how many events a log has, how many each value
    of the columns in ``known`` (zero where none has it; values that aren't listed are told as well), each reason code,
    and how many have no decision. One pass; the counts are few."""
    cell = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))
    none = F.lit(None).cast("string")
    own = [F.when(F.col(c).isNotNull(), cell(c, F.col(c))) for c in known]
    cells = F.concat(
        F.array_compact(F.array(cell("event", none), F.when(F.col("decision").isNull(), cell("without_decision", none)), *own)),
        F.transform(F.coalesce("reason_codes", F.array().cast("array<string>")), lambda r: cell("reason_code", r)),
    )
    counts = log.select(F.explode(cells).alias("c")).groupBy("c.kind", "c.value").agg(F.count(F.lit(1)).alias("n"))
    fixed = [("event", None), ("without_decision", None), *((k, v) for k, values in known.items() for v in values)]
    zeros = log.sparkSession.createDataFrame([(*f, 0) for f in fixed], "kind string, value string, n long")
    return counts.unionByName(zeros).groupBy("kind", "value").agg(F.sum("n").alias("n"))
