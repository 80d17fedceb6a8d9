"""Leakage-safe cohorts over dated encounters, censoring-aware targets and risk evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.operators.metrics import average_precision, pointwise, roc_auc


def time_windows(occurred: Column, index: Column, history_days: int, horizon_days: int) -> tuple[Column, Column]:
    """In the history [index - h, index], in the future (index, index + H]."""
    day = lambda n: F.make_dt_interval(F.lit(n))
    return (occurred >= index - day(history_days)) & (occurred <= index), (occurred > index) & (occurred <= index + day(horizon_days))


def build_timelines(enc: DataFrame, index_at: str, history_days: int, horizon_days: int) -> DataFrame:
    """One row per patient with a history: history and future in time order, last history time, follow-up status.

    Complete if observed through the horizon's end; right-censored if observed beyond the index; else insufficient. One
    shuffle by patient; only encounters inside the windows are kept in arrays.
    """
    index = F.lit(index_at).cast("timestamp")
    past, later = time_windows(F.col("occurred_at"), index, history_days, horizon_days)
    item = F.struct(F.col("occurred_at").alias("at"), F.col("encounter_id").alias("id"), F.col("event_label").alias("label"))
    grouped = enc.groupBy("patient_id").agg(
        F.array_sort(F.collect_list(F.when(past, item))).alias("history"), F.array_sort(F.collect_list(F.when(later, item))).alias("future"),
        F.max(F.when(past, F.col("occurred_at"))).alias("last_history_at"), F.max("observed_through").alias("observed_through"),
    )
    end = index + F.make_dt_interval(F.lit(horizon_days))
    status = F.when(F.col("observed_through") >= end, "complete").when(F.col("observed_through") > index, "right_censored").otherwise("insufficient")
    return grouped.where(F.size("history") > 0).select("patient_id", index.alias("index_at"), "history", "future", "last_history_at", status.alias("follow_up"))


def future_targets(timelines: DataFrame, labels: list[str]) -> DataFrame:
    """L2: 1 if a listed label lies in the future, 0 only with complete follow-up, else null with the reason."""
    seen = F.exists("future", lambda x: x["label"].isin(*labels))
    outcome = F.when(seen, 1).when(F.col("follow_up") == "complete", 0)
    status = F.when(seen | (F.col("follow_up") == "complete"), "observed").when(F.col("follow_up") == "right_censored", "censored").otherwise("insufficient")
    return timelines.select("patient_id", outcome.alias("outcome"), status.alias("target_status"))


def temporal_split(timelines: DataFrame, first: str, second: str) -> DataFrame:
    """L3: development, calibration or evaluation by the last history time."""
    at = F.col("last_history_at")
    return timelines.select("patient_id", F.when(at < F.lit(first).cast("timestamp"), "development").when(at < F.lit(second).cast("timestamp"), "calibration").otherwise("evaluation").alias("split"))


def means_in_order(rows: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """One row for each ``key``: the mean of its doubles, added up one by one in ``order``; nulls are left out.

    A sum of doubles depends on its order, and a mean near a half then rounds to either side. Here it is the same under any
    partitioning, and that of a plain scan in this order. The rows of a key pass a window that spills; no array holds them.
    """
    place = Window.partitionBy(key).orderBy(*order)
    so_far = place.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = rows.select(key, value, F.row_number().over(place).alias("__place"), F.sum(value).over(so_far).alias("__sum"))
    return run.groupBy(key).agg((F.max_by("__sum", "__place") / F.count(value)).alias("mean"))


def evaluate_risk(obs: DataFrame) -> DataFrame:
    """L4: ranking and Brier on observed outcomes, and how many rows other statuses exclude."""
    seen = obs.where("target_status = 'observed'").select(F.lit("all").alias("cohort"), F.col("patient_id").alias("record_id"), F.col("risk").alias("prob"), F.col("outcome").alias("target"))
    counts = obs.agg(F.count_if(F.col("target_status") == "observed").alias("observed"), F.count_if(F.col("target_status") == "censored").alias("censored"), F.count_if(F.col("target_status") == "insufficient").alias("insufficient"), F.lit("all").alias("cohort"))
    out = counts
    for part in (roc_auc(seen, ["cohort"]), average_precision(seen, ["cohort"]), pointwise(seen, ["cohort"]).drop("log_loss")):
        out = out.join(part, "cohort", "left")
    return out


def edge_bin(risk: Column, bins: int) -> Column:
    """Bin by search among the edges k / bins; the last bin is closed. Not floor(p * bins), which rounds differently."""
    edges = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    return F.size(F.filter(edges, lambda e: e <= risk))


def risk_bins(obs: DataFrame, bins: int, least: int) -> DataFrame:
    """Counts, mean risk and event rate of each bin; empty bins stay, small ones are nulled."""
    dim = obs.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    cells = obs.where("target_status = 'observed'").groupBy(edge_bin(F.col("risk"), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("risk").alias("mean_risk"), F.avg(F.col("outcome").cast("double")).alias("event_rate"))
    n = F.coalesce("n", F.lit(0))
    enough = n >= least
    status = F.when(n == 0, "empty").when(enough, "reported").otherwise("suppressed")
    return F.broadcast(dim).join(cells, "bin", "left").select("bin", F.when(enough | (n == 0), n).alias("n"), F.when(enough, F.col("mean_risk")).alias("mean_risk"), F.when(enough, F.col("event_rate")).alias("event_rate"), status.alias("status"))


def follow_up_completeness(obs: DataFrame, bins: int, least: int) -> DataFrame:
    """Counts by status in each bin; a bin with any count between 1 and least - 1 is suppressed whole."""
    kinds = ["observed", "censored", "insufficient"]
    cells = obs.groupBy(edge_bin(F.col("risk"), bins).alias("bin")).pivot("target_status", kinds).agg(F.count(F.lit(1))).fillna(0, kinds)
    small = F.lit(False)
    for k in kinds:
        small = small | ((F.col(k) > 0) & (F.col(k) < least))
    return cells.select("bin", *[F.when(~small, F.col(k)).alias(k) for k in kinds], small.alias("suppressed"))


#: L1: what happens to patients without a whole horizon: all stay, those below the minimum go, all of them go.
POLICIES = ("keep_all", "exclude_below_minimum", "require_complete_horizon")


def build_cohort(
    enc: DataFrame, index: DataFrame, history_days: int, horizon_days: int, minimum_days: int, policy: str = "keep_all"
) -> DataFrame:
    """Like ``build_timelines``, with an index time for each patient (patient_id, index_at), a minimum of
    follow-up and a censoring policy. Every indexed patient has a row; ``excluded`` says why one isn't in the cohort
    (``no_history``, ``censoring``, or ``observation_ends_early`` if an encounter is later than the observation).

    Follow-up is complete through the horizon's end, else insufficient below the minimum, else right-censored.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    met = index.select("patient_id", F.col("index_at").cast("timestamp").alias("index_at")).join(enc, "patient_id", "left")
    past, later = time_windows(F.col("occurred_at"), F.col("index_at"), history_days, horizon_days)
    item = F.struct(F.col("occurred_at").alias("at"), F.col("encounter_id").alias("id"), F.col("event_label").alias("label"))
    rows = met.groupBy("patient_id", "index_at").agg(
        F.array_sort(F.collect_list(F.when(past, item))).alias("history"),
        F.array_sort(F.collect_list(F.when(later, item))).alias("future"),
        F.max(F.when(past, F.col("occurred_at"))).alias("last_history_at"),
        F.max("occurred_at").alias("latest"), F.max("observed_through").alias("observed_through"),
    )
    seen, days = F.col("observed_through"), lambda n: F.make_dt_interval(F.lit(n))
    complete = F.coalesce(seen >= F.col("index_at") + days(horizon_days), F.lit(False))
    enough = F.coalesce(seen >= F.col("index_at") + days(minimum_days), F.lit(False))
    status = F.when(complete, "complete").when(enough, "right_censored").otherwise("insufficient")
    strict = {"keep_all": F.lit(False), "exclude_below_minimum": status == "insufficient", "require_complete_horizon": status != "complete"}
    why = F.when(F.coalesce(seen < F.col("latest"), F.lit(False)), "observation_ends_early").when(F.size("history") == 0, "no_history")
    return rows.select(
        "patient_id", "index_at", "history", "future", "last_history_at", status.alias("follow_up"),
        why.when(strict[policy], "censoring").alias("excluded"),
    )


def cohort_summary(cohort: DataFrame) -> DataFrame:
    """L1: one row: patients in, included, excluded by reason, and the included ones by follow-up."""
    kept = F.col("excluded").isNull()
    reasons, states = ("no_history", "censoring", "observation_ends_early"), ("complete", "right_censored", "insufficient")
    return cohort.agg(
        F.count(F.lit(1)).alias("patients"), F.count_if(kept).alias("included"),
        *[F.count_if(F.col("excluded") == r).alias(f"excluded_{r}") for r in reasons],
        *[F.count_if(kept & (F.col("follow_up") == s)).alias(s) for s in states],
    )


def follow_up_fractions(obs: DataFrame, bins: int, least: int) -> DataFrame:
    """Like ``follow_up_completeness`` for every bin, empty ones too, with the fractions of each status."""
    kinds = ["observed", "censored", "insufficient"]
    dim = obs.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    met = F.broadcast(dim).join(follow_up_completeness(obs, bins, least), "bin", "left")
    hidden = F.coalesce("suppressed", F.lit(False))
    counts = {k: F.when(~hidden, F.coalesce(k, F.lit(0).cast("long"))) for k in kinds}
    total = sum((counts[k] for k in kinds[1:]), counts[kinds[0]])
    status = F.when(hidden, "suppressed").when(total == 0, "empty").otherwise("reported")
    return met.select("bin", *[c.alias(k) for k, c in counts.items()], *[F.when(total > 0, c / total).alias(f"{k}_fraction") for k, c in counts.items()], status.alias("status"))
