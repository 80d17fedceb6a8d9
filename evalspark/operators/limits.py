"""Signal contracts and quality rules: limits are rows of a table that is joined to measures, not literals in code."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.operators.corruptions import LIMB_LEADS
from evalspark.operators.joins import in_pieces, small
from evalspark.operators.records import CLIP_NEAR, FLAT_STEP, METRICS, lead_metrics, record_measures  # noqa: F401
from evalspark.operators.waves import POLAR_SHARE, doubles, reversal_evidence, reversal_kind

#: Leads of one piece of a wave whose records are measured whole or put under many cases.
PIECE_LEADS = 600
STATUSES = ("ACCEPTABLE", "LIMITED", "REACQUIRE", "INVALID")
#: Fixed: the standard order of twelve leads.
LEADS = ("I", "II", "III", "aVR", "aVL", "aVF", "V1", "V2", "V3", "V4", "V5", "V6")


@dataclass(frozen=True)
class Contract:
    """What a record has to be: leads by name in order, samples, rate, duration and unit."""

    leads: tuple[str, ...] = LEADS
    n_samples: int = 1000
    fs: float = 100.0
    seconds: float = 10.0
    unit: str = "mV"
    tolerance: float = 1e-9


#: Fixed: the codes of contract issues, in the order in which they are told.
ISSUES = (
    "wrong_signal_shape", "nonfinite_signal", "lead_count_mismatch", "duplicate_leads", "missing_leads", "unexpected_leads",
    "lead_order_mismatch", "sample_rate_mismatch", "duration_mismatch", "unsupported_units",
)


def contract_issues(wave: DataFrame, contract: Contract = Contract()) -> DataFrame:
    """Q1: record_id, issues (codes of ISSUES), missing and unexpected lead names of every record.

    ``wave`` has record_id, lead_idx (the place in the record), lead_name, fs, seconds, unit and samples. Names are
    compared as sets and then in order; a null anywhere is an issue of its kind.
    """
    bad = F.col("samples").isNull() | F.exists("samples", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    length = F.bool_or(F.coalesce(F.size("samples") != contract.n_samples, F.lit(True))).alias("length")
    rows = wave.groupBy("record_id").agg(*lead_facts(contract), length, F.bool_or(bad).alias("nonfinite"))
    return _told(rows, contract).select("record_id", "issues", "missing", "unexpected")


def lead_facts(contract: Contract) -> list[Column]:
    """What a record's contract asks of its leads besides samples: aggregates of the rows of a wave."""
    lead = F.array_sort(F.collect_list(F.struct("lead_idx", F.coalesce("lead_name", F.lit("")).alias("name"))))
    far = lambda c, want: F.coalesce(F.isnan(c) | (F.abs(F.col(c) - want) > contract.tolerance), F.lit(True))
    return [
        F.transform(lead, lambda x: x["name"]).alias("names"), F.bool_or(far("fs", contract.fs)).alias("rate"),
        F.bool_or(far("seconds", contract.seconds)).alias("duration"), F.bool_or(F.coalesce(F.col("unit") != contract.unit, F.lit(True))).alias("unit"),
    ]


def _told(rows: DataFrame, contract: Contract) -> DataFrame:
    """``rows`` with issues, missing and unexpected from ``lead_facts``, length and nonfinite."""
    wanted = F.array(*[F.lit(x) for x in contract.leads])
    missing, extra = F.array_except(wanted, "names"), F.array_except("names", wanted)
    uneven = F.size("names") != len(contract.leads)
    found = [
        uneven | F.col("length"), F.col("nonfinite"), uneven, F.size(F.array_distinct("names")) < F.size("names"), F.size(missing) > 0, F.size(extra) > 0,
        (F.size(missing) == 0) & (F.size(extra) == 0) & (F.col("names") != wanted), F.col("rate"), F.col("duration"), F.col("unit"),
    ]
    issues = F.array_compact(F.array(*[F.when(c, F.lit(code)) for code, c in zip(ISSUES, found)]))
    return rows.withColumns({"issues": issues, "missing": F.array_sort(missing), "unexpected": F.array_sort(extra)})


#: Fixed: limits of the two published presets. A row is preset, reason, metric, whether it is too much ``above`` or too
#: little ``below`` the limits, the limit from which a lead is LIMITED and that from which it must be taken again.
LIMITS = "preset string, reason string, metric string, direction string, warn double, reacquire double, place int"
_COMMON = (
    ("flatline", "peak_to_peak", "below", 0.08, 0.03), ("flatline", "sd", "below", 0.015, 0.006), ("flatline", "flat_fraction", "above", 0.985, 0.997),
    ("clipping_or_saturation", "clip_run", "above", 4.0, 8.0), ("clipping_or_saturation", "clip_fraction", "above", 0.05, 0.10),
    ("extreme_amplitude", "max_abs", "above", 5.0, 8.0), ("extreme_spikes", "max_step", "above", 2.0, 4.0), ("baseline_wander", "wander", "above", 0.45, 0.65),
    ("powerline_interference_50hz", "mains50", "above", 0.20, 0.40), ("powerline_interference_60hz", "mains60", "above", 0.20, 0.40),
    ("high_frequency_noise", "high", "above", 0.30, 0.50), ("limb_lead_inconsistency", "limb_residual", "above", 0.12, 0.25),
)
_ADDED = (("flatline", "flat_seconds", "above", 0.5, 1.0), ("duplicated_lead_waveform", "duplicate_distance", "below", None, 5e-4))
PRESETS = {"v1": _COMMON, "v2": _COMMON + _ADDED}


def limit_rows(spark: SparkSession, presets: dict[str, Sequence[tuple]] | None = None) -> DataFrame:
    """The limits of presets as a table; ``place`` is the order in which a preset's rules are told."""
    rows = [(name, *rule, k) for name, rules in (PRESETS if presets is None else presets).items() for k, rule in enumerate(rules)]
    return spark.createDataFrame(rows, LIMITS)


def lead_measures(wave: DataFrame) -> DataFrame:
    """Q2 to Q4: record_id, lead_idx and METRICS of every lead with at least two samples, all of them finite.

    Clipping counts samples at the lead's own least or greatest value; a flat run of k steps lasts (k + 1) / fs.
    """
    rows = wave.select("record_id", "lead_idx", "fs", lead_metrics(F.col("samples"), F.col("fs")).alias("m")).where("m IS NOT NULL")
    seconds = F.when(F.col("m.flat_seconds") > 0, (F.col("m.flat_seconds") + 1) / F.col("fs")).otherwise(0.0)
    return rows.select("record_id", "lead_idx", *[seconds.alias(m) if m == "flat_seconds" else F.col(f"m.{m}") for m in METRICS])


def _long(df: DataFrame, keys: list[str], metrics: Sequence[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return df.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.*").where("value IS NOT NULL")


def findings(measures: DataFrame, limits: DataFrame, keys: list[str], metrics: Sequence[str]) -> DataFrame:
    """Q4: keys, preset, reason, status, metric, value and boundary: the worst rule of each reason that a row breaks; of
    equally bad ones that with the least place.

    Rules meet measures by metric, so a preset more costs rows and no code. ``limits`` is a small table.
    """
    met = _long(measures, keys, metrics).join(small(limits), "metric")
    over = lambda limit: F.coalesce(F.when(F.col("direction") == "above", F.col("value") >= F.col(limit)).otherwise(F.col("value") <= F.col(limit)), F.lit(False))
    rank = F.when(over("reacquire"), 2).when(over("warn"), 1)
    hit = met.withColumn("rank", rank).where("rank IS NOT NULL")
    boundary = F.when(F.col("rank") == 2, F.col("reacquire")).otherwise(F.col("warn"))
    worst = F.max_by(F.struct("rank", "metric", "value", boundary.alias("boundary")), F.struct("rank", (-F.col("place")).alias("o")))
    out = hit.groupBy(*keys, "preset", "reason").agg(worst.alias("w"))
    return out.select(*keys, "preset", "reason", status_name(F.col("w.rank")).alias("status"), "w.metric", "w.value", "w.boundary")


def status_name(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(s) for s in STATUSES]), rank.cast("int"))


def status_rank(status: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in STATUSES]), status).cast("int") - 1


@dataclass(frozen=True)
class Reversal:
    """The least polarity, the inverse correlation and the share of evidence of ``limb_reversal``."""

    minimum: float = 0.25
    inverse: float = -0.45
    fraction: float = 0.75


def assess_records(wave: DataFrame, limits: DataFrame, contract: Contract = Contract(), reversal: Reversal | None = Reversal()) -> DataFrame:
    """record_id, preset, status, allowed and reasons of every record under every preset.

    A record that breaks its contract is INVALID for its issues alone. Of others the worst finding of a lead, of the limb
    leads, of a duplicated lead (where a preset has a rule for it; leads that are flat to be taken again take no part) or
    of a probable reversal decides. Only ACCEPTABLE records are allowed. One shuffle, by record.
    """
    lead = F.struct("lead_idx", doubles(F.col("samples")).alias("s"), "fs")
    dealt = wave.repartition(in_pieces(wave, PIECE_LEADS), "record_id")
    rows = dealt.groupBy("record_id").agg(F.array_sort(F.collect_list(lead)).alias("l"), *lead_facts(contract))
    rates = F.transform("l", lambda x: x["fs"])
    return assess_rows(rows.withColumn("rates", rates), ["record_id"], limits, contract, reversal)


def assess_rows(rows: DataFrame, keys: list[str], limits: DataFrame, contract: Contract, reversal: Reversal | None) -> DataFrame:
    """``assess_records`` of records that are one row each: keys, leads ``l`` (lead_idx, s) in order, their ``rates`` and
    ``lead_facts``. No shuffle: limits are few rows that meet each record, and what they ask of it is in its own row.

    A rule on a metric is broken by a record if its greatest (or least) value over the leads breaks it.
    """
    every = (*METRICS, "limb_residual")
    place = F.array_position(F.array(*[F.lit(m) for m in every]), F.col("metric")) - 1
    item = F.struct("place", "reason", "metric", (F.col("direction") == "above").alias("above"), "warn", "reacquire", place.cast("int").alias("at"))
    presets = small(limits.groupBy("preset").agg(F.array_sort(F.collect_list(item)).alias("rules")))
    closest = small(limits.where("metric = 'duplicate_distance'").agg(F.max(F.greatest("warn", "reacquire")).alias("within")))
    evidence = reversal_evidence() if reversal is not None else {}
    asked = record_measures(F.transform("l", lambda x: x["s"]), F.transform("l", lambda x: x["lead_idx"]), F.col("rates"), F.col("within"), tuple(evidence.values()), POLAR_SHARE)
    numbers = F.transform("l", lambda x: x["lead_idx"])
    length = F.exists("l", lambda x: F.coalesce(F.size(x["s"]) != contract.n_samples, F.lit(True)))
    met = rows.join(closest, F.lit(True)).withColumns({"m": asked, "numbers": numbers, "length": length})
    told = _told(met.withColumn("nonfinite", ~F.col("m.finite")), contract)
    kind = F.lit(None).cast("string")
    if reversal is not None:
        strengths = {code: F.get("m.strengths", F.lit(i)) for i, code in enumerate(evidence)}
        kind = reversal_kind(strengths, F.forall("m.strengths", lambda v: ~F.isnan(v)), reversal.minimum, reversal.inverse, reversal.fraction)["kind"]
    told = told.select(*keys, "issues", "m", "numbers", kind.alias("kind")).join(presets, F.lit(True))

    def over(rule: Column, limit: str, most: Column, least: Column) -> Column:
        return F.coalesce(F.when(rule["above"], most >= rule[limit]).otherwise(least <= rule[limit]), F.lit(False))

    def rank(rule: Column) -> Column:
        of = lambda side: F.when(rule["at"] == len(METRICS), F.col("m.limb")).otherwise(F.get(f"m.{side}", rule["at"]))
        return F.when(over(rule, "reacquire", of("most"), of("least")), 2).when(over(rule, "warn", of("most"), of("least")), 1)

    def flat(lead: Column) -> Column:
        """Whether a lead is flat to be taken again."""
        value = lambda rule: F.get("m.values", rule["at"] * F.size("numbers") + lead)
        return F.exists("rules", lambda r: (r["reason"] == "flatline") & over(r, "reacquire", value(r), value(r)))

    number = lambda lead: F.get("numbers", lead)
    flats = F.when(F.size("m.pairs") > 0, F.transform(F.sequence(F.lit(0), F.size("numbers") - 1), flat))
    told = told.withColumn("flats", flats)
    # a flat limb lead makes the others alike
    excused = F.exists(F.arrays_zip("flats", "numbers"), lambda x: x["flats"] & (x["numbers"] < LIMB_LEADS))
    told = told.withColumn("excused", F.when(F.col("flats").isNotNull(), excused))
    limb = lambda lead: number(lead) < LIMB_LEADS
    counts = lambda p: ~F.get("flats", p["a"]) & ~F.get("flats", p["b"]) & ~(F.col("excused") & limb(p["a"]) & limb(p["b"])) & (number(p["a"]) < number(p["b"]))
    told = told.withColumn("nearest", F.array_min(F.transform(F.filter("m.pairs", counts), lambda p: p["apart"])))
    alike = lambda rule: F.when(F.coalesce(F.col("nearest") <= rule["reacquire"], F.lit(False)), 2).when(F.coalesce(F.col("nearest") <= rule["warn"], F.lit(False)), 1)
    ranked = F.transform("rules", lambda r: F.struct(F.when(r["metric"] == "duplicate_distance", alike(r)).otherwise(rank(r)).alias("rank"), r["reason"].alias("reason")))
    turned = F.array(F.struct(F.when(F.col("kind").isNotNull(), 2).alias("rank"), F.lit("probable_limb_lead_reversal").alias("reason")))
    broken = F.size("issues") > 0
    hits = F.when(~broken, F.filter(F.concat(ranked, turned), lambda h: h["rank"].isNotNull()))
    judged = told.select(*keys, "preset", "issues", hits.alias("hits"))
    worst = F.when(broken, 3).otherwise(F.coalesce(F.array_max("hits")["rank"], F.lit(0)))
    reasons = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["reason"])))
    return judged.select(*keys, "preset", status_name(worst).alias("status"), (worst == 0).alias("allowed"), F.when(broken, F.col("issues")).otherwise(reasons).alias("reasons"))
