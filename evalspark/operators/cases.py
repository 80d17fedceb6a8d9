"""Corruption cases as rows, compiled to one expression each over a record's leads; all cases in one job.

What a case needs of a record as a whole (its root mean square, its noise and the power of that, the start of a mask) is
worked out once for all cases, in the record's own row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.operators.corruptions import shifted, unit_draw
from evalspark.operators.joins import in_pieces
from evalspark.operators.limits import PIECE_LEADS, Contract, Reversal, assess_rows, lead_facts
from evalspark.operators.waves import doubles, wave_fingerprint

N_LEADS = 12
LEAST_RMS = 1e-12
SEED = 2026


@dataclass(frozen=True)
class Case:
    """``kind`` is one of KINDS; ``amount`` is a share of the record's root mean square, decibels, a factor, samples or a
    width, as the kind has it."""

    case_id: str
    kind: str
    amount: float = 0.0
    frequency: float = 0.0
    phase: float = 0.0
    leads: tuple[int, ...] = tuple(range(N_LEADS))


def _grid() -> tuple[Case, ...]:
    out = [Case("clean", "clean")]
    out += [Case(f"wander-{a:.2f}", "tone", a, 0.33) for a in (0.05, 0.10, 0.20)]
    out += [Case(f"mains-{a:.2f}", "tone", a, 50.0, math.pi / 2) for a in (0.01, 0.03, 0.05)]
    out += [Case(f"noise-{db}db", "noise", float(db)) for db in (30, 20, 10)]
    out += [Case(f"scale-{a:.2f}", "scale", a) for a in (0.75, 1.25, 0.50, 1.50)]
    out += [Case(f"offset{a:+.2f}", "offset", a) for a in (-0.05, 0.05, -0.15, 0.15)]
    out += [Case(f"shift{n:+d}", "shift", float(n)) for n in (-10, 10, -25, 25)]
    out += [Case(f"mask-{n}", "mask", float(n)) for n in (50, 100, 200)]
    out += [Case(f"drop-{i}", "drop", leads=(i,)) for i in range(N_LEADS)]
    out += [Case("drop-limb", "drop", leads=tuple(range(6))), Case("drop-chest", "drop", leads=tuple(range(6, N_LEADS)))]
    out += [Case("swap-0-1", "order", leads=(1, 0, *range(2, N_LEADS))), Case("reverse-all", "order", leads=tuple(reversed(range(N_LEADS))))]
    return tuple(out)


#: Fixed: the published grid of 41 cases.
GRID = _grid()


def _squares(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v * v)


def _over(leads: Column, f: Callable[[Column], Column]) -> Column:
    return F.aggregate(leads, F.lit(0.0), lambda acc, x: acc + f(x))


def _mapped(case: Case, f: Callable[[Column, Column], Column]) -> Column:
    """The leads with ``f`` applied to (sample, place) of those that the case names."""
    named = F.array(*[F.lit(i) for i in case.leads])
    new = lambda x: F.when(F.array_contains(named, x["lead_idx"]), F.transform(x["s"], f)).otherwise(x["s"])
    return F.transform("l", lambda x: F.struct(x["lead_idx"].alias("lead_idx"), new(x).alias("s")))


def _noisy(case: Case) -> Column:
    scale = F.col("rms") / F.lit(10.0 ** (case.amount / 20)) / F.greatest(F.col("noise_rms"), F.lit(LEAST_RMS))
    return F.zip_with("l", "noise", lambda x, z: F.struct(x["lead_idx"].alias("lead_idx"), F.zip_with(x["s"], z, lambda v, w: v + scale * w).alias("s")))


def _ordered(case: Case) -> Column:
    """Lead i gets the samples of lead leads[i], null if the record lacks that; other leads stay as they are."""
    order = F.array(*[F.lit(i) for i in case.leads])
    source = lambda i: F.coalesce(F.get(order, i), i)
    of = lambda i: F.get(F.filter("l", lambda y: y["lead_idx"] == source(i)), F.lit(0))["s"]
    return F.transform("l", lambda x: F.struct(x["lead_idx"].alias("lead_idx"), of(x["lead_idx"]).alias("s")))


def _tone(case: Case) -> Column:
    return _mapped(case, lambda v, i: v + case.amount * F.col("rms") * F.sin(F.lit(2 * math.pi * case.frequency) * i / F.col("fs") + case.phase))


def _mask(case: Case) -> Column:
    room = F.greatest(F.col("n") - int(case.amount) + 1, F.lit(1))
    start = F.floor(F.col("draw") * room)
    return _mapped(case, lambda v, i: F.when((i >= start) & (i < start + int(case.amount)), 0.0).otherwise(v))


#: What each kind of case does to the leads ``l`` of a record's row.
KINDS: dict[str, Callable[[Case], Column]] = {
    "clean": lambda case: F.col("l"),
    "tone": _tone,
    "noise": _noisy,
    "scale": lambda case: _mapped(case, lambda v, i: v * case.amount),
    "offset": lambda case: _mapped(case, lambda v, i: v + case.amount * F.col("rms")),
    "shift": lambda case: F.transform("l", lambda x: F.struct(x["lead_idx"].alias("lead_idx"), shifted(x["s"], F.lit(int(case.amount))).alias("s"))),
    "mask": _mask,
    "drop": lambda case: _mapped(case, lambda v, i: F.lit(0.0)),
    "order": _ordered,
}


def corrupt_cases(wave: DataFrame, cases: tuple[Case, ...] = GRID, seed: int = SEED) -> DataFrame:
    """Q10: case_id, record_id, lead_idx, fs and samples of every record under every case.

    Tones and offsets are shares of the root mean square over all leads; noise is a normal draw fixed by seed, record,
    lead and place (the same for all noise cases), scaled to the asked decibels; a mask covers the same places of all
    leads, from a start that seed and record fix, and all of a shorter record. One shuffle, by record; ``cases`` are
    compiled into the plan, which grows with them. Leads are numbered and each stands once in a record.
    """
    each = case_rows(wave, cases, seed).select("record_id", "fs", "case_id", F.explode("l").alias("x"))
    return each.select("case_id", "record_id", "x.lead_idx", "fs", F.col("x.s").alias("samples"))


def case_rows(wave: DataFrame, cases: tuple[Case, ...], seed: int, facts: Sequence[Column] = ()) -> DataFrame:
    """``corrupt_cases`` with one row for each record and case: record_id, fs, ``facts`` (aggregates of the record's rows),
    case_id and the leads ``l``. Records are dealt out by the number of leads, as each becomes as many as there are cases.
    """
    unknown = [c.kind for c in cases if c.kind not in KINDS]
    if unknown:
        raise ValueError(f"no such kind of case: {unknown[0]}")
    if any(c.kind == "order" and sorted(c.leads) != list(range(len(c.leads))) for c in cases):
        raise ValueError("an order must hold each lead once")
    item = F.struct(F.col("lead_idx").cast("int").alias("lead_idx"), doubles(F.col("samples")).alias("s"))
    dealt = wave.repartition(in_pieces(wave, PIECE_LEADS), "record_id")
    rows = dealt.groupBy("record_id").agg(F.array_sort(F.collect_list(item)).alias("l"), F.first("fs").alias("fs"), *facts)
    kept = [c for c in rows.columns if c != "l"]
    size = _over(F.col("l"), lambda x: F.size(x["s"]))
    rows = rows.withColumns({"n": F.array_max(F.transform("l", lambda x: F.size(x["s"]))), "draw": unit_draw(F.lit(seed), F.col("record_id"), F.lit("mask"))})
    rows = rows.withColumn("rms", F.greatest(F.sqrt(_over(F.col("l"), lambda x: _squares(x["s"])) / size), F.lit(LEAST_RMS)))
    if any(c.kind == "noise" for c in cases):
        u = lambda x, k, part: unit_draw(F.lit(seed), F.col("record_id"), x["lead_idx"], k, F.lit(part))
        normal = lambda x, k: F.sqrt(-2 * F.log(1 - u(x, k, "u"))) * F.cos(F.lit(2 * math.pi) * u(x, k, "v"))
        rows = rows.withColumn("noise", F.transform("l", lambda x: F.transform(x["s"], lambda _, k: normal(x, k))))
        rows = rows.withColumn("noise_rms", F.sqrt(_over(F.col("noise"), _squares) / size))
    made = F.array(*[F.struct(F.lit(c.case_id).alias("case_id"), KINDS[c.kind](c).alias("l")) for c in cases])
    return rows.select(*kept, F.explode(made).alias("c")).select(*kept, "c.case_id", "c.l")


def stress_matrix(
    wave: DataFrame, limits: DataFrame, contract: Contract, cases: tuple[Case, ...] = GRID, harmless: tuple[str, ...] = ("clean",),
    reversal: Reversal | None = Reversal(), seed: int = SEED,
) -> DataFrame:
    """Q11: case_id, preset, a count of records for each status, and fail_open: how many records of a case that isn't
    harmless are allowed all the same. All cases and presets are judged in one job, each case in a row of its own that
    nothing but its counts leaves."""
    rates = F.transform(F.array_sort(F.collect_list(F.struct("lead_idx", "fs"))), lambda x: x["fs"]).alias("rates")
    rows = case_rows(wave, cases, seed, [rates, *lead_facts(contract)])
    judged = assess_rows(rows, ["case_id", "record_id"], limits, contract, reversal)
    counts = [F.count_if(F.col("status") == s).alias(s.lower()) for s in ("ACCEPTABLE", "LIMITED", "REACQUIRE", "INVALID")]
    open_ = F.count_if(F.col("allowed") & ~F.col("case_id").isin(*harmless)).alias("fail_open")
    return judged.groupBy("case_id", "preset").agg(*counts, open_)


def case_effects(wave: DataFrame, cases: tuple[Case, ...] = GRID, seed: int = SEED) -> DataFrame:
    """Q16: record_id, case_id, effect and same_as: ``no_op`` where a case leaves all samples of a record as they were
    (to six digits), ``duplicate`` where an earlier case of ``cases`` made the same of it (``same_as``), else ``changed``.
    """
    made = corrupt_cases(wave, cases, seed).withColumn("record_id", F.struct("case_id", "record_id"))
    prints = wave_fingerprint(made).select("record_id.case_id", "record_id.record_id", "fingerprint")
    order = F.array(*[F.lit(c.case_id) for c in cases])
    placed = prints.withColumn("place", F.array_position(order, F.col("case_id")))
    parent = wave_fingerprint(wave).select("record_id", F.col("fingerprint").alias("parent"))
    # a record's cases are the rows of these windows
    first = F.min(F.struct("place", "case_id")).over(Window.partitionBy("record_id", "fingerprint"))
    rows = placed.withColumn("first", first).join(parent, "record_id")
    effect = F.when(F.col("fingerprint") == F.col("parent"), "no_op").when(F.col("first.place") < F.col("place"), "duplicate").otherwise("changed")
    return rows.select("record_id", "case_id", effect.alias("effect"), F.when(effect == "duplicate", F.col("first.case_id")).alias("same_as"))
