"""Corruptions that need a record's other leads or a draw, duplicated leads, perturbation reports, conformal groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.operators.joins import small
from evalspark.operators.selective import fit_conformal
from evalspark.operators.waves import doubles, limb_consistency, steps
from evalspark.plans.prims import prefix_scan

LIMB_LEADS = 6


def shifted(samples: Column, by: Column) -> Column:
    """Q10: samples moved later by ``by`` places (earlier if negative), zeros moved in."""
    n = F.size(samples)
    at = F.sequence(F.lit(0), n - 1)
    return F.when(n > 0, F.transform(at, lambda i: F.when((i - by >= 0) & (i - by < n), F.get(samples, (i - by).cast("int"))).otherwise(0.0))).otherwise(samples)


def time_shift(wave: DataFrame, by: int) -> DataFrame:
    """Q10: every record moved by a fixed number of samples."""
    return wave.withColumn("samples", shifted(doubles(F.col("samples")), F.lit(by)))


def permute_leads(wave: DataFrame, order: list[int]) -> DataFrame:
    """Q10: lead i gets the samples of lead order[i]; ``order`` holds each lead once."""
    if sorted(order) != list(range(len(order))):
        raise ValueError("order must hold each lead once")
    place = F.array(*[F.lit(order.index(i)) for i in range(len(order))])
    return wave.withColumn("lead_idx", F.get(place, F.col("lead_idx").cast("int")).cast(dict(wave.dtypes)["lead_idx"]))


def unit_draw(*parts: Column) -> Column:
    """A number in [0, 1) fixed by its parts (names or numbers): eight hexadecimal digits of a hash."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def masked_at_random(wave: DataFrame, width: int, seed: int) -> DataFrame:
    """Q10: ``width`` samples of each record set to 0, in all leads alike, from a start that its id and the seed fix."""
    room = F.size("samples") - width + 1
    start = F.floor(unit_draw(F.lit(seed), F.col("record_id")) * room)
    inside = lambda i: (i >= start) & (i < start + width)
    return wave.withColumn("samples", F.transform(doubles(F.col("samples")), lambda v, i: F.when(inside(i), 0.0).otherwise(v)))


def noise_at_snr(wave: DataFrame, snr_db: float, seed: int) -> DataFrame:
    """Q10: noise added to all leads of a record so that the record has the asked ratio of signal to noise.

    Noise is a normal draw fixed by seed, record, lead and place, scaled by the record's root mean squares over all its
    leads; one shuffle by record.
    """
    i = lambda name: [F.lit(seed), F.col("record_id"), F.col("lead_idx")]

    def normal(k: Column) -> Column:
        u, v = unit_draw(*i(0), k, F.lit("u")), unit_draw(*i(0), k, F.lit("v"))
        return F.sqrt(-2 * F.log(1 - u)) * F.cos(F.lit(6.283185307179586) * v)

    rows = wave.withColumn("samples", doubles(F.col("samples")))
    rows = rows.withColumn("__noise", F.transform("samples", lambda _, k: normal(k)))
    squares = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, v: acc + v * v)
    power = rows.groupBy("record_id").agg(F.sum(squares("samples")).alias("__s"), F.sum(squares("__noise")).alias("__q"))
    met = rows.join(power, "record_id")
    scale = F.when(F.col("__q") > 0, F.sqrt(F.col("__s") / F.col("__q")) / F.lit(10.0 ** (snr_db / 20))).otherwise(0.0)
    return met.withColumn("samples", F.zip_with("samples", "__noise", lambda x, y: x + scale * y)).drop("__noise", "__s", "__q")


def duplicated_leads(wave: DataFrame, tolerance: float, flat_range: float) -> DataFrame:
    """(record_id, lead_idx, earlier, distance) of leads that an earlier one equals to within ``tolerance``; of
    several the nearest, then the first.

    Leads whose range is at most ``flat_range`` are flat and take no part; if a limb lead (0 to 5) is flat, pairs of limb
    leads don't count either. A record has few leads, whose pairs are made inside its own row.
    """
    s = doubles(F.col("samples"))
    item = F.struct("lead_idx", s.alias("s"), ((F.array_max(s) - F.array_min(s)) <= flat_range).alias("flat"))
    rows = wave.groupBy("record_id").agg(F.array_sort(F.collect_list(item)).alias("l"))
    rows = rows.withColumn("limb_flat", F.exists("l", lambda x: x["flat"] & (x["lead_idx"] < LIMB_LEADS)))
    rows = rows.withColumn("b", F.explode(F.filter("l", lambda x: ~x["flat"])))
    both_limb = lambda x: F.col("limb_flat") & (F.col("b.lead_idx") < LIMB_LEADS) & (x["lead_idx"] < LIMB_LEADS)
    earlier = F.filter("l", lambda x: (x["lead_idx"] < F.col("b.lead_idx")) & ~x["flat"] & ~both_limb(x))
    far = lambda x: F.array_max(F.zip_with(x["s"], F.col("b.s"), lambda u, v: F.abs(u - v)))
    nearest = F.array_min(F.transform(earlier, lambda x: F.struct(far(x).alias("distance"), x["lead_idx"].alias("earlier"))))
    found = rows.select("record_id", F.col("b.lead_idx").alias("lead_idx"), nearest.alias("n")).where(F.col("n.distance") <= tolerance)
    return found.select("record_id", "lead_idx", "n.earlier", "n.distance")


def perturbation_report(
    orig: DataFrame, cand: DataFrame, limits: dict[str, float], tolerance: float = 1e-9
) -> DataFrame:
    """Q12: per record the root mean square and the largest change, the share of changed samples, the largest change of
    a step between neighbours, the change of the limb residual, the lead that changed most, and ``reasons``: the
    measures over their limit, in order. Records that one side lacks, or whose leads differ in length, have the reason
    ``unmatched`` and no measures."""
    side = lambda df, c: df.select("record_id", "lead_idx", doubles(F.col("samples")).alias(c))
    met = side(orig, "a").join(side(cand, "b"), ["record_id", "lead_idx"], "full_outer")
    whole = F.coalesce(F.size("a") == F.size("b"), F.lit(False))
    d = F.zip_with("b", "a", lambda x, y: x - y)
    lead = met.select(
        "record_id", "lead_idx", whole.alias("whole"), F.size("a").alias("n"), F.aggregate(d, F.lit(0.0), lambda acc, v: acc + v * v).alias("q"),
        F.array_max(F.transform(d, lambda v: F.abs(v))).alias("m"), F.size(F.filter(d, lambda v: F.abs(v) > tolerance)).alias("c"),
        F.array_max(F.transform(steps(d), lambda v: F.abs(v))).alias("step"),
    )
    rms = F.sqrt(F.col("q") / F.col("n"))
    rows = lead.groupBy("record_id").agg(
        F.bool_and("whole").alias("whole"), F.sqrt(F.sum("q") / F.sum("n")).alias("rms"), F.max("m").alias("largest"),
        (F.sum("c") / F.sum("n")).alias("changed"), F.max("step").alias("step"),
        F.max_by("lead_idx", F.struct(rms.alias("rms"), (-F.col("lead_idx")).alias("i"))).alias("worst_lead"),
    )
    limb = lambda df, c: limb_consistency(df).select("record_id", F.col("limb_residual").alias(c))
    rows = rows.join(limb(orig, "r0"), "record_id", "left").join(limb(cand, "r1"), "record_id", "left")
    names = ["rms", "largest", "changed", "step", "limb"]
    values = {n: F.col(n) for n in names[:4]} | {"limb": F.abs(F.col("r1") - F.col("r0"))}
    over = F.array_compact(F.array(*[F.when(values[n] > limits[n], F.lit(n)) for n in names if n in limits]))
    reasons = F.when(~F.col("whole"), F.array(F.lit("unmatched"))).otherwise(over)
    kept = [F.when(F.col("whole"), c).alias(n) for n, c in values.items()]
    return rows.select("record_id", *kept, F.when(F.col("whole"), F.col("worst_lead")).alias("worst_lead"), F.array_join(reasons, ",").alias("reasons"))


def fit_by_class(pred: DataFrame, label: str, alphas: dict[int, float]) -> DataFrame:
    """M6: conformal cutoffs by label and class, each class with an error rate of its own."""
    parts = [fit_conformal(pred.where(F.col("target") == c), [label, "target"], a) for c, a in sorted(alphas.items())]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def trivial_groups(fit: DataFrame, keys: list[str]) -> DataFrame:
    """M7: groups too small for their error rate, of which every set holds both classes."""
    return fit.where(~F.col("attainable")).select(*keys, "n")


def unknown_groups(pred: DataFrame, fit: DataFrame, keys: list[str]) -> DataFrame:
    """M7: (keys, n) of groups to be predicted that no cutoff was fitted for."""
    met = pred.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return met.join(small(fit.select(*keys).distinct()), keys, "left_anti")


def value_at_epoch(history: DataFrame, run: str, metric: str, epoch: int) -> DataFrame:
    """Each run's value at a chosen epoch, and at the last one before it where that is missing."""
    return history.where(F.col("epoch") <= epoch).groupBy(run).agg(
        F.max("epoch").alias("epoch"), F.max_by(metric, "epoch").alias(metric)
    )


def counterbalanced_order(participants: DataFrame, cases: DataFrame, arms: list[str], key: str) -> DataFrame:
    """(participant, arm, arm_place, case_id, ordinal): participants in the order of a keyed hash take turns at the
    arm they begin with; in each arm the cases stand in an order of their own. Cases are a small table.

    The turn is a participant's rank among all, modulo the arms; the rank is a running sum over ranges of the hash.
    """
    digest = lambda *parts: F.sha2(F.concat_ws("|", F.lit(key), *parts), 256)
    hashed = participants.select("participant", digest(F.col("participant").cast("string")).alias("__h"))
    ranked = prefix_scan(hashed, [], [F.col("__h"), F.col("participant")], {"__rank": F.lit(1).cast("long")})
    turned = ranked.select("participant", ((F.col("__rank") - 1) % len(arms)).alias("__first"))
    arm = F.posexplode(F.array(*[F.lit(a) for a in arms]))
    by_arm = turned.select("participant", "__first", arm.alias("__i", "arm"))
    by_arm = by_arm.withColumn("arm_place", F.pmod(F.col("__i") - F.col("__first"), F.lit(len(arms))) + 1)
    pairs = by_arm.join(small(cases.select("case_id")), F.lit(True))
    order = digest(*[F.col(c).cast("string") for c in ("participant", "arm", "case_id")])
    ordinal = F.row_number().over(Window.partitionBy("participant", "arm").orderBy(order, "case_id"))
    return pairs.select("participant", "arm", "arm_place", "case_id", ordinal.alias("ordinal"))
