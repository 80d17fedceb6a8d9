"""Clustered bootstrap intervals, proportion bounds and gates."""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.operators.joins import small
from evalspark.operators.metrics import METRICS, metrics_of_hist
from evalspark.operators.selective import area_of_ties
from evalspark.plans.prims import draw, prefix_scan
from evalspark.plans.scratch import materialise


def cluster_sums(events: DataFrame, keys: list[str], cluster: str, event: str) -> DataFrame:
    """(keys, cluster, n, events): all a rate bootstrap needs of the records."""
    return events.groupBy(*keys, cluster).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(event).cast("long")).alias("events"))


def drawn_clusters(numbered: DataFrame, keys: list[str], replicates: int, seed: int) -> DataFrame:
    """P3 within keys: (keys, b, i, w), how often the cluster numbered i is drawn in replicate b, with replacement.

    ``numbered`` has the clusters with their numbers __i from 0 on. Each of them stands for one place of every
    replicate, so that no list as long as the clusters is ever made in one row.
    """
    sizes = numbered.groupBy(*keys).agg(F.count(F.lit(1)).alias("__c"))
    # a row for each key; the places are dealt anew, as a small file of clusters makes many draws
    dealt = numbered.select(*keys, "__i").repartition(int(numbered.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__i")
    places = dealt.join(small(sizes), keys)
    every = places.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    drawn = every.select(*keys, "b", (draw(seed, F.col("b"), F.col("__i")) % F.col("__c")).alias("__i"))
    return drawn.groupBy(*keys, "b", "__i").agg(F.count(F.lit(1)).alias("__w"))


def bootstrap_rates(events: DataFrame, keys: list[str], cluster: str, event: str, replicates: int, seed: int) -> DataFrame:
    """Rate of each replicate (keys, b, rate): clusters drawn with replacement, all their records carried.

    Clusters are numbered by order within their key; the draw for place j of replicate b is a hash, so replicates are
    the same under any partitioning. The join is of replicates times clusters rows, none of them records.
    """
    sums = events.groupBy(*keys, cluster).agg(F.count(F.lit(1)).alias("__n"), F.sum(F.col(event).cast("long")).alias("__e"))
    ranked = prefix_scan(sums, keys, [F.col(cluster)], {"__rank": F.lit(1).cast("long")})
    numbered = ranked.withColumn("__i", F.col("__rank") - 1).drop("__rank", "__rank_total")
    # by merging: neither side is small, whatever the size of its file
    met = drawn_clusters(numbered, keys, replicates, seed).join(numbered.hint("merge"), [*keys, "__i"])
    w = F.col("__w")
    return met.groupBy(*keys, "b").agg((F.sum(w * F.col("__e")) / F.sum(w * F.col("__n"))).alias("rate"))


def bootstrap_proportion(events: DataFrame, keys: list[str], cluster: str, event: str, replicates: int = 200, seed: int = 11, confidence: float = 0.95) -> DataFrame:
    """B1: observed rate with two-sided and one-sided percentile bounds."""
    rates = bootstrap_rates(events, keys, cluster, event, replicates, seed)
    tail = (1 - confidence) / 2
    q = F.percentile("rate", [tail, 1 - tail, 1 - confidence, confidence])
    bounds = rates.groupBy(*keys).agg(q.alias("q"))
    seen = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(event).cast("long")).alias("events"), F.count_distinct(cluster).alias("clusters"))
    return seen.join(bounds, keys).select(*keys, "n", "events", "clusters", (F.col("events") / F.col("n")).alias("rate"), *[F.col("q")[i].alias(name) for i, name in enumerate(("low", "high", "one_sided_low", "one_sided_high"))])


def wilson_upper(k: Column, n: Column, z: float = 1.6448536269514722) -> Column:
    """One-sided upper bound of a proportion (95 % by default)."""
    p = k / n
    return (p + z * z / (2 * n) + z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def _beta_share(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d, f, tiny = 1.0, 0.0, 1.0, 1e-300
    for i in range(400):
        m = i // 2
        if i == 0:
            step = 1.0
        elif i % 2 == 0:
            step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            step = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + step * d or tiny)
        c = 1 + step / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def _exact_upper(k: int, n: int, confidence: float) -> float:
    """The rate at which k events or fewer in n have the chance 1 - confidence, by halving."""
    if k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if _beta_share(1 - mid, n - k, k + 1) > 1 - confidence else (low, mid)
    return (low + high) / 2


def exact_upper(k: Column, n: Column, confidence: float = 0.95) -> Column:
    """One-sided Clopper-Pearson upper bound of a proportion; null without trials. For tables of rates."""

    def run(events: pd.Series, trials: pd.Series) -> pd.Series:
        bounds = [_exact_upper(int(e), int(t), confidence) if t > 0 else None for e, t in zip(events, trials)]
        return pd.Series(bounds, dtype=object)

    return F.pandas_udf(run, "double")(k, n)


def exact_lower(k: Column, n: Column, confidence: float = 0.95) -> Column:
    """One-sided Clopper-Pearson lower bound of a proportion."""
    return 1 - exact_upper(n - k, n, confidence)


def rate_gate(bounds: DataFrame, limits: DataFrame, keys: list[str]) -> DataFrame:
    """Passes where the one-sided bound is within its limit (``at_most`` or ``at_least``), with what it rests on:
    records, events, records without the event, and clusters. Limits are one row for each key."""
    met = bounds.join(small(limits), keys)
    most = F.col("kind") == "at_most"
    bound = F.when(most, F.col("one_sided_high")).otherwise(F.col("one_sided_low")).alias("bound")
    ok = F.when(most, F.col("one_sided_high") <= F.col("limit")).otherwise(F.col("one_sided_low") >= F.col("limit"))
    counts = [c for c in ("n", "events", "clusters") if c in bounds.columns]
    rest = [(F.col("n") - F.col("events")).alias("without_event")] if len(counts) == 3 else []
    return met.select(*keys, *counts, *rest, "rate", "kind", "limit", bound, ok.alias("passed"))


def slice_gate(ref: DataFrame, cand: DataFrame, group: str, least: int, tolerance: float) -> DataFrame:
    """Degradation of each group and overall at the reference's composition; too few rows is not a pass."""
    both = ref.select(group, F.col("value").alias("rv"), F.col("n").alias("rn")).join(cand.select(group, F.col("value").alias("cv"), F.col("n").alias("cn")), group, "full_outer")
    drop = F.col("rv") - F.col("cv")
    status = F.when(F.col("rn").isNull() | F.col("cn").isNull(), "missing").when((F.col("rn") < least) | (F.col("cn") < least), "insufficient").when(drop > tolerance, "fail").otherwise("pass")
    rows = both.select(group, "rn", "cn", drop.alias("degradation"), status.alias("status"))
    overall = rows.where("degradation IS NOT NULL").agg(F.lit("<ALL>").alias(group), F.sum("rn").alias("rn"), F.sum("cn").alias("cn"), (F.sum(F.col("degradation") * F.col("rn")) / F.sum("rn")).alias("degradation"))
    return rows.unionByName(overall.withColumn("status", F.when(F.col("degradation") > tolerance, "fail").otherwise("pass")))


def patient_equalized_rate(events: DataFrame, keys: list[str], cluster: str, event: str) -> DataFrame:
    """Mean of each cluster's own rate, and clusters with any event."""
    per = cluster_sums(events, keys, cluster, event)
    return per.groupBy(*keys).agg(F.avg(F.col("events") / F.col("n")).alias("equalized_rate"), F.count_if(F.col("events") > 0).alias("with_event"), F.count(F.lit(1)).alias("clusters"))


#: Replicates whose weights stand side by side in one row of a cluster.
BLOCK = 10


def by_replicate(
    rows: DataFrame, keys: list[str], cluster: str, values: dict[str, Column], held: dict[str, Column], replicates: int, seed: int
) -> DataFrame:
    """(b, keys, values, held) of every replicate of a clustered bootstrap: sums of ``values`` under the weights of
    the drawn clusters, and the aggregates ``held``, which no weight changes, over all rows of the keys. The first of
    the values is 1 for each row; keys that a replicate draws nothing of aren't in it.

    A cluster's weights in BLOCK replicates are columns of one row, so a record is met once for each block and summed
    where it lies; only sums by block and keys are shuffled after that.
    """
    clusters = rows.select(cluster).distinct().withColumn("__all", F.lit(0))
    ranked = prefix_scan(clusters, ["__all"], [F.col(cluster)], {"__rank": F.lit(1).cast("long")})
    numbered = ranked.select("__all", cluster, (F.col("__rank") - 1).alias("__i"))
    drawn = drawn_clusters(numbered, ["__all"], replicates, seed)
    own = [F.coalesce(F.sum(F.when(F.col("b") % BLOCK == k, F.col("__w"))), F.lit(0)).alias(f"__w{k}") for k in range(min(BLOCK, replicates))]
    blocks = drawn.groupBy("__i", F.expr(f"b DIV {BLOCK}").alias("__block")).agg(*own)
    # by merging: no side is small, whatever the size of its file
    weights = blocks.join(numbered.drop("__all").hint("merge"), "__i").drop("__i")
    met = rows.join(weights.hint("merge"), cluster)
    sums = [F.sum(F.col(f"__w{k}") * v).alias(f"__{name}{k}") for k in range(len(own)) for name, v in values.items()]
    cells = met.groupBy("__block", *keys).agg(*sums, *[c.alias(name) for name, c in held.items()])
    each = F.posexplode(F.array(*[F.struct(*[F.col(f"__{name}{k}").alias(name) for name in values]) for k in range(len(own))])).alias("__k", "__v")
    b = (F.col("__block") * BLOCK + F.col("__k")).cast("int").alias("b")
    return cells.select("__block", *keys, *held, each).where(F.col(f"__v.{next(iter(values))}") > 0).select(b, *keys, "__v.*", *held)


def bootstrap_metrics(pred: DataFrame, keys: list[str], cluster: str, replicates: int, seed: int) -> DataFrame:
    """B2: (b, keys, rate, auroc, average_precision, brier, log_loss, ece) of every replicate of a clustered bootstrap.

    Records are summed under drawn weights by (b, keys, score) before anything is ranked. That is replicates times
    distinct scores in all: rounded scores make it small, but where every record has a score of its own it is replicates
    times records, which no exact ranking metric of a replicate can do without. A replicate with one class has a null
    auroc, one without positives a null average precision: they are invalid, and counted as such by ``intervals_of``.
    """
    rows = pred.select(cluster, *keys, "prob", F.col("target").cast("long").alias("target"))
    cells = by_replicate(rows, [*keys, "prob"], cluster, {"__n": F.lit(1), "__y": F.col("target")}, {}, replicates, seed)
    return metrics_of_hist(cells, ["b", *keys]).select("b", *keys, *METRICS)


def macro_replicates(replicates: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """Means over labels of each replicate (b, keys); null where a label's metric is undefined."""
    every = F.count(F.lit(1))
    means = [F.when(F.count(m) == every, F.avg(m)).alias(m) for m in METRICS]
    return replicates.groupBy("b", *[k for k in keys if k != label]).agg(*means)


def intervals_of(replicates: DataFrame, keys: list[str], metric: str, least: int, confidence: float = 0.95) -> DataFrame:
    """B2: percentile interval, numbers of valid and invalid replicates, and a status."""
    tail = (1 - confidence) / 2
    v = F.col(metric)
    out = replicates.groupBy(*keys).agg(F.count(v).alias("valid"), F.count_if(v.isNull()).alias("invalid"), F.percentile(metric, [tail, 1 - tail]).alias("q"))
    status = F.when(F.col("valid") == 0, "undefined").when(F.col("valid") < least, "insufficient").when(F.col("q")[0] == F.col("q")[1], "degenerate").otherwise("ok")
    return out.select(*keys, "valid", "invalid", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), status.alias("status"))


def paired_bootstrap(
    pred: DataFrame, model: str, a: str, b: str, keys: list[str], cluster: str, replicates: int, seed: int
) -> DataFrame:
    """Metrics of one model (or case) less those of another, replicate by replicate, under the same draws."""
    both = bootstrap_metrics(pred.where(F.col(model).isin(a, b)), [*keys, model], cluster, replicates, seed)
    first, second = (both.where(F.col(model) == x).drop(model) for x in (a, b))
    second = second.select("b", *keys, *[F.col(m).alias(f"__{m}") for m in METRICS])
    return first.join(second, ["b", *keys]).select("b", *keys, *[(F.col(m) - F.col(f"__{m}")).alias(m) for m in METRICS])


def bootstrap_risk(losses: DataFrame, keys: list[str], cluster: str, loss: str, replicates: int, seed: int) -> DataFrame:
    """(b, keys, aurc, augrc, coverage, accepted_loss) of every replicate.

    ``losses`` has the cluster, ``uncertainty``, the loss and ``maximum_entropy`` (its gate, one for each of the keys).
    Rows are summed by (b, keys, uncertainty) first, as in ``bootstrap_metrics``.
    """
    inside = F.max((F.col("uncertainty") <= F.col("maximum_entropy")).cast("long"))
    values = {"__m": F.lit(1), "__l": F.col(loss)}
    cells = by_replicate(losses, [*keys, "uncertainty"], cluster, values, {"__in": inside}, replicates, seed)
    cells = materialise(cells, "risk-cells")
    area = area_of_ties(cells, ["b", *keys], "uncertainty")
    taken = F.sum(F.col("__m") * F.col("__in"))
    gate = cells.groupBy("b", *keys).agg(
        (taken / F.sum("__m")).alias("coverage"),
        F.when(taken > 0, F.sum(F.col("__l") * F.col("__in")) / taken).alias("accepted_loss"),
    )
    return area.join(gate, ["b", *keys])


def paired_risk(
    losses: DataFrame, case: str, a: str, b: str, keys: list[str], cluster: str, loss: str, replicates: int, seed: int
) -> DataFrame:
    """Areas under the risk curve, coverage and accepted loss of one case less those of another, by replicate."""
    names = ("aurc", "augrc", "coverage", "accepted_loss")
    both = bootstrap_risk(losses.where(F.col(case).isin(a, b)), [*keys, case], cluster, loss, replicates, seed)
    first, second = (both.where(F.col(case) == x).drop(case) for x in (a, b))
    second = second.select("b", *keys, *[F.col(m).alias(f"__{m}") for m in names])
    return first.join(second, ["b", *keys]).select("b", *keys, *[(F.col(m) - F.col(f"__{m}")).alias(m) for m in names])


def _chances(n: int, rate: float, concentration: float | None) -> np.ndarray:
    """Chances of 0 to n events: binomial, or beta-binomial with a mean of ``rate`` and the given concentration."""
    k = np.arange(n + 1)
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    choose = math.lgamma(n + 1) - lgamma(k + 1.0) - lgamma(n - k + 1.0)
    if concentration:
        a, b = rate * concentration, (1 - rate) * concentration
        if min(a, b) <= 0:
            return (k == (0 if rate <= 0 else n)).astype(float)
        beta = lgamma(k + a) + lgamma(n - k + b) - math.lgamma(n + concentration)
        return np.exp(choose + beta - math.lgamma(a) - math.lgamma(b) + math.lgamma(concentration))
    with np.errstate(divide="ignore", invalid="ignore"):
        logs = choose + np.where(k > 0, k * np.log(rate), 0.0) + np.where(n - k > 0, (n - k) * np.log1p(-rate), 0.0)
    return np.exp(logs)


def _most_events(n: int, limit: float, confidence: float, method: str) -> int | None:
    """The most events among n with an upper bound of at most ``limit``; bounds rise with events."""
    z = NormalDist().inv_cdf(confidence)

    def within(k: int) -> bool:
        if method == "exact":
            return _exact_upper(k, n, confidence) <= limit
        p = k / n
        return (p + z * z / (2 * n) + z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n) <= limit

    if n < 1 or not within(0):
        return None
    low, high = 0, n
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if within(mid) else (low, mid - 1)
    return low


PLAN = "max_events int, pass_probability double, reaches boolean"


def gate_plan(
    designs: DataFrame, keys: list[str], limit: float, target: float, confidence: float = 0.95, method: str = "exact"
) -> DataFrame:
    """For each design (keys, n, rate, concentration) the most events that pass a bound of ``limit``, the chance to
    pass, and whether it reaches ``target``.

    ``method`` is exact (Clopper-Pearson) or wilson. A null concentration means independent events, another one
    beta-binomial ones. Without any passing count max_events is null and the chance 0. Designs are rows of a table and
    are planned where they lie.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for n, rate, c in zip(pdf["n"], pdf["rate"], pdf["concentration"]):
                most = _most_events(int(n), limit, confidence, method)
                chance = 0.0 if most is None else float(_chances(int(n), float(rate), c if c == c else None)[: most + 1].sum())
                out.append((most, min(chance, 1.0), chance >= target))
            yield pdf.assign(**{c: [x[i] for x in out] for i, c in enumerate(("max_events", "pass_probability", "reaches"))})

    types = dict(designs.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + f", n {types['n']}, rate double, concentration double, {PLAN}"
    rows = designs.select(*keys, "n", F.col("rate").cast("double").alias("rate"), F.col("concentration").cast("double").alias("concentration"))
    return rows.mapInPandas(run, schema)


def least_sample_size(plans: DataFrame, keys: list[str]) -> DataFrame:
    """The least n from which on every planned size of the key reaches the target; null if the largest doesn't."""
    missed = F.max(F.when(~F.col("reaches"), F.col("n")))
    rows = plans.join(plans.groupBy(*keys).agg(missed.alias("__missed")), keys)
    enough = F.col("reaches") & (F.col("__missed").isNull() | (F.col("n") > F.col("__missed")))
    return rows.groupBy(*keys).agg(F.min(F.when(enough, F.col("n"))).alias("least_n"))
