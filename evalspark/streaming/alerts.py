"""Telemetry windows against a frozen reference: one severity model for states, reasons and scores; alert state of releases.

Windows are profiles (maps of counts), built by two aggregations that also run on a stream in append mode. A comparison is
a list of rows inside a window's own row, so that the worst of them needs no further shuffle.
"""

from __future__ import annotations

import datetime as dt
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from evalspark.operators.waves import let
from evalspark.streaming.telemetry import STATES

#: Fixed: severities and actions from least to worst.
SEVERITY = ("none", "notice", "warning", "high", "critical", "emergency")
ACTION = ("none", "investigate", "investigate", "restrict", "pause", "rollback")
_NOTICE, _WARNING = 1, 2


@dataclass(frozen=True)
class Limits:
    """Steps from which a rate difference or a stability index is a warning, high, critical and an emergency, and the
    rows that windows need as evidence. More of the states in ``welcome`` is never adverse, less of them is."""

    rate: tuple[float, float, float, float] = (0.02, 0.05, 0.10, 0.20)
    psi: tuple[float, float, float, float] = (0.1, 0.2, 0.3, 0.5)
    least_reference: int = 500
    least_window: int = 200
    least_scores: int = 100
    smoothing: float = 1e-6
    bins: int = 10
    welcome: tuple[str, ...] = ("ACCEPT",)


#: Rates and indices are compared after rounding to this many digits, so that sums in another order don't cross a step.
DIGITS = 9


def window_profiles(events: DataFrame, width: str, limits: Limits = Limits(), watermark: str | None = None) -> DataFrame:
    """start, end, total, scored, and maps of counts: states, reasons, bins.

    ``events`` has ts, decision, score (null: not scored) and an array of reasons; a reason counts once for an event.
    Works on tables, and on streams (``watermark`` given) in append mode: a window comes out when the watermark passes it.
    """
    src = events.withWatermark("ts", watermark) if watermark else events
    return _profiles(src, [F.window("ts", width).alias("w")], limits).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *_PROFILE)


def profile(events: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The profile of all events of a table, one row: a reference to freeze. An empty table has an empty profile."""
    return _profiles(events, [], limits).select(*_PROFILE)


_PROFILE = ("total", "scored", "states", "reasons", "bins")


def _profiles(events: DataFrame, keys: list[Column], limits: Limits) -> DataFrame:
    entry = lambda family, key: F.struct(F.lit(family).alias("family"), key.cast("string").alias("key"))
    bin_ = F.least(F.floor(F.col("score") * limits.bins), F.lit(limits.bins - 1))
    entries = F.concat(
        F.array(entry("total", F.lit(""))), F.array(entry("state", F.col("decision"))),
        F.when(F.col("score").isNotNull(), F.array(entry("bin", bin_))).otherwise(F.array()),
        F.transform(F.array_distinct(F.coalesce("reasons", F.array().cast("array<string>"))), lambda r: entry("reason", r)),
    )
    counts = events.select("ts", F.explode(entries).alias("e")).groupBy(*keys, F.col("e.family").alias("family"), F.col("e.key").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    own = lambda family: F.map_from_entries(F.collect_list(F.when((F.col("family") == family) & F.col("key").isNotNull(), F.struct("key", "n"))))
    part = lambda family: F.coalesce(F.sum(F.when(F.col("family") == family, F.col("n"))), F.lit(0)).alias
    by = [F.col("w")] if keys else []
    return counts.groupBy(*by).agg(part("total")("total"), part("bin")("scored"), own("state").alias("states"), own("reason").alias("reasons"), own("bin").alias("bins"))


def ladder(value: Column, steps: tuple[float, ...]) -> Column:
    """0 below the first step, 2 (warning) from there, and one more from each further step."""
    met = sum((F.when(F.round(value, DIGITS) >= s, 1).otherwise(0) for s in steps[1:]), F.when(F.round(value, DIGITS) >= steps[0], 1).otherwise(0))
    return F.when(met > 0, met + 1).otherwise(0)


def stability_index(now: Column, then: Column, limits: Limits) -> Column:
    """Population stability index of two maps from bin to count, each bin's count raised by ``limits.smoothing``."""
    bins = F.sequence(F.lit(0), F.lit(limits.bins - 1))
    raised = lambda m: F.transform(bins, lambda k: F.coalesce(m[k.cast("string")], F.lit(0)) + limits.smoothing)
    total = lambda counts: F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    shares = lambda m: let(raised(m), lambda own: let(total(own), lambda t: F.transform(own, lambda v: v / t)))
    terms = F.zip_with(shares(now), shares(then), lambda a, b: (a - b) * (F.log(a) - F.log(b)))
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def compare_profiles(windows: DataFrame, reference: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Each window's severity, action and status against one frozen reference row, and why.

    start, end, total, status, severity, action, evidence (what is below its minimum) and comparisons, an array of
    (family, key, reference_count, current_count, value, severity): the states, every reason that either side knows, and
    the stability index of scores. The worst comparison decides, so a reason alone can raise the severity. A comparison
    without enough rows is a notice. Works on streams, since nothing is shuffled.
    """
    ref = reference.select(*[F.col(c).alias(f"r_{c}") for c in _PROFILE])
    met = windows.join(F.broadcast(ref), F.lit(True))  # one row
    short = {
        "reference_window_below_minimum": F.col("r_total") < limits.least_reference, "current_window_below_minimum": F.col("total") < limits.least_window,
        "reference_score_histogram_below_minimum": F.col("r_scored") < limits.least_scores, "current_score_histogram_below_minimum": F.col("scored") < limits.least_scores,
    }
    lack = list(short.values())
    rates_ok = ~(lack[0] | lack[1])
    scores_ok = rates_ok & ~(lack[2] | lack[3])

    def row(family: Column, key: Column, then: Column, now: Column, value: Column, rank: Column) -> Column:
        return F.struct(
            family.alias("family"), key.alias("key"), then.cast("long").alias("reference_count"), now.cast("long").alias("current_count"),
            value.alias("value"), rank.cast("int").alias("rank"), F.get(F.array(*[F.lit(s) for s in SEVERITY]), rank.cast("int")).alias("severity"),
        )

    rate = lambda n, total: F.when(total > 0, n / total).otherwise(0.0)

    def compared(family: str, key: Column, column: str) -> Column:
        then, now = (F.coalesce(F.col(c)[key], F.lit(0)) for c in (f"r_{column}", column))
        delta = rate(now, F.col("total")) - rate(then, F.col("r_total"))
        adverse = F.greatest(F.when(key.isin(*limits.welcome), -delta).otherwise(delta) if family == "state" else delta, F.lit(0.0))
        rank = F.when(rates_ok, ladder(adverse, limits.rate)).otherwise(_NOTICE)
        return row(F.lit(family), key, then, now, adverse, rank)

    named = lambda c: F.array_sort(F.array_union(F.map_keys(f"r_{c}"), F.map_keys(c)))
    states = F.array_sort(F.array_union(F.array(*[F.lit(s) for s in STATES]), named("states")))
    index = F.when(scores_ok, stability_index(F.col("bins"), F.col("r_bins"), limits))
    scores = row(F.lit("score"), F.lit("psi"), F.col("r_scored"), F.col("scored"), index, F.when(scores_ok, ladder(index, limits.psi)).otherwise(_NOTICE))
    every = F.concat(F.transform(states, lambda k: compared("state", k, "states")), F.transform(named("reasons"), lambda k: compared("reason", k, "reasons")), F.array(scores))
    ranked = met.withColumn("comparisons", every).withColumn("rank", F.array_max(F.transform("comparisons", lambda c: c["rank"])))
    status = F.when(F.col("rank") >= _WARNING, "alert").when(~rates_ok, "evidence_insufficient").when(~scores_ok, "partial_evidence").otherwise("ok")
    named_at = lambda names: F.get(F.array(*[F.lit(x) for x in names]), F.col("rank"))
    evidence = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in short.items()]))
    kept = F.transform("comparisons", lambda c: F.struct(*[c[n].alias(n) for n in ("family", "key", "reference_count", "current_count", "value", "severity")]))
    at = [c for c in ("start", "end") if c in windows.columns]
    return ranked.select(*at, "total", status.alias("status"), named_at(SEVERITY).alias("severity"), named_at(ACTION).alias("action"), evidence.alias("evidence"), kept.alias("comparisons"))


def frozen(reference: DataFrame) -> dict:
    """A reference profile as plain values, for state processors; it holds a few states and reasons."""
    row = reference.first()
    return {c: row[c] for c in _PROFILE}


def rank_of(value: float, steps: tuple[float, ...]) -> int:
    """``ladder`` for one number."""
    met = sum(round(value, DIGITS) >= s for s in steps)
    return met + 1 if met else 0


ALERTS = "release_id string, status string, seen long, severity string, action string, worst string, last_ts timestamp"


class ReleaseAlerts(StatefulProcessor):
    """Counts of each release since it was last silent, its severity on T3's ladder, and an end to releases that
    fall silent.

    State: a value (rows seen and the last time), and a map from family and key to counts. Each batch moves a timer to
    ``silence`` after the last row; when it fires, the release's state is cleared and a row ``expired`` comes out. With
    processing time the state also has twice that long to live, so it goes even if a timer is lost.
    """

    def __init__(self, reference: dict, limits: Limits, silence: dt.timedelta, by_event_time: bool) -> None:
        self.reference, self.limits, self.silence, self.by_event_time = reference, limits, silence, by_event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        ttl = None if self.by_event_time else int(self.silence.total_seconds() * 2000)
        self.seen = handle.getValueState("seen", "n long, last_ms long", ttl)
        self.counts = handle.getMapState("counts", "family string, key string", "n long", ttl)

    def handleInputRows(self, key: tuple, rows: Iterator, timerValues) -> Iterator:
        n, last_ms = self.seen.get() if self.seen.exists() else (0, 0)
        added: Counter[tuple[str, str]] = Counter()
        for pdf in rows:
            n += len(pdf)
            last_ms = max(last_ms, int(pdf["ts"].max().timestamp() * 1000))
            added.update(("state", d) for d in pdf["decision"].dropna())
            added.update(("reason", r) for own in pdf["reasons"] if own is not None for r in set(own))
        for at, k in added.items():
            k += self.counts.getValue(at)[0] if self.counts.containsKey(at) else 0
            self.counts.updateValue(at, (k,))
        self.seen.update((n, last_ms))
        for old in self.handle.listTimers():
            self.handle.deleteTimer(old)
        begin = last_ms if self.by_event_time else timerValues.getCurrentProcessingTimeInMs()
        self.handle.registerTimer(begin + int(self.silence.total_seconds() * 1000))
        yield self._row(key[0], n, last_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator:
        n, last_ms = self.seen.get() if self.seen.exists() else (0, 0)
        self.seen.clear()
        self.counts.clear()
        yield self._frame((key[0], "expired", n, None, None, None, last_ms))

    def close(self) -> None:
        pass

    def _row(self, release: str, n: int, last_ms: int):
        then = self.reference
        now = {tuple(k): v[0] for k, v in self.counts.iterator()}
        known = {("state", s) for s in [*STATES, *then["states"]]} | {("reason", r) for r in then["reasons"]} | set(now)
        worst, best = "", 0
        for family, key in sorted(known):
            rate = now.get((family, key), 0) / n if n else 0.0
            was = then[f"{family}s"].get(key, 0) / then["total"] if then["total"] else 0.0
            adverse = was - rate if family == "state" and key in self.limits.welcome else rate - was
            if (rank := rank_of(max(adverse, 0.0), self.limits.rate)) > best:
                worst, best = f"{family}:{key}", rank
        enough = n >= self.limits.least_window and then["total"] >= self.limits.least_reference
        rank = best if enough else _NOTICE
        return self._frame((release, "active", n, SEVERITY[rank], ACTION[rank], worst if enough and best else None, last_ms))

    @staticmethod
    def _frame(row: tuple):
        import pandas as pd

        names = [c.split()[0] for c in ALERTS.split(", ")]
        out = pd.DataFrame([row], columns=names)
        out["last_ts"] = pd.to_datetime(out["last_ts"], unit="ms")
        return out


def release_alerts(
    stream: DataFrame, reference: dict, silence: dt.timedelta, limits: Limits = Limits(), watermark: str | None = None
) -> DataFrame:
    """A row for each release in each batch that has rows of it (``active``), and one when it has been silent for
    ``silence`` (``expired``); release_id, status, seen, severity, action, worst, last_ts.

    ``stream`` has ts, release_id, decision and an array of reasons. With ``watermark`` time is event time, and silence is
    measured by the watermark; else it is the clock, for which a query has to run on (``availableNow`` doesn't end, since
    timers may still come). The session's state store has to be RocksDB's
    (spark.sql.streaming.stateStore.providerClass), as Spark asks for such state. Rows without a release are left out.
    """
    src = stream.where("release_id IS NOT NULL").select("ts", "release_id", "decision", "reasons")
    src = src.withWatermark("ts", watermark) if watermark else src
    alerts = ReleaseAlerts(reference, limits, silence, watermark is not None)
    mode = "EventTime" if watermark else "ProcessingTime"
    return src.groupBy("release_id").transformWithStateInPandas(alerts, ALERTS, "Append" if watermark else "Update", mode)
