"""Decision telemetry: windows, drift against a frozen reference, duplicates and alert state; batch and streaming."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalspark.operators.joins import small

STATES = ("ACCEPT", "REVIEW", "ABSTAIN", "REACQUIRE", "INVALID")
BINS = 10
#: Severity ladders: rate differences and population stability index.
RATE_STEPS = (0.02, 0.05, 0.10, 0.20)
PSI_STEPS = (0.1, 0.2, 0.3, 0.5)
SEVERITIES = ("none", "notice", "warning", "major", "critical")


def telemetry_window(events: DataFrame, width: str, slide: str | None = None, watermark: str | None = None) -> DataFrame:
    """Totals, counts by decision and a score histogram for each window; works on streams and tables.

    On a stream, ``watermark`` bounds the state: rows later than it are dropped (Spark counts them in its progress).
    """
    src = events.withWatermark("ts", watermark) if watermark else events
    cell = lambda k: F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)) == k
    win = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = src.groupBy(win.alias("w")).agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("decision") == s).alias(s.lower()) for s in STATES], *[F.count_if(cell(k)).alias(f"bin_{k}") for k in range(BINS)]
    )
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[c for c in out.columns if c != "w"])


def session_windows(events: DataFrame, key: str, gap: str, watermark: str | None = None) -> DataFrame:
    """Sessions of a key that end after a gap."""
    src = events.withWatermark("ts", watermark) if watermark else events
    out = src.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def psi_column(prefix: str):
    """Stability index of bin counts against those with ``prefix``, half a count added to each bin."""
    cur = [F.col(f"bin_{k}") + 0.5 for k in range(BINS)]
    ref = [F.col(f"{prefix}bin_{k}") + 0.5 for k in range(BINS)]
    total = lambda cols: sum(cols[1:], cols[0])
    tc, tr = total(cur), total(ref)
    return sum(((c / tc - r / tr) * (F.log(c / tc) - F.log(r / tr)) for c, r in zip(cur[1:], ref[1:])), (cur[0] / tc - ref[0] / tr) * (F.log(cur[0] / tc) - F.log(ref[0] / tr)))


def ladder(value, steps):
    return sum((F.when(value >= s, 1).otherwise(0) for s in steps[1:]), F.when(value >= steps[0], 1).otherwise(0))


def compare_windows(windows: DataFrame, reference: DataFrame, minimum: int = 30) -> DataFrame:
    """Every window against one frozen reference row: adverse rate differences, index, severity, action.

    More ACCEPT is not adverse; more of any other state is. Windows below ``minimum`` rows have too little evidence.
    """
    ref = reference.select(*[F.col(c).alias(f"ref_{c}") for c in ["total", *[s.lower() for s in STATES], *[f"bin_{k}" for k in range(BINS)]]])
    met = windows.join(F.broadcast(ref), F.lit(True))  # one row
    rate = lambda s: F.col(s.lower()) / F.col("total") - F.col(f"ref_{s.lower()}") / F.col("ref_total")
    adverse = F.greatest(*[rate(s) for s in STATES if s != "ACCEPT"], -rate("ACCEPT"))
    rank = F.greatest(ladder(F.round(adverse, 9), RATE_STEPS), ladder(F.round(psi_column("ref_"), 9), PSI_STEPS))
    severity = F.when(F.col("total") < minimum, "insufficient_evidence").otherwise(F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), rank + 1))
    action = F.when(F.col("total") < minimum, "collect").when(rank >= 3, "stop").when(rank >= 1, "review").otherwise("continue")
    return met.select("start", "total", F.round(adverse, 6).alias("adverse"), F.round(psi_column("ref_"), 6).alias("psi"), severity.alias("severity"), action.alias("action"))


def conflicting_keys(events: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """T5: keys that came with different payloads."""
    hashed = events.select(key, F.sha2(F.to_json(F.struct(*payload)), 256).alias("h")).distinct()
    return hashed.groupBy(key).agg(F.count(F.lit(1)).alias("payloads")).where("payloads > 1")


def first_results(stream: DataFrame, key: str, watermark: str) -> DataFrame:
    """T5: on a stream, the first row of each key within the watermark."""
    return stream.withWatermark("ts", watermark).dropDuplicatesWithinWatermark([key])


ALERT_SCHEMA = "release_id string, seen long, invalid long, severity string"


def stream_alert_state(stream: DataFrame) -> DataFrame:
    """Running counts and severity of each release, kept in the state store between batches."""

    def step(key: tuple, frames: Iterator, state) -> Iterator:
        import pandas as pd

        seen, invalid = state.get if state.exists else (0, 0)
        for pdf in frames:
            seen, invalid = seen + len(pdf), invalid + int((pdf["decision"] == "INVALID").sum())
        state.update((seen, invalid))
        rate = invalid / seen if seen else 0.0
        yield pd.DataFrame([(key[0], seen, invalid, SEVERITIES[sum(rate >= s for s in RATE_STEPS)])], columns=["release_id", "seen", "invalid", "severity"])

    return stream.groupBy("release_id").applyInPandasWithState(step, ALERT_SCHEMA, "seen long, invalid long", "update", "NoTimeout")


def reason_counts(events: DataFrame, width: str, watermark: str | None = None) -> DataFrame:
    """(start, reason, n) for each window, from events with an array of ``reasons``; works on streams and tables."""
    src = events.withWatermark("ts", watermark) if watermark else events
    long = src.select("ts", F.explode("reasons").alias("reason"))
    return long.groupBy(F.window("ts", width).alias("w"), "reason").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "reason", "n")


def reason_deltas(counts: DataFrame, totals: DataFrame, reference: DataFrame) -> DataFrame:
    """(start, reason, delta): each window's rate of a reason less the reference's (reason, rate), zero-filled.

    ``totals`` has a row (start, total) for each window. Reasons are few, so their table is broadcast; one that the
    reference doesn't know has the rate 0 there.
    """
    known = reference.select("reason").unionByName(counts.select("reason")).distinct()
    grid = totals.select("start", "total").join(small(known), F.lit(True))
    met = grid.join(counts, ["start", "reason"], "left").join(small(reference.select("reason", F.col("rate").alias("__rate"))), "reason", "left")
    rate = F.coalesce("n", F.lit(0)) / F.col("total")
    return met.select("start", "reason", (rate - F.coalesce("__rate", F.lit(0.0))).alias("delta"))


def order_faults(windows: DataFrame, series: list[str], index: str) -> DataFrame:
    """T4: windows whose index doesn't rise over the one that arrived before (``arrival``), by series. A series has one
    row for each window of time."""
    before = F.lag(index).over(Window.partitionBy(*series).orderBy("arrival"))
    return windows.withColumn("before", before).where(F.col("before") >= F.col(index)).select(*series, "arrival", index, "before")
