"""Severity of windows against a frozen reference, on tables and streams, and alert state that expires."""

import datetime as dt
import math
import time

import pytest
from pyspark.sql import functions as F

from evalspark.streaming import alerts as al

EVENTS = "ts timestamp, release_id string, decision string, reasons array<string>, score double"
START = dt.datetime(2024, 1, 1)
LIMITS = al.Limits(least_reference=10, least_window=10, least_scores=5)
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def events(spark, rows):
    return spark.createDataFrame([(START + dt.timedelta(minutes=m), r, d, reasons, s) for m, r, d, reasons, s in rows], EVENTS)


def day(k, n, bad=(), decision="ACCEPT", score=0.5, release="r0"):
    return [(1440 * k + 20 * i, release, decision, list(bad) if i % 2 else [], score) for i in range(n)]


@pytest.fixture(scope="module")
def reference(spark):
    return al.profile(events(spark, day(0, 40) + day(0, 40, score=0.9)), LIMITS)


def judged(spark, rows, reference, limits=LIMITS):
    out = al.compare_profiles(al.window_profiles(events(spark, rows), "1 day", limits), reference, limits)
    return {r.start: r for r in out.collect()}


def test_a_reason_alone_raises_severity(spark, reference):
    calm = [(m, *r[1:4], s) for (m, *_), r, s in zip(day(1, 40), day(1, 40), [0.5, 0.9] * 20)]
    loud = [(m, r, d, ["clipped"] if i % 8 == 0 else [], s) for i, (m, r, d, _, s) in enumerate(calm)]
    quiet, worse = (next(iter(judged(spark, x, reference).values())) for x in (calm, loud))
    assert (quiet.status, quiet.severity, quiet.action) == ("ok", "none", "none")
    assert (worse.status, worse.severity, worse.action) == ("alert", "critical", "pause")
    worst = [c for c in worse.comparisons if c.severity == "critical"]
    assert [(c.family, c.key, c.reference_count, c.current_count) for c in worst] == [("reason", "clipped", 0, 5)]
    assert all(c.severity == "none" for c in worse.comparisons if c.family != "reason")


@pytest.mark.parametrize(("bad", "rank"), [(0, 0), (1, 0), (2, 2), (5, 3), (10, 4), (20, 5), (100, 5)])
def test_ladder_of_rates_and_direction(spark, bad, rank):
    """Less acceptance is adverse, more is not; steps belong to the severity they begin."""
    limits = al.Limits(least_reference=10, least_window=10, least_scores=10**9)
    base = al.profile(events(spark, [(i, "r", "ACCEPT", [], None) for i in range(100)]), limits)
    rows = [(1440 + i, "r", "REVIEW" if i < bad else "ACCEPT", [], None) for i in range(100)]
    got = next(iter(judged(spark, rows, base, limits).values()))
    # the score has too little evidence, which is a notice
    assert got.severity == al.SEVERITY[max(rank, 1)] and got.status == ("alert" if rank else "partial_evidence")
    by = {c.key: c for c in got.comparisons}
    assert by["ACCEPT"].value == pytest.approx(bad / 100) and by["REVIEW"].value == pytest.approx(bad / 100)
    back = next(iter(judged(spark, [(1440 + i, "r", "ACCEPT", [], None) for i in range(100)], al.profile(events(spark, rows), limits), limits).values()))
    assert all(c.value == 0.0 for c in back.comparisons if c.family == "state")


def test_stability_index_and_too_little_evidence(spark, reference):
    got = next(iter(judged(spark, day(1, 40, score=0.05), reference).values()))
    e = LIMITS.smoothing
    share = lambda counts: [(c + e) / (sum(counts) + 10 * e) for c in counts]
    now, then = share([40] + [0] * 9), share([0] * 5 + [40] + [0] * 3 + [40])
    psi = sum((a - b) * (math.log(a) - math.log(b)) for a, b in zip(now, then))
    assert got.comparisons[-1].value == pytest.approx(psi) and got.severity == "emergency"
    few = next(iter(judged(spark, day(1, 4), reference).values()))
    assert (few.status, few.severity, few.action) == ("evidence_insufficient", "notice", "investigate")
    assert few.evidence == ["current_window_below_minimum", "current_score_histogram_below_minimum"]
    none = al.profile(events(spark, day(0, 1)).where("false"), LIMITS)
    empty = next(iter(judged(spark, day(1, 40), none).values()))
    assert empty.status == "evidence_insufficient" and "reference_window_below_minimum" in empty.evidence
    assert judged(spark, [], reference) == {}


def test_nulls(spark, reference):
    rows = [(1440 + i, None, None, None if i % 2 else ["a", "a"], None) for i in range(40)]
    got = next(iter(judged(spark, rows, reference).values()))
    assert got.total == 40 and {c.key: c.current_count for c in got.comparisons}["a"] == 20


def test_comparison_on_a_stream_equals_the_table(spark, reference, tmp_path):
    rows = day(1, 40) + day(2, 40, bad=("clipped",)) + day(3, 12, decision="INVALID") + day(4, 12)
    src = str(tmp_path / "in")
    events(spark, rows).repartition(3).write.parquet(src)
    stream = spark.readStream.schema(EVENTS).parquet(src)
    out = al.compare_profiles(al.window_profiles(stream, "1 day", LIMITS, "1 hour"), reference, LIMITS)
    q = out.writeStream.format("memory").queryName("judged").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    assert q.awaitTermination(120)
    got = {r.start: r for r in spark.table("judged").collect()}
    want = judged(spark, rows, reference)
    assert got and got.keys() == {s for s in want if s < START + dt.timedelta(days=4)}
    assert all(got[s] == want[s] for s in got)


@pytest.fixture
def rocksdb(spark):
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(PROVIDER, before)


def runner(spark, reference, folder, silence, watermark):
    """A function that adds a file to a source and reads it by a new query, which goes on from the last one's checkpoint."""

    def run(rows):
        got = []
        events(spark, rows).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        out = al.release_alerts(spark.readStream.schema(EVENTS).parquet(f"{folder}/in"), al.frozen(reference), silence, LIMITS, watermark)
        sink = out.writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).outputMode("append" if watermark else "update")
        q = sink.trigger(availableNow=True).option("checkpointLocation", f"{folder}/cp").start()
        assert q.awaitTermination(180)
        return got

    return run


def test_silent_releases_expire_by_event_time(spark, reference, rocksdb, tmp_path):
    run = runner(spark, reference, tmp_path, dt.timedelta(hours=12), "1 hour")
    first = {r.release_id: r for r in run(day(1, 20, release="r0") + day(1, 20, bad=("clipped",), release="r1"))}
    assert (first["r0"].status, first["r0"].seen, first["r0"].severity) == ("active", 20, "none")
    assert (first["r1"].severity, first["r1"].action, first["r1"].worst) == ("emergency", "rollback", "reason:clipped")
    # a new query goes on from the checkpoint: r0's counts are still there, r1 stays silent
    second = run(day(2, 20, decision="INVALID", release="r0"))
    r0 = [r for r in second if r.release_id == "r0" and r.status == "active"]
    assert [(r.seen, r.severity, r.worst) for r in r0] == [(40, "emergency", "state:ACCEPT")]
    third = second + run(day(4, 3, release="r2")) + run(day(5, 3, release="r2"))
    gone = {r.release_id: r for r in third if r.status == "expired"}
    assert set(gone) >= {"r0", "r1"} and gone["r1"].seen == 20 and gone["r0"].seen == 40
    assert gone["r1"].last_ts == START + dt.timedelta(minutes=1440 + 20 * 19)
    # what comes back starts from nothing
    again = [r for r in run(day(6, 12, release="r1")) if r.release_id == "r1" and r.status == "active"]
    assert [r.seen for r in again] == [12]


def test_state_goes_by_the_clock(spark, reference, rocksdb, tmp_path):
    """With processing time a query goes on looking at its timers, so a silent release expires without any new rows."""
    got = []

    def wait(enough):
        until = time.time() + 120
        while not enough() and time.time() < until:
            time.sleep(0.5)
        assert enough()

    events(spark, day(1, 12, release="r0")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    out = al.release_alerts(spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in"), al.frozen(reference), dt.timedelta(seconds=8), LIMITS)
    q = out.writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        wait(lambda: any(r.status == "expired" for r in got))
        assert [(r.status, r.seen) for r in got] == [("active", 12), ("expired", 12)]
        events(spark, day(3, 3, release="r0")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        wait(lambda: len(got) > 2)
        assert (got[2].status, got[2].seen) == ("active", 3)  # the earlier rows are forgotten
    finally:
        q.stop()


def test_rows_without_release_are_left_out(spark, reference, rocksdb, tmp_path):
    events(spark, [(1440 + i, None, "ACCEPT", None, 0.5) for i in range(5)]).write.parquet(f"{tmp_path}/in")
    out = al.release_alerts(spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in"), al.frozen(reference), dt.timedelta(hours=1), LIMITS, "1 hour")
    q = out.writeStream.format("memory").queryName("none").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    assert q.awaitTermination(120) and spark.table("none").count() == 0


def test_one_ladder(spark):
    values = [0.0, 0.0199999, 0.02, 0.049999999999, 0.05, 0.1, 0.2, 3.0]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(al.ladder(F.col("v"), LIMITS.rate).alias("r")).collect()
    assert [r.r for r in got] == [al.rank_of(v, LIMITS.rate) for v in values] == [0, 0, 2, 3, 3, 4, 5, 5]
