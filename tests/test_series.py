"""Telemetry streams, timelines and signals."""

import datetime as dt

from pyspark.sql import functions as F

from evalspark.functions.expressions import parse_composite_codes
from evalspark.operators import checks, joins, waves
from evalspark.operators.longitudinal import build_timelines, edge_bin, future_targets
from evalspark.streaming import telemetry as t

EVENTS = "event_id long, ts timestamp, release_id string, decision string, score double"


def events(spark, n=40):
    base = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, base + dt.timedelta(minutes=7 * i), f"r{i % 2}", "INVALID" if i % 4 == 0 else "ACCEPT", i / n) for i in range(n)], EVENTS)


def test_stream_windows_equal_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    events(spark).write.parquet(src)
    stream = t.telemetry_window(spark.readStream.schema(EVENTS).parquet(src), "1 hour", watermark="2 hours")
    q = stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    got = sorted(map(tuple, spark.table("windows").collect()))
    assert got == sorted(map(tuple, t.telemetry_window(events(spark), "1 hour").collect()))


def test_stream_dedup_and_alert_state(spark, tmp_path):
    src = str(tmp_path / "in")
    events(spark).unionByName(events(spark)).write.parquet(src)
    stream = spark.readStream.schema(EVENTS).parquet(src)
    q = t.first_results(stream, "event_id", "1 day").writeStream.format("memory").queryName("firsts").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(60)
    assert spark.table("firsts").count() == 40
    q = t.stream_alert_state(stream).writeStream.format("memory").queryName("alerts").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination(60)
    rows = {r.release_id: r for r in spark.table("alerts").collect()}
    assert rows["r0"].invalid == 20 and rows["r0"].severity == "critical" and rows["r1"].severity == "none"


def test_timeline_boundaries_and_censoring(spark):
    ts = lambda d: dt.datetime(2024, 1, d)
    rows = [(1, 1, ts(10), ts(30), "a"), (1, 2, ts(16), ts(30), "a"), (1, 3, ts(26), ts(30), "bad"), (2, 4, ts(15), ts(20), "a"), (3, 5, ts(15), ts(16), "a"), (4, 6, ts(20), ts(30), "a")]
    enc = spark.createDataFrame(rows, "patient_id long, encounter_id long, occurred_at timestamp, observed_through timestamp, event_label string")
    tl = build_timelines(enc, "2024-01-16 00:00:00", 10, 10)
    got = {r.patient_id: r for r in tl.collect()}
    assert sorted(got) == [1, 2, 3]
    assert [x.id for x in got[1].history] == [1, 2] and [x.id for x in got[1].future] == [3]
    out = {r.patient_id: (r.outcome, r.target_status) for r in future_targets(tl, ["bad"]).collect()}
    assert out == {1: (1, "observed"), 2: (None, "censored"), 3: (None, "insufficient")}


def test_score_on_an_edge(spark):
    assert spark.range(1).select(edge_bin(F.lit(0.58), 100)).first()[0] == 58


def test_composite_codes(spark):
    got = spark.createDataFrame([("1+200;501",), ("200",), ("1;1",)], "c string").select(parse_composite_codes(F.col("c")).alias("p")).collect()
    assert [x.primary_code for x in got[0].p] == [1, 501] and got[1].p is None and got[2].p is None


def test_flat_and_clipped_leads(spark):
    wave = spark.createDataFrame([(1, 0, 100.0, [0.5] * 8), (1, 1, 100.0, [0.0, 0.1, 0.3, 0.3, 0.0, 0.3, 0.1, 0.0])], "record_id long, lead_idx int, fs double, samples array<float>")
    got = {r.lead_idx: r for r in waves.lead_time_metrics(wave).collect()}
    assert got[0].flat_fraction == 1.0 and got[0].clip_run == 8 and got[1].clip_run == 2
    assert waves.record_quality(waves.lead_time_metrics(wave)).first().status == "REACQUIRE"


def test_zero_variance_lead_is_normalised_to_zero(spark):
    wave = spark.createDataFrame([(1, 0, 100.0, [2.0, 2.0])], "record_id long, lead_idx int, fs double, samples array<float>")
    assert list(waves.normalize(wave, waves.normalization_stats(wave)).first().samples) == [0.0, 0.0]


def test_incomplete_participant_is_left_out(spark):
    plan = spark.createDataFrame([("p", 1), ("p", 2), ("q", 1)], "participant string, trial int")
    told = spark.createDataFrame([("p", 1), ("q", 1), ("q", 9)], "participant string, trial int")
    assert [tuple(r) for r in joins.completed_participants(plan, told).collect()] == [("q", 1)]


def test_relative_paths(spark):
    paths = ["a/b", "/a", "C:x", "a/../b", "", "a//b", "a\tb", None]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i long, p string")
    bad = {r.i for r in checks.check_values(df, "i", {"path": checks.is_relative_path(F.col("p"))}).collect()}
    assert bad == {1, 2, 3, 4, 5, 6, 7}
