"""Steps that go wrong only on larger tables: ranks over blocks, ties of sums, joins by a file's size."""

import hashlib

import pytest
from pyspark.sql import functions as F

from evalspark.operators import audits as au
from evalspark.operators import corruptions as c
from evalspark.operators import intervals as b
from evalspark.operators import metrics as m
from evalspark.operators import selective as sel
from evalspark.plans import prims
from evalspark.plans.prims import prefix_scan
from evalspark.queries import series


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_turns_follow_the_rank_among_all_participants(spark):
    n = 150_000
    out = c.counterbalanced_order(spark.range(n).withColumnRenamed("id", "participant"), spark.range(1).withColumnRenamed("id", "case_id"), ["guided", "plain"], "k")
    got = {r.participant for r in out.where("arm = 'guided' AND arm_place = 1").select("participant").collect()}
    order = sorted(range(n), key=lambda p: (hashlib.sha256(f"k|{p}".encode()).hexdigest(), p))
    assert got == set(order[::2])
    assert out.count() == 2 * n


def test_risk_of_an_exact_half_goes_up_in_any_order(spark, tmp_path):
    sums = {0: [48.3], 1: [0.1, 96.5], 2: [96.5, 0.1], 3: [43.5], 4: [48.2], 5: [700.0]}
    rows = [(u * 10 + i, u, v) for u, vs in sums.items() for i, v in enumerate(vs)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, value double")
    events.selectExpr("event_id", "TIMESTAMP '2024-01-15 00:00:00' AS ts", "user_id", "'view' AS event_type", "value", "'{}' AS props").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.patient_id: r.risk for r in series._obs(spark, str(tmp_path)).collect()}
    assert got == {0: 0.81, 1: 0.81, 2: 0.81, 3: 0.73, 4: 0.8, 5: 1.0}


def test_ranked_rows_are_never_broadcast(spark):
    rows = spark.range(5000).select(F.lit("a").alias("g"), F.col("id").alias("record_id"), (F.col("id") % 97 / 97).alias("prob"), (F.col("id") % 3 == 0).cast("int").alias("target"))
    assert "BroadcastExchange" not in plan_of(prefix_scan(rows, ["g"], [F.col("prob"), F.col("record_id")], {"rank": F.lit(1).cast("long")}))
    rates = b.bootstrap_rates(rows.withColumn("cluster", F.col("record_id") % 500), ["g"], "cluster", "target", 3, 1)
    # the one broadcast table is that of the clusters' numbers by key
    assert plan_of(rates).count("BroadcastHashJoin") == 1
    sweep = m.ece_sweep(rows, ["g"])
    assert plan_of(sweep).count("SortMergeJoin") == 1
    assert sweep.count() == 1


@pytest.fixture
def ordered(monkeypatch):
    """How many rows each prefix sum puts in order."""
    counts, real = [], prims.materialise

    def counted(df, name):
        out = real(df, name)
        counts.append(out.count())
        return out

    monkeypatch.setattr(prims, "materialise", counted)
    return counts


def test_bins_order_ties_and_the_records_of_cut_ties_only(spark, ordered):
    n, bins = 6000, 7
    rows = spark.range(n).select(F.lit("a").alias("g"), F.col("id").alias("record_id"), (F.col("id") % 97 / 97).alias("prob"), (F.col("id") * 7919 % 3 == 0).cast("int").alias("target"))
    got = {r.bin: (r.n, r.p_min, r.p_max, round(r.p_mean, 9), round(r.event_rate, 9)) for r in m.reliability_curve(rows, ["g"], bins).collect()}
    by = sorted((i % 97 / 97, i, int(i * 7919 % 3 == 0)) for i in range(n))
    want, at = {}, 0
    for k in range(bins):
        own = by[at : (at := at + n // bins + (k < n % bins))]
        want[k] = len(own), own[0][0], own[-1][0], round(sum(x[0] for x in own) / len(own), 9), round(sum(x[2] for x in own) / len(own), 9)
    assert got == want
    assert sum(ordered) < 97 + bins * 70


def test_the_kth_value_is_found_among_ties(spark, ordered):
    rows = spark.range(5000).select(F.lit("a").alias("g"), (F.col("id") % 50 / 50).alias("uncertainty"), F.col("id").alias("record_id"))
    got = sel.fit_entropy_gate(rows, ["g"], 0.333).first()
    assert (got.n, got.k, got.cutoff, got.kept) == (5000, 1665, 16 / 50, 1700)
    assert sum(ordered) == 50


def test_audits_order_no_table_of_all_records(spark, ordered):
    n = 3000
    pred = spark.range(n).select(
        F.lit("m").alias("model_id"), F.col("id").alias("record_id"), (F.col("id") % 100).alias("patient_id"), F.lit("x").alias("label"), (F.col("id") % 3 == 0).cast("int").alias("target"),
        F.lit(0.5).alias("raw"), (F.col("id") % 41 / 100 + 0.05).alias("prob"), F.lit(0).alias("decision"),
    )
    groups = spark.range(n).select(F.col("id").alias("record_id"), F.lit("half").alias("attribute"), (F.col("id") % 2).cast("string").alias("group_value"))
    gates = spark.createDataFrame([("m", 0.5, 0.7)], "model_id string, target_coverage double, maximum_entropy double")
    records = au.audit_records(pred)
    assert au.gate_audit(records, gates, groups).selections().count() == 3 and ordered == []
    shares = au.coverage_audit(records, [0.0, 0.5, 0.7, 1.0], groups).selections()
    got = {(r.group_value, r.target_coverage): r.selected for r in shares.collect()}
    # a larger prob below a half is less certain; ties go by record
    order = sorted(range(n), key=lambda i: (i % 41, i))
    for share in (0.0, 0.5, 0.7, 1.0):
        kept = order[: round(share * n)]
        assert got["all", share] == len(kept) and got["1", share] == sum(i % 2 for i in kept)
    assert sum(ordered) < 41 + 3 * 80
    ordered.clear()
    assert au.audit_curves(records).areas.count() == 2 and sum(ordered) == 2 * 41
