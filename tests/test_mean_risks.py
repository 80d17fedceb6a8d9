"""Mean risks near a half fall to the side on which the SQL's sum, taken in the order of events, puts them."""

import math

import duckdb
import pytest

from evalspark.operators import longitudinal as lo
from evalspark.plans.fixtures import with_fixtures
from evalspark.queries import followups, series

#: Means of 0.3 + 0.6 k, whose sums in this order round to other sides than exact ones.
VALUES = [
    [3.54, 17.97, 27.18, 20.82, 18.99], [7.74, 4.1, 7.1, 2.02, 7.54], [9.26, 53.05, 30.92, 31.32, 23.95],
    [3.81, 16.46, 11.29, 12.46, 14.48], [4.54, 8.18, 4.77, 10.13, 0.88], [5.1], [8.1], [11.7], [39.3], [54.3], [48.3], [29.27, 0.0, 700.0],
]


@pytest.fixture
def folder(spark, tmp_path):
    # 15 users, five of each kind of follow-up, have the same values
    rows = [(100 * user + j, user, x) for user in range(15 * len(VALUES)) for j, x in enumerate(VALUES[user // 15])]
    rows += [(9_000_000, 1_000_000, None)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, value double").repartition(7, "value")
    read = events.selectExpr("event_id", "TIMESTAMP '2024-01-15 00:00:00' AS ts", "user_id", "'view' AS event_type", "value", "'{}' AS props")
    read.coalesce(1).sortWithinPartitions("event_id").write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def sql_rows(folder, query):
    con = duckdb.connect()
    con.sql("SET threads = 1")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    return con.sql(query)


def test_mean_risks(spark, folder):
    want = dict(sql_rows(folder, with_fixtures(["encounters"], f"WITH {series._OBS} SELECT patient_id, risk FROM ob")).fetchall())
    got = {r.patient_id: r.risk for r in series._obs(spark, folder).collect()}
    assert got == want and len(got) == 15 * len(VALUES) + 1


@pytest.mark.parametrize("module, name", [(series, "l5_risk_bins"), (series, "l6_follow_up"), (followups, "l6_follow_up_fractions")])
def test_bins(spark, folder, module, name):
    df = module.QUERIES[name](spark, folder)
    rel = sql_rows(folder, module.ORACLE_SQL[name])
    at = [rel.columns.index(c) for c in df.columns]
    assert sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr) == sorted(map(tuple, df.collect()), key=repr)


def test_sum_goes_by_order_and_leaves_nulls_out(spark):
    values = [0.1, None, 0.2, 0.3, 1e16, 1.0, -1e16]
    rows = [("a", k, v) for k, v in enumerate(values)] + [("b", 0, None), ("c", 0, math.inf)]
    df = spark.createDataFrame(rows, "g string, k int, v double").repartition(5, "k")
    got = {r.g: r["mean"] for r in lo.means_in_order(df, "g", "v", ["k"]).collect()}
    assert got == {"a": (0.1 + 0.2 + 0.3 + 1e16 + 1.0 - 1e16) / 6, "b": None, "c": math.inf}
