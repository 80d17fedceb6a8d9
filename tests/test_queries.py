"""Every query with SQL beside it gives the same rows as DuckDB at sf0.001; the others return rows."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
MODULES = [m for m in entry_points._modules() if not m.__name__.startswith("evalspark.llm")]
NAMES = [n for m in MODULES for n in m.QUERIES]
SQL = {n: q for m in MODULES for n, q in m.ORACLE_SQL.items()}
QUERIES = {n: q for m in MODULES for n, q in m.QUERIES.items()}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5) + 0.0
    if hasattr(x, "isoformat"):
        return x.replace(tzinfo=None).isoformat()
    return float(x) if type(x).__name__ == "Decimal" else x


def rows_of(rows, columns, wanted):
    at = [columns.index(c) for c in wanted]
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    wanted = sorted(df.columns)
    got = rows_of(df.collect(), df.columns, wanted)
    if name not in SQL:
        assert got
        return
    rel = duck.sql(SQL[name])
    assert sorted(rel.columns) == wanted
    assert got == rows_of(rel.fetchall(), rel.columns, wanted)
