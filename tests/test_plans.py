"""Every registered job against its SQL text in DuckDB, on the smallest given tables."""

import os

import duckdb
import pytest

from plumbline.plans import catalogue
from tests.conftest import SMALL

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if value != value else round(value, 6) + 0.0
    if isinstance(value, (bool, int)) or value is None:
        return value
    return str(value)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="given tables are not here")
@pytest.mark.parametrize("name", sorted(catalogue.PLANS))
def test_job_matches_sql(spark, duck, name):
    plan = catalogue.PLANS[name]
    df = plan.job(spark, SMALL)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if plan.sql is None:
        return
    result = duck.execute(plan.sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    wanted = sorted((tuple(plain(r[i]) for i in order) for r in result.fetchall()), key=repr)
    assert rows == wanted
