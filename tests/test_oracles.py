"""Every query that has SQL gives what the SQL gives, and something."""

from collections import Counter
from decimal import Decimal

import duckdb
import pytest

from inkspan.plans.queries import OPERATORS

TABLES = ("documents", "pages", "labels", "conversations")


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, Decimal)):
        return round(float(v), 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", [n for n, (_, sql) in OPERATORS.items() if sql])
def test_query_equals_sql(spark, duck, sf_dir, name):
    query, sql = OPERATORS[name]
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    told = duck.execute(sql)
    at = [d[0] for d in told.description]
    assert sorted(at) == columns
    want = Counter(tuple(plain(r[at.index(c)]) for c in columns) for r in told.fetchall())
    assert got == want
    assert got
