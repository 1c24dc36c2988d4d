"""Every query with SQL against DuckDB on the smallest tables."""

import datetime
import math
from decimal import Decimal

import duckdb
import pytest

from driftlens.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    return con


def canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, (float, Decimal)):
        return repr(round(float(v), 6) + 0.0)
    return v.isoformat()[:10] if isinstance(v, datetime.date) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, duck, name):
    df, sql = catalog.queries()[name](spark, SF), catalog.oracle_sql()[name]
    cols = sorted(df.columns)
    got = sorted(tuple(map(canon, r)) for r in df.select(*cols).collect())
    want = sorted(tuple(map(canon, r)) for r in duck.sql(f"select {', '.join(cols)} from ({sql})").fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_rows_only(spark, name):
    assert catalog.queries()[name](spark, SF.replace("0.001", "0.01")).count() > 0
