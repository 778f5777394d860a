"""Every registered query against its SQL on DuckDB, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import DATA
from tools.check import TABLES, TYPES, canon

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*cols).collect()]
    res = duck.execute(ORACLES[name])
    types = {d[0]: str(d[1]) for d in res.description}
    assert sorted(types) == cols
    assert {c: TYPES.get(t, t) for c, t in df.dtypes} == types
    order = [list(types).index(c) for c in cols]
    assert canon(got) == canon([tuple(r[i] for i in order) for r in res.fetchall()])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, str(DATA)).count() > 0


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
