"""Every registered query with an oracle matches DuckDB on the small tables."""

import pytest

import __spark_entry__ as E
from oracle_check import compare, duck
from type_check import SPARK_TO_DUCK

SQLS = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def con(sf_small):
    return duck(sf_small)


@pytest.mark.parametrize("name", sorted(SQLS))
def test_query_matches_oracle(spark, sf_small, con, name):
    sdf = QUERIES[name](spark, sf_small)
    types = {n: SPARK_TO_DUCK.get(t, t.upper()) for n, t in sdf.dtypes}
    assert types == {r[0]: r[1] for r in con.execute(f"DESCRIBE {SQLS[name]}").fetchall()}
    sp = sdf.toPandas()
    dk = con.execute(SQLS[name]).df()
    ok, msg = compare(sp, dk)
    assert ok, msg


def test_every_oracle_has_a_query():
    assert set(SQLS) <= set(QUERIES)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert len(df.columns) > 0 and df.count() >= 0
