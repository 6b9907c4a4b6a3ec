"""Every query with SQL gives what DuckDB gives for that SQL."""

import math

import duckdb
import pytest

from catalune.queries import MODULES, OPERATORS, ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return str(v)


def test_all_modules_load():
    assert len(MODULES) == 10 and len(QUERIES) > 150 and set(ORACLE) <= set(QUERIES) == set(OPERATORS)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_duckdb(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = con.execute(ORACLE[name])
    named = [d[0] for d in got.description]
    assert sorted(named) == cols
    want = sorted(tuple(norm(r[named.index(c)]) for c in cols) for r in got.fetchall())
    assert sorted(tuple(norm(x) for x in r) for r in df.select(*(f"`{c}`" for c in cols)).collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs_and_repeats(spark, name):
    rows = lambda: sorted(map(str, QUERIES[name](spark, SF).collect()))
    assert rows() == rows()
