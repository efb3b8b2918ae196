"""Every core query against its DuckDB SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from textloom.plans import registry


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def canonical(rows):
    value = lambda v: repr(float(v)) if isinstance(v, float) else str(v)
    return sorted(tuple(value(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf, oracle, name):
    df = registry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    if name in registry.oracle_sql():
        rel = oracle.execute(registry.oracle_sql()[name])
        names = [d[0] for d in rel.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        assert canonical(got) == canonical([tuple(r[k] for k in order) for r in rel.fetchall()])
