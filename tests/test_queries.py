"""Queries of the graph engine against their SQL on the smallest tables."""

import os
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from tessera.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in Path(SF).glob("*.parquet"):
        c.sql(f"create view {t.stem} as select * from '{t}{'/*.parquet' if t.is_dir() else ''}'")
    return c


def rows(found):
    return Counter(tuple(round(x, 9) + 0.0 if isinstance(x, float) else x for x in r) for r in found)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = rows(df.select(*columns).collect())
    if name not in ORACLE_SQL:
        assert got
        return
    r = con.sql(ORACLE_SQL[name])
    assert sorted(r.columns) == columns
    assert got == rows(con.sql("select " + ", ".join(f'"{c}"' for c in columns) + f" from ({ORACLE_SQL[name]})").fetchall())


def test_a_bound_predicate_prunes(spark):
    from tessera.sources import virtual

    plan = virtual.quads(spark, SF, ["customer", "nation", "orders"]).where(f"p = '{virtual.prop('mktsegment')}'")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "ReadSchema: struct<c_custkey:bigint,c_mktsegment:string>" in plan
