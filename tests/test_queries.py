"""Every query with SQL gives the same rows as DuckDB at the smallest scale."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from panelloom.operators import panel
from panelloom.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def same(spark_rows, columns, cursor):
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(columns)
    got = sorted(tuple(plain(r[c]) for c in sorted(columns)) for r in spark_rows)
    at = [names.index(c) for c in sorted(columns)]
    want = sorted(tuple(plain(r[k]) for k in at) for r in cursor.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, SF)
    same(df.collect(), df.columns, con.execute(registry.oracle_sql()[name]))


def test_invalid_symbols_and_empty_months(spark):
    """What the whole test tables don't have."""
    table = lambda *symbols: spark.createDataFrame([(s,) for s in symbols], "symbol string")
    got = panel.status({"bars": table("a", "b", "b"), "parts": table("a", "c")}, table("a", "b", "c", "d")).collect()
    assert {r["symbol"]: (r["status"], r["reason"]) for r in got} == {"a": ("success", None), "b": ("invalid", "parts"), "c": ("invalid", "bars"), "d": ("invalid", "bars")}
    m = spark.createDataFrame([("macro", "2001-01", None), ("macro", "2001-02", 4.0), ("macro", "2001-03", None), ("macro", "2001-04", 8.0)], "symbol string, month string, m_gap double")
    got = {r["month"]: r["m_gap"] for r in panel.ewm_fill(m, ("m_gap",), lead=False).collect()}
    assert (got["2001-02"], got["2001-03"], got["2001-04"]) == (4.0, 4.0, 8.0)
