"""Every core query with SQL gives DuckDB's rows over the smallest tables, where those are present."""

import decimal
from collections import Counter
from pathlib import Path

import pytest

from paperloom.plans import registry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
duckdb = pytest.importorskip("duckdb")


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, tables, name):
    got = registry.queries()[name](spark, str(DATA))
    result = tables.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(got.columns)
    want = Counter(tuple(plain(v) for v in row) for row in result.fetchall())
    assert Counter(tuple(plain(r[c]) for c in columns) for r in got.collect()) == want
