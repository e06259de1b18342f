"""Each registered query with SQL against DuckDB, at the smallest size."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from codeweave.plans import queries, queries_code  # noqa: F401  the latter registers its own

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def norm(v):
    return "-" if v is None else repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(norm, r)) for r in df.select(*columns).collect())
    with duckdb.connect() as db:
        for f in os.listdir(SF):
            db.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
        rel = db.sql(entry.oracle_sql()[name])
        names = list(rel.columns)
        assert sorted(names) == columns
        want = sorted(tuple(norm(r[names.index(c)]) for c in columns) for r in rel.fetchall())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
