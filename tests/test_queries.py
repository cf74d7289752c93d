"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

from shelfspark.queries import ORACLE, QUERIES, flagship  # noqa: E402

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def canonical(rows, columns):
    cell = lambda v: repr(float(v)) if isinstance(v, float) else str(v)
    return sorted(tuple(cell(row[c]) for c in columns) for row in rows)


def compare(spark, fn, sql, data=DATA):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    ours = fn(spark, data)
    theirs = con.sql(sql)
    assert sorted(ours.columns) == sorted(theirs.columns)
    columns = sorted(ours.columns)
    rows = [dict(zip(theirs.columns, r, strict=True)) for r in theirs.fetchall()]
    assert canonical([r.asDict() for r in ours.collect()], columns) == canonical(rows, columns)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    compare(spark, QUERIES[name], ORACLE[name])


def test_flagship(spark):
    assert flagship(spark, DATA).count() > 0
