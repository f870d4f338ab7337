"""Every named query with SQL, against that SQL on the small driver tables; skipped where those are missing."""

import math
import os

import duckdb
import pytest

from quillmap.plans import catalogue

SF = os.environ.get("QUILLMAP_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted([plain(r[c]) for c in columns] for r in df.collect())
    assert len(set(columns)) == len(columns)
    if name in catalogue.oracle_sql():
        rel = duck.sql(catalogue.oracle_sql()[name])
        assert sorted(rel.columns) == columns
        at = [rel.columns.index(c) for c in columns]
        assert got == sorted([plain(r[k]) for k in at] for r in rel.fetchall())
