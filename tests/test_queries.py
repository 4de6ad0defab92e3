"""Every registered query against its SQL, on the smallest tables."""

from collections import Counter
from pathlib import Path

import pytest

import __spark_entry__ as entry_module

duckdb = pytest.importorskip("duckdb")
FOLDER = Path("/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry_module.queries()))
def test_query(spark, database, name):
    df = entry_module.queries()[name](spark, str(FOLDER))
    columns = sorted(df.columns)
    rows = Counter(tuple(row[c] for c in columns) for row in df.collect())
    sql = entry_module.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    cursor = database.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = Counter(tuple(row[i] for i in order) for row in cursor.fetchall())
    assert rows == want


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
