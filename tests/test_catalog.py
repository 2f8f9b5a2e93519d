"""Every query of the catalog against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from graphloom import catalog

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, tables, name):
    df = catalog.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    mine = sorted((tuple(r) for r in df.select(columns).collect()), key=repr)
    found = tables.execute(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    assert mine == sorted(found, key=repr)
