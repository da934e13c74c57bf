"""The corpus queries that SQL can express, against DuckDB on the smallest tables."""

import duckdb
import pytest

from trackloom.llm import queries

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(cols).collect()), key=repr)
    want = sorted(duck.execute("SELECT " + ", ".join(cols) + f" FROM ({queries.ORACLE_SQL[name]})").fetchall(), key=repr)
    assert got == want and got
