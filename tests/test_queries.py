"""Every query with SQL, against DuckDB on the smallest tables."""

import duckdb
import pytest

from trackloom import plans

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(rows):
    return sorted((tuple(round(v, 9) + 0.0 if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = norm(tuple(r) for r in df.select(cols).collect())
    want = norm(duck.execute("SELECT " + ", ".join(f'"{c}"' for c in cols) + f" FROM ({plans.ORACLE_SQL[name]})").fetchall())
    assert got == want
