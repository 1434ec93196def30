"""Every registered query of the core against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest
from sigtrail.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = {name: f for m in registry.MODULES for name, f in m.QUERIES.items()}
SQL = {name: q for m in registry.MODULES for name, q in m.ORACLE_SQL.items()}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toArrow()
    if name not in SQL:
        assert got.num_rows > 0
        return
    expected = duck.sql(SQL[name]).df()
    assert sorted(expected.columns) == sorted(got.column_names)
    duck.register("expected", expected)
    duck.register("got", got)
    columns = ", ".join(f'"{c}"' for c in sorted(expected.columns))
    for a, b in (("expected", "got"), ("got", "expected")):
        assert duck.sql(f"SELECT {columns} FROM {a} EXCEPT ALL SELECT {columns} FROM {b}").df().empty


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
