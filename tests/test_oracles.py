"""Every registered query with SQL gives the same rows as DuckDB."""

import duckdb
import pytest

from flowquarry import jobs  # noqa: F401
from flowquarry import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def shown(value):
    if isinstance(value, float):
        return "nan" if value != value else repr(round(value + 0.0, 6))
    return value if value is None else str(value)


def table(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(shown(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    found = Q.QUERIES[name](spark, SF)
    cursor = duck.execute(Q.ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    assert table([tuple(r) for r in found.collect()], found.columns) == table(cursor.fetchall(), names)
