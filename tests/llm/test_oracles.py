import duckdb
import pytest

from flowquarry.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = queries.QUERIES[name](spark, SF)
    cursor = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    expected = [dict(zip(names, r)) for r in cursor.fetchall()]
    assert sorted(found.columns) == sorted(names)
    key = lambda r: str(sorted(r.items(), key=lambda x: x[0]))
    assert sorted(map(key, expected)) == sorted(key(r.asDict()) for r in found.collect())
