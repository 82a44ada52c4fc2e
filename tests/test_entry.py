import duckdb
import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CORE = [n for n in __spark_entry__.queries() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return connection


def _rows(names: list[str], rows: list[tuple]) -> list[tuple]:
    """Rows with columns by name, whole numbers alike whatever their type."""
    order = sorted(range(len(names)), key=names.__getitem__)
    plain = lambda v: int(v) if isinstance(v, float) and v == v and abs(v) < 1e15 and v == int(v) else v
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", CORE)
def test_query_equals_its_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, DATA)
    found = list(map(tuple, df.collect()))
    sql = __spark_entry__.oracle_sql().get(name)
    if sql is not None:
        want = duck.sql(sql)
        assert _rows(df.columns, found) == _rows(want.columns, want.fetchall())
    else:
        assert len(found) > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
