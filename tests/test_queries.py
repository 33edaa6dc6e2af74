"""Every query runs, and agrees with its SQL where it has one."""


from pathlib import Path

import duckdb
import pytest



def _entry():
    import __spark_entry__

    return __spark_entry__


def pytest_generate_tests(metafunc):
    if "query" in metafunc.fixturenames:
        metafunc.parametrize("query", sorted(n for n in _entry().queries() if not n.startswith(("p6_", "p7_", "p8_"))))


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for p in Path(data).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def test_query(spark, data, duck, query, tmp_path):
    df = _entry().queries()[query](spark, data)
    out = str(tmp_path / "out")
    df.write.parquet(out)
    sql = _entry().oracle_sql().get(query)
    if sql is None:
        return
    cols = ", ".join(f'"{c}"' for c in sorted(df.columns))
    duck.sql(f"CREATE OR REPLACE TEMP TABLE want AS {sql}")
    duck.sql(f"CREATE OR REPLACE TEMP TABLE got AS SELECT * FROM '{out}/*.parquet'")
    assert sorted(r[0] for r in duck.sql("DESCRIBE want").fetchall()) == sorted(df.columns)
    for a, b in (("want", "got"), ("got", "want")):
        assert duck.sql(f"SELECT {cols} FROM {a} EXCEPT ALL SELECT {cols} FROM {b} LIMIT 3").fetchall() == []


def test_entry(spark, data):
    df = _entry().entry(spark)
    assert df.count() > 0 and df.columns == ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "o_orderdate"]
