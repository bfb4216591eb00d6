import os

import duckdb
import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def core():
    from quillstone.plans import core

    return core


@pytest.mark.parametrize("name", sorted(core().ORACLE))
def test_against_sql(spark, name, tmp_path):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    core().QUERIES[name](spark, DATA).write.parquet(str(tmp_path / "out"))
    a, b = con.sql(f"SELECT * FROM read_parquet('{tmp_path}/out/*.parquet')"), con.sql(core().ORACLE[name])
    assert sorted(a.columns) == sorted(b.columns)
    cols = ", ".join(f'"{c}"' for c in sorted(a.columns))
    assert con.sql(f"(SELECT {cols} FROM a EXCEPT ALL SELECT {cols} FROM b) UNION ALL (SELECT {cols} FROM b EXCEPT ALL SELECT {cols} FROM a)").fetchall() == []


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 40 and set(e.oracle_sql()) <= set(e.queries())
