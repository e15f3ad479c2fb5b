"""Every query of the catalogue against its SQL in DuckDB."""

from pathlib import Path

import duckdb
import pytest

from codexlake.plans import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        connection.execute(f"create view {path.stem} as select * from '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    found = catalogue.queries()[name](spark, DATA)
    columns = sorted(found.columns)
    rows = sorted(repr(tuple(r)) for r in found.select(*columns).collect())
    sql = catalogue.oracle_sql()  # with the session's part of it
    if name in sql:
        wanted = duck.execute(sql[name])
        names = [d[0] for d in wanted.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert rows == sorted(repr(tuple(r[i] for i in at)) for r in wanted.fetchall())
    else:
        assert rows


def test_percent_decoding_keeps_what_is_no_escape(spark):
    from codexlake.functions import text as X

    row = spark.createDataFrame([("a%%%20b+%zz%C3%A9",)], "s string").select(X.url_decode("s")).first()
    assert row[0] == "a%% b+%zzé"
