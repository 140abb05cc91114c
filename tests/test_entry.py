"""The driver's contract: queries run, and equal their SQL where there is any."""

import os

import duckdb
import pytest

import __spark_entry__


def views(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        con.execute(f"create view {name.split('.')[0]} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


OWN = [n for n in __spark_entry__.queries() if not n.startswith("op") and n != "pipeline"]


def test_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) and len(OWN) > 50


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", OWN)
def test_query_equals_sql(spark, sf, name):
    got = __spark_entry__.queries()[name](spark, sf).toPandas()
    sql = __spark_entry__.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    want = views(sf).execute(sql).fetchdf()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda d: sorted(map(str, d[columns].itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


@pytest.mark.parametrize(("quantity", "copies"), [("l_quantity + l_linenumber % 4 / 4.0", 1), ("l_quantity", 7)])
def test_intervals_of_fractions_and_repeated_rows(spark, sf, tmp_path, quantity, copies):
    """The SQL numbers islands over rows that may tie, so rows that are equal once cast are put to it once."""
    con = duckdb.connect()
    rows = f"SELECT l_suppkey, l_partkey, {quantity} AS l_quantity FROM '{sf}/lineitem.parquet'"
    con.execute(f"COPY (SELECT i.* FROM ({rows}) i, range({copies})) TO '{tmp_path}/lineitem.parquet'")
    con.execute(f"CREATE VIEW lineitem AS SELECT DISTINCT l_suppkey, l_partkey, CAST(l_quantity AS BIGINT) AS l_quantity FROM ({rows})")
    for name in ("interval_coverage", "covered_summary"):
        got = __spark_entry__.queries()[name](spark, str(tmp_path)).collect()
        assert sorted(map(tuple, got)) == sorted(con.execute(__spark_entry__.oracle_sql()[name]).fetchall())
