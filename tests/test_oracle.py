"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as contract
from workload import catalog, landing

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def comparable(rows):
    return sorted(repr(tuple(float(v) if type(v) is int else v for v in r)) for r in rows)


def compare(spark, duck, name, sql):
    df = contract.queries()[name](spark, SF)
    columns = sorted(df.columns)
    expected = duck.sql(sql)
    assert sorted(expected.columns) == columns
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = duck.sql(f"SELECT {quoted} FROM expected").fetchall()
    assert comparable(tuple(r) for r in df.select(*columns).collect()) == comparable(want)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    compare(spark, duck, name, contract.oracle_sql()[name])


@pytest.mark.parametrize("name", ["src_csv", "src_valid_files", "src_rejects"])
def test_seasons_of_several_files(spark, duck, name, monkeypatch):
    sql = contract.oracle_sql()[name]
    assert f"id // {landing.ROWS_PER_FILE}" in sql
    sql = sql.replace(f"id // {landing.ROWS_PER_FILE}", "id // 1000")
    monkeypatch.setattr(landing, "ROWS_PER_FILE", 1_000)
    compare(spark, duck, name, sql)


def test_entry(spark):
    assert contract.entry(spark).count() == 20


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLE)
