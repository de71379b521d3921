"""Every registered query beside its SQL twin on the smallest tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from gleaner import catalog

FOLDER = os.environ.get("GLEANER_TEST_DIR", "/root/testdata/sf0.001")
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations"]
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def twin():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def ordered(columns, rows):
    places = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([row[i] for i in places]) for row in rows)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, twin, name):
    frame = catalog.queries()[name](spark, FOLDER)
    rows = [tuple(row) for row in frame.collect()]
    result = twin.execute(catalog.oracle_sql()[name])
    columns = [part[0] for part in result.description]
    assert sorted(frame.columns) == sorted(columns)
    assert ordered(frame.columns, rows) == ordered(columns, result.fetchall())


def test_log_rows_are_numbered_by_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    from gleaner.catalog import tables

    rows = tables.read(spark, FOLDER, "lineitem")
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(tables, "NUMBERED_ROWS", 100)
    # one shuffle partition, as a session with few of them: the sort must not grow with the table
    monkeypatch.setattr(tables, "_stored", {})
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        log = tables.log_base(spark, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert log.count() == log.select("id").distinct().count() == rows.count()
    assert max(r["n"] for r in log.groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()) < 500


def test_entry(spark):
    assert len(contract.entry(spark).columns) == 11
    assert set(catalog.oracle_sql()) == set(catalog.queries())
    assert set(catalog.queries()) <= set(contract.queries())
