"""Compares a corpus query with its DuckDB twin; run it as a script or from a test."""

import sys
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

TABLES = ["documents", "pages", "benchmark", "labels", "events", "conversations"]


def compare(spark, name, folder):
    import __spark_entry__ as contract

    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    frame = contract.queries()[name](spark, folder)
    result = connection.execute(contract.oracle_sql()[name])
    columns = [part[0] for part in result.description]
    assert sorted(frame.columns) == sorted(columns), (frame.columns, columns)
    places = [frame.columns.index(column) for column in columns]
    ours = sorted(repr(tuple(row[i] for i in places)) for row in frame.collect())
    theirs = sorted(repr(row) for row in result.fetchall())
    assert ours == theirs, next(pair for pair in zip(ours, theirs) if pair[0] != pair[1])
    return len(ours)


if __name__ == "__main__":
    import time

    from gleaner.session import build_session

    session = build_session("twins", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    session.sparkContext.setLogLevel("ERROR")
    for query in sys.argv[2:]:
        began = time.time()
        print(query, compare(session, query, sys.argv[1]), round(time.time() - began, 1), flush=True)
