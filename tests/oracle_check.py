"""Compare registered queries with their checking SQL: names, row counts and exact values."""

import datetime
import decimal
import math
import sys
import time

import duckdb

from sluice.plans.bindings import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda place: columns[place])
    return sorted(([plain(row[place]) for place in order] for row in rows), key=repr)


def compare(spark, connection, name, query, sql, sf_dir) -> tuple[str | None, int, float]:
    """(what differs or None, rows, seconds)."""
    started = time.perf_counter()
    result = query(spark, sf_dir)
    found = [tuple(row) for row in result.collect()]
    seconds = time.perf_counter() - started
    if sql is None:
        return None, len(found), seconds
    checked = time.perf_counter()
    cursor = connection.execute(sql)
    names = [column[0] for column in cursor.description]
    expected = cursor.fetchall()
    if time.perf_counter() - checked > 5:
        print(f"     (checking SQL of {name}: {time.perf_counter() - checked:.1f}s)", flush=True)
    if sorted(names) != sorted(result.columns):
        return f"columns {sorted(result.columns)} != {sorted(names)}", len(found), seconds
    left, right = rows_of(result.columns, found), rows_of(names, expected)
    if left == right:
        return None, len(found), seconds
    wrong = [(a, b) for a, b in zip(left, right) if a != b][:2]
    return f"{len(left)} rows against {len(right)}; first differences {wrong}", len(found), seconds


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1]
    chosen = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in chosen or queries:
        try:
            problem, count, seconds = compare(spark, connection, name, queries[name], oracles.get(name), sf_dir)
        except Exception as error:  # keep going: this is a report
            problem, count, seconds = f"{type(error).__name__}: {str(error)[:600]}", -1, 0.0
        failed += problem is not None
        kind = "oracle" if name in oracles else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {name:32s} {kind:6s} {count:7d} rows {seconds:6.2f}s {(problem or '')[:900]}", flush=True)
    print("failed:", failed, "of", len(chosen or queries))
