"""Run each query beside its oracle and compare the rows, whatever their order.

Usage: python -m checks.compare [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks import catalog
from checks.fixtures import TABLES


TYPE_NAMES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
    "date": "DATE", "boolean": "BOOLEAN",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def plain(value):
    if isinstance(value, datetime.date) and not isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def rows_of(columns: list[str], rows) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(row[i]) for i in order]) for row in rows)


def compare(spark: SparkSession, connection, sf_dir: str, name: str) -> tuple[bool, str]:
    started = time.time()
    result = catalog.QUERIES[name](spark, sf_dir)
    got = rows_of(result.columns, result.collect())
    took = time.time() - started
    oracle = catalog.ORACLES.get(name)
    if oracle is None:
        return True, f"{len(got)} rows, no oracle, {took:.1f} s"
    answer = connection.sql(oracle)
    wanted = rows_of(answer.columns, answer.fetchall())
    if sorted(result.columns) != sorted(answer.columns):
        return False, f"columns {result.columns} and {answer.columns}"
    types = {f.name: f.dataType.simpleString() for f in result.schema.fields}
    for column, kind in zip(answer.columns, answer.types):
        if TYPE_NAMES.get(types[column], types[column]) != str(kind):
            return False, f"{column} is {types[column]} and {kind}"
    if got != wanted:
        pairs = [(g, w) for g, w in zip(got, wanted) if g != w][:1]
        return False, f"{len(got)} and {len(wanted)} rows, {str(pairs)[:700]}"
    return True, f"{len(got)} rows, {took:.1f} s"


def main(sf_dir: str = "/root/testdata/sf0.01", *names: str) -> int:
    builder = SparkSession.builder.master("local[8]").appName("compare")
    settings = {
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "8g",
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    failed = 0
    for name in names or catalog.QUERIES:
        try:
            good, note = compare(spark, connection, sf_dir, name)
        except Exception as error:
            good, note = False, f"{type(error).__name__}: {str(error)[:700]}"
        failed += not good
        print("ok  " if good else "FAIL", name, note, flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]) > 0)
