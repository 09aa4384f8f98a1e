"""Compare named queries with their SQL oracles; also a command line tool.

    python tests/oracle_compare.py /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter
from datetime import date, datetime

TABLES = "region nation customer supplier part orders lineitem".split()

SAME_TYPE = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "date": "DATE",
    "boolean": "BOOLEAN",
}


def oracle_connection(folder: str):
    import duckdb

    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    return connection


def _cell(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, datetime):
        return value.date() if value.time() == datetime.min.time() else value
    return value


def _bag(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(spark, connection, folder: str, query, sql: str) -> str | None:
    """None when the results agree as bags of rows, else a short difference."""
    df = query(spark, folder)
    mine = [tuple(row) for row in df.collect()]
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(set(names) ^ set(df.columns))}"
    declared = {d[0]: str(d[1]) for d in cursor.description}
    types = {c: (t, declared[c]) for c, t in df.dtypes if SAME_TYPE.get(t) != declared[c]}
    if types:
        return f"types {types}"
    a, b = _bag(df.columns, mine), _bag(names, theirs)
    if a == b:
        return None
    only_a, only_b = a - b, b - a
    return (
        f"{len(mine)} vs {len(theirs)} rows, {sum(only_a.values())} differ\n"
        f"   spark  {sorted(only_a, key=str)[:2]}\n   oracle {sorted(only_b, key=str)[:2]}"
    )


def main() -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    from __spark_entry__ import oracle_sql, queries

    folder, *names = sys.argv[1:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = oracle_connection(folder)
    oracles, failed = oracle_sql(), []
    for name in names or queries():
        if name not in oracles:
            print(f"{name:32s} no oracle")
            continue
        start = time.time()
        try:
            difference = compare(spark, connection, folder, queries()[name], oracles[name])
        except Exception as error:  # report and go on with the next query
            difference = f"{type(error).__name__}: {str(error)[:600]}"
        if difference:
            failed.append(name)
        print(f"{name:32s} {time.time() - start:6.1f}s {difference or 'ok'}", flush=True)
    print(f"{len(failed)} failed: {failed}")
    return bool(failed)


if __name__ == "__main__":
    sys.exit(main())
