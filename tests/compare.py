"""Run registered queries in Spark and in DuckDB and compare the results."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(_cell(row[i]) for i in order) for row in rows),
        key=lambda row: tuple((value is not None, str(value)) for value in row),
    )


def difference(spark_df, con, sql: str) -> str | None:
    """What tells the two results apart, or None."""
    relation = con.sql(sql)
    names, expected_names = list(spark_df.columns), list(relation.columns)
    if sorted(names) != sorted(expected_names):
        return f"columns {sorted(names)} != {sorted(expected_names)}"
    types = dict(spark_df.dtypes)
    wanted = dict(zip(expected_names, map(str, relation.types)))
    same = {
        "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
        "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE",
    }
    for name in names:
        if same.get(types[name], types[name]) != wanted[name]:
            return f"type of {name}: {types[name]} != {wanted[name]}"
    got = _rows(names, [tuple(row) for row in spark_df.collect()])
    expected = _rows(expected_names, relation.fetchall())
    if len(got) != len(expected):
        extra = [r for r in got if r not in expected][:5] if len(got) < 500 else []
        missing = [r for r in expected if r not in got][:5] if len(got) < 500 else []
        return f"{len(got)} rows != {len(expected)}; extra {extra}; missing {missing}"
    for a, b in zip(got, expected):
        if a != b:
            return f"row {a} != {b}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from pyspark.sql import SparkSession

    import __spark_entry__ as registry

    folder = sys.argv[1]
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracles = registry.queries(), registry.oracle_sql()
    chosen = sys.argv[2:] or list(queries)
    failed = 0
    for name in chosen:
        start = time.time()
        try:
            problem = difference(queries[name](session, folder), con, oracles[name])
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:300]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {time.time() - start:6.2f}s {name}"
              + (f": {problem}" if problem else ""), flush=True)
    print(f"{len(chosen) - failed} of {len(chosen)} agree; without SQL: "
          f"{sorted(set(queries) - set(oracles))}; SQL alone: {sorted(set(oracles) - set(queries))}")
