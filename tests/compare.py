"""Run a registered query beside its SQL and compare columns, row counts and values."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else (0.0 if value == 0 else value)
    return value


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    data = [tuple(normal(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(data, key=lambda r: tuple((v is None, str(type(v)), v) for v in r))


def differences(df, con, sql: str) -> str | None:
    """None if both sides agree, else what differs first."""
    spark_columns, spark_rows = sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    oracle_columns, oracle_rows = sorted_rows([d[0] for d in cursor.description], cursor.fetchall())
    if spark_columns != oracle_columns:
        return f"columns {spark_columns} / {oracle_columns}"
    if len(spark_rows) != len(oracle_rows):
        return f"rows {len(spark_rows)} / {len(oracle_rows)}"
    for a, b in zip(spark_rows, oracle_rows):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            k = next(i for i in range(len(a)) if a[i] != b[i] or type(a[i]) is not type(b[i]))
            return f"{spark_columns[k]}: {str(a[k])[:300]!r} / {str(b[k])[:300]!r} in {str(a)[:200]}"
    return None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    print("oracles without a query:", sorted(set(oracles) - set(queries)))
    bad = 0
    for name in sys.argv[2:] or queries:
        start = time.time()
        try:
            if name in oracles:
                problem = differences(queries[name](spark, sf_dir), con, oracles[name])
            else:
                problem = None
                print("   rows only:", name, queries[name](spark, sf_dir).count())
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        bad += problem is not None
        print("ok " if problem is None else "BAD", name, round(time.time() - start, 1), problem or "", flush=True)
    print("bad:", bad)
