"""Spark results against DuckDB results of the same question."""

import math
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return v


def as_counter(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_value(row[i]) for i in order) for row in rows)


def differences(spark, con, run, sql, sf_dir):
    """Rows only in Spark, rows only in SQL."""
    df = run(spark, sf_dir)
    mine = as_counter(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns), (columns, df.columns)
    theirs = as_counter(columns, result.fetchall())
    return mine - theirs, theirs - mine, sum(mine.values())


if __name__ == "__main__":
    import os

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    from airlattice import registry

    sf_dir = sys.argv[1]
    only = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    sql = registry.oracle_sql()
    failed = []
    for name, run in registry.queries().items():
        if only and name not in only:
            continue
        begin = time.time()
        try:
            extra, missing, n = differences(spark, con, run, sql[name], sf_dir)
        except Exception as error:  # noqa: BLE001
            failed.append(name)
            print(f"{name}: ERROR {str(error)[:1200]}", flush=True)
            continue
        state = "ok" if not extra and not missing else f"DIFFERS {sum(extra.values())}/{sum(missing.values())}"
        print(f"{name}: {state} rows={n} {time.time() - begin:.1f}s", flush=True)
        if extra or missing:
            failed.append(name)
            print("   spark:", sorted(map(str, extra))[:3], "\n   sql:  ", sorted(map(str, missing))[:3], flush=True)
    print("failed:", failed)
