"""Run registered queries next to their check SQL: `python tests/compare.py [sf_dir] [name ...]`."""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(value):
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return repr(value)
    if hasattr(value, "item"):
        return _norm(value.item())
    return str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in data), key=repr)


def differences(spark_df, con, sql: str) -> str | None:
    """None when columns and rows agree, otherwise a short description."""
    ours = rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = rows(names, result.fetchall())
    if sorted(spark_df.columns) != sorted(names):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}"
    bad = [(a, b) for a, b in zip(ours, theirs, strict=True) if a != b]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else None


def main() -> int:
    import logging

    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    ORACLE, QUERIES = entry.oracle_sql(), entry.queries()

    logging.disable(logging.WARNING)
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failures = 0
    for name in chosen:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            if name in ORACLE:
                problem = differences(df, con, ORACLE[name])
            else:
                problem = None if df.count() > 0 else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failures += problem is not None
        kind = "sql" if name in ORACLE else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {name:24s} {kind:4s} {time.time() - start:6.2f}s {problem or ''}", flush=True)
    return failures


if __name__ == "__main__":
    sys.exit(main())
