"""Runs queries in Spark and their SQL in DuckDB and compares rows and types of values.

    python -m tests.compare [SF_DIR] [QUERY ...]
"""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

SF_DIR = "/root/testdata/sf0.01"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def rows_of(columns: list[str], rows: list[tuple]) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple((type(r[i]).__name__, r[i]) for i in order) for r in rows)


def difference(spark, con, name: str, query, sql: str, sf_dir: str) -> str | None:
    """None where both agree, else what differs."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    want = rows_of(columns, cursor.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if got == want:
        return None
    extra, missing = list((got - want).items())[:3], list((want - got).items())[:3]
    return f"rows {sum(got.values())} / {sum(want.values())}\n  only Spark: {extra}\n  only SQL: {missing}"


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from skillstrata.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else SF_DIR
    spark = build_session("local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = connect(sf_dir), oracle_sql()
    wanted = [name for name in sys.argv[2:] or queries() if name in sql]
    bad = 0
    for name in wanted:
        started = time.time()
        try:
            result = difference(spark, con, name, queries()[name], sql[name], sf_dir)
        except Exception as error:  # noqa: BLE001 - shown and counted
            result = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += result is not None
        print(f"{name}: {'same' if result is None else result} [{time.time() - started:.1f}s]", flush=True)
    print(f"{len(wanted) - bad} of {len(wanted)} agree")


if __name__ == "__main__":
    main()
