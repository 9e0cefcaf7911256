"""Run registered queries on Spark and their SQL on DuckDB, and compare the results."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as contract  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return f"{value:.6f}"
    if hasattr(value, "isoformat"):
        return value.isoformat()[:26]
    return repr(value)


def compare(spark, con, name: str, sf_dir: str) -> tuple[bool, str]:
    """(equal, note) for one query: columns by name, rows as a multiset, value kinds."""
    got = contract.queries()[name](spark, sf_dir)
    columns = sorted(got.columns)
    start = time.time()
    rows = [tuple(row[got.columns.index(c)] for c in columns) for row in got.collect()]
    spent = f"collect {time.time() - start:.2f}s"
    sql = contract.oracle_sql().get(name)
    if sql is None:
        return True, f"rows only: {len(rows)}"
    start = time.time()
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = [tuple(row[names.index(c)] for c in columns) for row in cursor.fetchall()] if sorted(names) == columns else None
    spent += f", sql {time.time() - start:.2f}s"
    if want is None:
        return False, f"columns {columns} vs {sorted(names)}"
    left = sorted(tuple(map(_cell, row)) for row in rows)
    right = sorted(tuple(map(_cell, row)) for row in want)
    if left == right:
        return True, f"{len(left)} rows, {spent}"
    known_left, known_right = set(left), set(right)
    odd_left = [row for row in left if row not in known_right][:2]
    odd_right = [row for row in right if row not in known_left][:2]
    return False, f"{len(left)} vs {len(right)} rows\n   spark {str(odd_left)[:700]}\n   sql   {str(odd_right)[:700]}"


def main() -> None:
    from tabmeld.session import build_session

    sf_dir = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
           "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    wanted = sys.argv[1:] or list(contract.queries())
    bad = 0
    for name in [q for q in contract.queries() if any(q.startswith(w) for w in wanted)]:
        start = time.time()
        try:
            ok, note = compare(spark, con, name, sf_dir)
        except Exception as error:
            ok, note = False, f"{type(error).__name__}: {str(error)[:900]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.2f}s {note}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
